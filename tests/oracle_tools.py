"""Compare a query with its SQL."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("LEXLOOM_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings parsed_docs segments bilingual_segments tasks digest_versions term_glossary eval_items split_limits".split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return float(f"{x:.9g}")
        if hasattr(x, "tolist") and not hasattr(x, "isoformat"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return tuple(map(one, x))
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return x

    columns = sorted(frame.columns)
    rows = [tuple(one(x) for x in row) for row in zip(*(frame[c].astype(object).tolist() for c in columns))] if len(frame) else []
    return sorted(rows, key=repr)


def run_sql(sql: str, data: str = DATA) -> pd.DataFrame:
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{data}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection.execute(sql).df()


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    if a == b:
        return ""
    only_a = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else []
    only_b = [x for x in b if x not in set(a)][:2] if len(b) < 20000 else []
    return f"{len(a)} and {len(b)} rows; only in the query: {str(only_a)[:700]}; only in the SQL: {str(only_b)[:700]}"
