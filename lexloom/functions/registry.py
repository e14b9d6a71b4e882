"""SQL names for the functions, and table functions for the structure operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from lexloom.operators.export import render

#: SQL expressions of functions with one argument x.
EXPRESSIONS = {
    "lex_trim": r"regexp_replace(x, '^[\\t-\\r\\x{85}\\p{Z}]+|[\\t-\\r\\x{85}\\p{Z}]+$', '')",
    "lex_mask_key": "CASE WHEN length(x) <= 8 THEN '***' ELSE concat(substring(x, 1, 6), '***') END",
    "lex_direction": "CASE WHEN x = 'zh_to_en' THEN x ELSE 'en_to_zh' END",
    "lex_escape_html": "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
    "lex_base64": "regexp_replace(base64(encode(x, 'utf-8')), '\\r?\\n', '')",
    "lex_has_citation": "contains(x, '引用缺失') OR contains(x, '[段落') OR contains(x, '段落 ') OR contains(x, '（段落')",
}


def fence_lines(md: str | None) -> Iterator[tuple[int, bool, str]]:
    """(position, in a fence, line) of a document."""
    fenced = False
    for i, line in enumerate((md or "").split("\n") if md is not None else ()):
        mark = line.strip().startswith("```")
        yield i, fenced or mark, line
        fenced ^= mark


def register(spark: SparkSession) -> list[str]:
    """Register all; gives their names."""
    from pyspark.sql.functions import udf, udtf

    for name, expression in EXPRESSIONS.items():
        kind = "BOOLEAN" if name == "lex_has_citation" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {expression}")
    spark.udf.register("lex_md_to_html", udf(render, "string"))

    class Lines:
        def eval(self, md: str):  # noqa: ANN201
            yield from fence_lines(md)

    spark.udtf.register("lex_lines", udtf(Lines, returnType="pos: int, fenced: boolean, line: string"))
    return [*EXPRESSIONS, "lex_md_to_html", "lex_lines"]
