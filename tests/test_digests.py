import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import digests


def response(spark, raw, ftype="text"):
    r = spark.createDataFrame([(raw, ftype)], "r string, t string").select(digests.parse_response(F.col("r"), F.col("t")).alias("p")).first().p
    return r.zh, r.en, r.table


@pytest.mark.parametrize(
    ("raw", "ftype", "expected"),
    [
        ('{"zh": "甲 [段落 1]", "en": "A"}', "text", ("甲 [段落 1]", "A", None)),
        ('```json\n{"zh": "甲", "en": "A"}\n```', "text", ("甲", "A", None)),
        ('{"zh": ["一、甲", "二、乙"], "en": []}', "list[string]", ("甲\n乙", "", None)),
        ('{"zh": [{"term": "甲"}, {"x": 1}, "  "]}', "text", ('甲\n{"x":1}', "", None)),
        ('{"zh": "x", "table": "| a |"}', "table", ("x", "", "| a |")),
        ('{"zh": "x", "table": "| a |"}', "text", ("x", "", None)),
        ('{"zh": {"text": "y"}}', "text", ("y", "", None)),
        ('{"zh": ""}', "text", ('{"zh": ""}', "", None)),
        ("not json", "text", ("not json", "", None)),
        ('{"zh": 5}', "text", ('{"zh": 5}', "", None)),
    ],
)
def test_responses(spark, raw, ftype, expected):
    assert response(spark, raw, ftype) == expected


def versions(spark):
    new = json.dumps([{"name": "a", "label": "A", "ftype": "text", "source": "s", "zh": "甲", "en": "x", "table": None, "failed": False}], ensure_ascii=False)
    old = json.dumps([{"name": "a", "label": "A", "ftype": "text", "source": "s", "content": "旧", "failed": False}, {"name": "b", "label": "B", "zh": "引用缺失", "failed": False}], ensure_ascii=False)
    return spark.createDataFrame([("1", "d", 1, "", old, 0.5, "x"), ("2", "d", 2, "", new, None, "y"), ("3", "e", 1, "", "broken", 0.1, "z")], "id string, doc_id string, version bigint, field_schema string, content string, score double, created_at string")


def test_old_and_broken_contents(spark):
    got = [(r.doc_id, r.version, r.name, r.zh) for r in digests.fields(versions(spark)).orderBy("doc_id", "version", "ord").collect()]
    assert got == [("d", 1, "a", "旧"), ("d", 1, "b", "引用缺失"), ("d", 2, "a", "甲")]


def test_versions(spark):
    v = versions(spark)
    assert {(r.doc_id, r.version) for r in digests.latest(v).collect()} == {("d", 2), ("e", 1)}
    docs = spark.createDataFrame([("d",), ("f",)], "doc_id string")
    assert {(r.doc_id, r.next_version) for r in digests.next_versions(docs, v).collect()} == {("d", 3), ("f", 1)}
    back = digests.rollback(v, spark.createDataFrame([("d", 1)], "doc_id string, version bigint")).collect()
    assert [(r.version, r.score, "旧" in r.content) for r in back] == [(3, 0.0, True)]
    titles = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    md = {r.doc_id: r.markdown for r in digests.markdown(digests.latest(v), titles).collect()}
    assert md["d"] == "# T\n\n## A\n\n甲\n\n_English:_ x\n\n"
