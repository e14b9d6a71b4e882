import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import catalog, export, notes, transport


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("1758767455041", "2025-09-25 02:30:55.041"), ("2025-09-23T18:32:55.041+00:00", "2025-09-23 18:32:55.041"), ("2024-01-06 07:43:21", "2024-01-06 07:43:21"), ("x", None), ("", None), (None, None)],
)
def test_times(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "t string").select(T.parse_mixed_ts(F.col("t")).alias("t")).first().t
    assert (str(got)[: len(expected)] if expected else got) == expected


def test_configs(spark):
    configs = spark.createDataFrame([("a", "A", "key-aaaaaaaa", 1), ("b", "B", "key-bbbbbbbb", 0)], "id string, name string, key_ref string, is_default int")
    change = spark.createDataFrame([("b", "B2", "", 1)], configs.schema)
    got = {r.id: (r.name, r.key_ref, r.is_default) for r in catalog.upsert_config(configs, change).collect()}
    assert got == {"a": ("A", "key-aaaaaaaa", 0), "b": ("B2", "key-bbbbbbbb", 1)}
    added = catalog.upsert_config(configs, spark.createDataFrame([("c", "C", "k", 0)], configs.schema))
    assert {r.id: r.is_default for r in added.collect()} == {"a": 1, "b": 0, "c": 0}


def test_read_status_and_settings(spark):
    docs = spark.createDataFrame([("x", "unread"), ("y", None)], "id string, read_status string")
    assert {r.id: r.read_status for r in catalog.set_read_status(docs, "x", "read").collect()} == {"x": "read", "y": None}
    with pytest.raises(ValueError):
        catalog.set_read_status(docs, "x", "skimmed")
    assert catalog.with_read_status(docs, "unread").count() == 2
    settings = spark.createDataFrame([("k", "v")], "key string, value string")
    assert [catalog.setting(settings, k).first().value for k in ("k", "none")] == ["v", ""]


def test_imports(spark):
    files = spark.createDataFrame([("/a/x.pdf", bytearray(b"%PDF-1.7")), ("/a/y.PDF", bytearray(b"hello")), ("/a/z.txt", bytearray(b"%PDF-"))], "path string, content binary")
    assert {r.path: r.code for r in catalog.check_imports(files, "content").collect()} == {"/a/x.pdf": None, "/a/y.PDF": "E-1001", "/a/z.txt": "E-1001"}
    more = files.unionByName(files.sparkSession.createDataFrame([("/a/u.pdf", None)], files.schema))
    known = files.sparkSession.createDataFrame([("/a//x.pdf",), (None,)], "file_path string")
    assert {r.path: r.code for r in catalog.check_imports(more, "content", known).collect()} == {"/a/x.pdf": "E-1002", "/a/y.PDF": "E-1001", "/a/z.txt": "E-1001", "/a/u.pdf": "E-1003"}


def test_export_scopes_and_html(spark):
    parts = spark.createDataFrame([(1, "T", "ORIGINAL", "TRANSLATED", "DIGEST")], "doc_id bigint, title string, original string, translated string, digest string")
    for scope, there in {"all": "OTD", "no-original": "TD", "bilingual": "OT", "translated": "T", "digest": "D", "other": "OTD"}.items():
        text = parts.select(export.compose_markdown(F.lit(scope)).alias("m")).first().m
        assert "".join(c for c, w in zip("OTD", ("ORIGINAL", "TRANSLATED", "DIGEST")) if w in text) == there
    page = export.compose_html(parts, "sepia", "digest").first().html
    assert "#f5ecd9" in page and "DIGEST" in page and "ORIGINAL" not in page


def test_rendering():
    html = export.render("# 标题\n\n正文 **加粗** 与 `代码`。\n\n| A | B |\n|---|---|\n| 1 | 2 |\n```rs\nfn main() {}\n```\n- x\n- y\n\n1、引言 .... 3  \n2、方法 .... 5  \n3、结果 .... 9\n\n第一行\n第二行\n> q\n---\n![a](b.png)")
    for piece in ("<h1>标题</h1>", "<strong>加粗</strong>", "<code>代码</code>", "<th>A</th>", "<td>2</td>", "<pre><code>fn main() {}</code></pre>", "<ul>", "<li>y</li>", "<p>第一行 第二行</p>", "<blockquote>q</blockquote>", "<hr/>", '<img alt="a" src="b.png"/>'):
        assert piece in html
    assert html.count("<br>") == 2
    assert export.render("") == "" and export.render(None) is None and "<pre>" in export.render("```\nopen")


def test_notes(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", None), ("c", "z")], "name string, body string")
    assert [(r.name, r.n_replaced, r.replaced) for r in notes.find_and_replace(df, "x", "w").collect()] == [("a", 2, "w y w")]
    with pytest.raises(ValueError):
        notes.find_and_replace(df, "", "w")
    assert notes.select_notes(df, spark.createDataFrame([("a",), ("q",)], "name string")).count() == 1


def test_errors(spark):
    bodies = ['{"error": {"message": "m"}}', '{"error": {"code": "c"}}', '{"error": {"code": 5}, "message": "top"}', '{"error": "e"}', "", "y" * 300]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r.d for r in df.select(T.error_detail(F.col("b")).alias("d")).collect()] == ["m", "c", "top", "e", None, "y" * 200 + "…"]


def test_attempts():
    waits, calls = [], []

    def flaky(_, prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise transport.CallError("llm", "busy", retryable=True)
        return "ok"

    assert transport.ask(flaky, "", "p", "o", lambda r: False, waits.append) == ("ok", None)
    assert waits == [1.0, 2.0]
    assert transport.ask(lambda s, p: "请提供", "", "p", "original", lambda r: "请提供" in r, waits.append) == ("original", None)

    def refused(_, __):
        raise transport.CallError("config", "401")

    assert transport.ask(refused, "", "p", "o", lambda r: False, waits.append) == (None, "config: 401")


def test_translate(spark):
    segs = spark.createDataFrame([(1, 0, "heading", "# A"), (1, 1, "image_caption", "![](x)"), (1, 2, "image_caption", "**Figure** ![](x)")], "doc_id bigint, seg_index int, kind string, content string")
    out = {r.seg_index: (r.translated, r.error) for r in transport.translate(transport.translation_prompts(segs), lambda s, p: "T:" + p[-3:]).collect()}
    assert out[1] == ("![](x)", None) and out[0] == ("T:# A", None) and out[2][0].startswith("T:")


def test_fields_are_asked_again():
    replies = iter([transport.CallError("llm", "busy", True), "no source", "with [段落 1]"])

    def call(_, __):
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert transport.ask_field(call, "", "p", lambda a: "[段落" in a) == "with [段落 1]"


def test_embedding_budget(spark):
    df = spark.createDataFrame([([5, 100, 6],), ([1] * 4,), ([],)], "s array<bigint>")
    assert [r.t for r in df.select(export.embedded(F.col("s"), 3, 20).alias("t")).collect()] == [[True, False, True], [True, True, True, False], []]
