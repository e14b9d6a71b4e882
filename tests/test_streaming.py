import json

from pyspark.sql import functions as F

from lexloom.functions import registry
from lexloom.operators import slots
from lexloom.sources import files
from lexloom.streaming import slots as slot_stream
from lexloom.streaming import views


def test_slot_machine():
    events = list(slots.fold([
        ("start", "a", "translate"), ("start", "b", "translate"), ("start", "c", "digest"), ("start", "d", "parse"), ("finish", "a", "translate"),
        ("cancel", "c", "digest"), ("finish", "zzz", "x"), ("start", "e", "parse"), ("start", "f", "digest"), ("cancel", "f", "digest"), ("fail", "e", "parse"),
    ]))
    assert [(t, e) for t, _, e in events] == [
        ("a", "running"), ("b", "refused"), ("c", "queued"), ("d", "refused"), ("a", "done"), ("c", "running"), ("c", "cancelled"), ("e", "running"), ("f", "queued"), ("f", "cancelled"), ("e", "failed"),
    ]


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    source, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    source.mkdir()
    shape = "doc_id string, at bigint, rank int, command string, task string, kind string"

    def run(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(shape).json(str(source))
        q = slot_stream.stream_slots(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()

    row = lambda at, command, task, kind: {"doc_id": "d", "at": at, "rank": 0, "command": command, "task": task, "kind": kind}
    run("1.json", [row(2, "start", "b", "digest"), row(1, "start", "a", "parse")])
    run("2.json", [row(3, "finish", "a", "parse")])
    got = sorted((r.task, r.event) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a", "done"), ("a", "running"), ("b", "queued"), ("b", "running")]


def test_views(spark):
    live = spark.createDataFrame([(1, 0, "old", "snapshot", 5), (1, 0, "new", "event", 1), (1, 1, "", "event", 9), (1, 1, "filled", "snapshot", 1)], "doc_id bigint, seg_index int, text string, source string, seq bigint")
    assert {(r.seg_index, r.text) for r in views.live_segments(live).collect()} == {(0, "new"), (1, "filled")}
    steps = spark.createDataFrame([(1, 1, "run", 1, 4), (1, 2, "run", 3, 4), (2, 1, "run", 1, 2), (2, 2, "done", 2, 2)], "doc_id bigint, seq bigint, stage string, done int, total int")
    assert [(r.doc_id, r.share) for r in views.progress(steps).collect()] == [(1, 0.75)]
    switches = spark.createDataFrame([(1, 1, "pause"), (1, 2, "resume"), (2, 1, "pause")], "doc_id bigint, seq bigint, command string")
    assert {(r.doc_id, r.paused) for r in views.paused(switches).collect()} == {(1, False), (2, True)}
    gate = spark.createDataFrame([("config: 401",), ("network: slow",), (None,)], "e string")
    assert [r.g for r in gate.select(views.credential_gate(F.col("e")).alias("g")).collect()] == [True, False, False]


def test_resume_translates_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "done")
    segs = spark.createDataFrame([(1, 0, "paragraph", "a"), (1, 1, "paragraph", "b")], "doc_id bigint, seg_index int, kind string, content string")
    assert views.resume(segs.filter("seg_index = 0"), path, lambda s, p: p[-1].upper()).count() == 1
    more = segs.unionByName(spark.createDataFrame([(1, 2, "paragraph", "c")], segs.schema))
    got = views.resume(more, path, lambda s, p: p[-1].upper() + "!")
    assert sorted((r.seg_index, r.translated) for r in got.collect()) == [(0, "A"), (1, "B!"), (2, "C!")]
    changed = spark.createDataFrame([(1, 0, "paragraph", "z")], segs.schema)
    assert views.resume(changed, path, lambda s, p: p[-1].upper()).count() == 4


def test_windowed_stats(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 5), ("2024-01-01 00:50:00", "a", 7), ("2024-01-01 01:10:00", "a", 1)], "t string, event string, ms bigint").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.total_ms) for r in views.windowed_stats(e).collect()) == [(1, 1), (2, 12)]


def test_sources(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pdf" / "a.PDF").write_bytes(b"nope")
    found = files.pdf_files(spark, str(tmp_path / "pdf"))
    assert [(r.name, r.code) for r in found.collect()] == [("a.PDF", "E-1001"), ("b.pdf", None)]
    docs = spark.createDataFrame([(found.filter("name = 'b.pdf'").first().path,)], "file_path string")
    assert [r.name for r in files.new_files(found, docs).collect()] == ["a.PDF"]
    (tmp_path / "documents" / "d1" / "parsed").mkdir(parents=True)
    (tmp_path / "documents" / "d1" / "parsed" / "x.md").write_text("# Hi\n\nthere")
    assert [(r.doc_id, r.md) for r in files.markdown_files(spark, str(tmp_path / "documents")).collect()] == [("d1", "# Hi\n\nthere")]
    (tmp_path / "log.txt").write_text("\n".join(f"line {i}" for i in range(50)))
    assert files.log_tail(spark, str(tmp_path / "log.txt"), 3).first().tail == "line 47\nline 48\nline 49"
    maps = spark.createDataFrame([('{"a": "x"}',), ("broken",), (None,)], "j string").select(files.json_map(F.col("j")).alias("m")).collect()
    assert [r.m for r in maps][1:] == [{}, {}] or [r.m for r in maps][0] == {"a": "x"}


def test_registered_functions(spark):
    names = registry.register(spark)
    assert {"lex_trim", "lex_md_to_html", "lex_lines"} <= set(names)
    r = spark.sql("SELECT lex_mask_key('abcdefghij') AS k, lex_direction('x') AS d, lex_escape_html('<a>') AS h, lex_trim('　x ') AS t, lex_md_to_html('# A') AS m").first()
    assert (r.k, r.d, r.h, r.t, r.m) == ("abcdef***", "en_to_zh", "&lt;a&gt;", "x", "<h1>A</h1>")
    assert spark.sql("SELECT * FROM lex_lines('a\n```\nb\n```')").count() == 4
