from lexloom import session
from lexloom.operators import transport

SEGMENT = "doc_id bigint, seg_index int, content string, prompt string, passthrough boolean"


def rows(spark, n=12):
    return spark.createDataFrame([(1, i, f"text {i}", f"prompt {i}", i == 0) for i in range(n)], SEGMENT).coalesce(1)


def test_calls_are_bounded(spark, tmp_path):
    log = str(tmp_path / "calls")

    def slow(system, prompt):
        import time

        with open(log, "a") as f:
            f.write("+\n")
        time.sleep(0.05)
        with open(log, "a") as f:
            f.write("-\n")
        return prompt.upper()

    got = {r.seg_index: (r.translated, r.error) for r in transport.translate(rows(spark), slow, at_once=3).collect()}
    assert got[0] == ("text 0", None) and got[5] == ("PROMPT 5", None) and len(got) == 12
    under, most = 0, 0
    for line in open(log):
        under += 1 if line.startswith("+") else -1
        most = max(most, under)
    assert 2 <= most <= 3


def test_cancelled_and_refused_runs_stop(spark):
    got = transport.translate(rows(spark), lambda s, p: "x", cancelled=lambda: True).collect()
    assert {r.error for r in got if r.seg_index} == {"cancelled"}

    def refuses(system, prompt):
        raise transport.CallError("config", "401 Unauthorized")

    got = [r.error for r in transport.translate(rows(spark, 40), refuses, at_once=1).orderBy("seg_index").collect()]
    assert got[1].startswith("config:") and set(got[2:]) == {"cancelled"}


def test_images_are_described(spark):
    images = spark.createDataFrame([(1, i, f"p{i}", bytes([i])) for i in range(14)] + [(2, 0, "q", None)], "doc_id bigint, ord int, path string, content binary")
    got = {(r.doc_id, r.path): (r.note, r.error) for r in transport.describe_images(images, lambda prompt, data: f"{len(data)} bytes").collect()}
    assert len(got) == transport.DESCRIBED + 1 and got[1, "p3"] == ("1 bytes", None) and (1, "p12") not in got
    assert got[2, "q"][0] is None and transport.describe_images(images.limit(0), lambda p, d: "").count() == 0


def test_written_tables_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    df = session.materialize(spark.range(5))
    (place, files), = session._written
    assert df.count() == 5 and files.exists(place)
    session.release()
    assert not files.exists(place) and not session._written
