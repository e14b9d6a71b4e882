"""Live views of running work: segments as they come, progress, switches.

Each view is the latest state per key. Aggregates keep one row a key in the state
store; a watermark bounds them where events carry a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.transport import translate, translation_prompts


def live_segments(events: DataFrame) -> DataFrame:
    """(doc_id, seg_index, text) of a stream (doc_id, seg_index, text, source, seq):
    events overwrite, snapshots fill only what is absent or empty."""
    said = F.coalesce("text", F.lit(""))
    rank = F.struct((said != "").alias("has"), (F.col("source") == "event").alias("event"), F.col("seq").alias("seq"), said.alias("text"))
    best = events.groupBy("doc_id", "seg_index").agg(F.max(rank).alias("b"))
    return best.select("doc_id", "seg_index", F.col("b.text").alias("text"))


def progress(events: DataFrame) -> DataFrame:
    """(doc_id, stage, done, total, share) of a stream (doc_id, seq, stage, done, total);
    documents that are done or have failed are gone. The share counts what was done
    before a restart, too."""
    last = events.groupBy("doc_id").agg(F.max(F.struct("seq", "stage", "done", "total")).alias("e"))
    return last.filter(~F.col("e.stage").isin("done", "failed")).select("doc_id", "e.stage", "e.done", "e.total", (F.col("e.done") / F.greatest(F.col("e.total"), F.lit(1))).alias("share"))


def paused(switches: DataFrame) -> DataFrame:
    """(doc_id, paused) of a stream of switches (doc_id, seq, command)."""
    last = switches.filter(F.col("command").isin("pause", "resume", "cancel")).groupBy("doc_id").agg(F.max(F.struct("seq", "command")).alias("e"))
    return last.select("doc_id", (F.col("e.command") == "pause").alias("paused"))


def windowed_stats(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event, n, total_ms) by window of event time; later events than ``late``
    are no longer counted."""
    timed = events.withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), "event").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms")).select(F.col("w.start").alias("start"), "event", "n", "total_ms")


def resume(segments: DataFrame, path: str, transport: Callable[[str, str], str], direction: str = "en_to_zh") -> DataFrame:
    """Translate the segments that the append-only table at ``path`` lacks, append them,
    and give the table. A row's key is document, index, direction and content, so
    another direction or a changed text is translated anew."""
    spark = segments.sparkSession
    keyed = segments.withColumn("direction", F.lit(direction)).withColumn("digest", F.xxhash64("content"))
    keys = ["doc_id", "seg_index", "direction", "digest"]
    shape = "doc_id bigint, seg_index int, direction string, digest bigint, translated string, error string"
    try:
        done = spark.read.schema(shape).parquet(path)
        todo = keyed.join(done.filter("error IS NULL").select(*keys), keys, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        todo = keyed
    made = translate(translation_prompts(todo, direction), transport)
    written = made.join(todo.select(*keys), ["doc_id", "seg_index"]).select(F.col("doc_id").cast("bigint"), F.col("seg_index").cast("int"), "direction", "digest", "translated", "error")
    written.write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def debounced(events: DataFrame, key: str, at: str, wait_ms: int) -> DataFrame:
    """The events that no later event of their key follows within ``wait_ms``: what a
    search box would act on."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    quiet = after.isNull() | (F.timestamp_diff("MILLISECOND", F.col(at), after) >= wait_ms)
    return events.withColumn("_quiet", quiet).filter("_quiet").drop("_quiet")


def poll(stream: DataFrame, view: Callable[[DataFrame, int], None], folder: str, every: str = "1500 milliseconds"):
    """Start a query that looks for new rows of a stream in equal intervals."""
    return stream.writeStream.trigger(processingTime=every).option("checkpointLocation", folder).foreachBatch(merge_into(view)).start()


def merge_into(view: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that skips empty batches."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            view(batch, number)

    return run


def credential_gate(errors: Column) -> Column:
    """Whether a run must stop: an error that every later call would meet too."""
    return F.coalesce(errors.rlike("^(?:config|auth)\\b|401|403|API Key|Unauthorized|invalid_api_key"), F.lit(False))
