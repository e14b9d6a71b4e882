"""Catalogue and task views: lists, counts, checks, clean-up.

Defined results: repeated rows of a task count once (the latest); times are epoch
milliseconds or ISO text and null where unreadable; a task without a document gets
the title 未知文献; counts over nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

READABLE = ("parsed", "translated", "digested")
FINISHED = ("done", "failed")


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """One row a task: the one updated last."""
    rest = [c for c in tasks.columns if c != "id"]
    at = F.coalesce(T.parse_mixed_ts(F.col("updated_at")), T.parse_mixed_ts(F.col("created_at")))
    top = tasks.groupBy("id").agg(F.max(F.struct(at.alias("_at"), *rest)).alias("_t"))
    return top.select("id", *(F.col(f"_t.{c}").alias(c) for c in rest))


def task_list(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """Tasks with titles, ``happened`` being their last time, newest first."""
    titles = documents.select(F.col("id").alias("doc_id"), "title")
    happened = F.coalesce(T.parse_mixed_ts(F.col("updated_at")), T.parse_mixed_ts(F.col("created_at")))
    joined = tasks.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("未知文献"))).withColumn("happened", happened)
    return joined.orderBy(F.desc_nulls_last("happened"), "id")


def task_counts(tasks: DataFrame) -> DataFrame:
    """(status, n), "all" for all."""
    return tasks.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


def durations(tasks: DataFrame) -> DataFrame:
    """(event, ms, status): how long each finished task took."""
    began, ended = T.parse_mixed_ts(F.col("created_at")), T.parse_mixed_ts(F.col("updated_at"))
    ms = F.timestamp_diff("MILLISECOND", began, ended)
    return tasks.select(F.col("type").alias("event"), F.greatest(ms, F.lit(0)).alias("ms"), "status")


def event_stats(events: DataFrame, enabled: bool = True) -> DataFrame:
    """(event, n, total_ms, mean_ms); nothing while recording is off."""
    counted = events.filter(F.lit(enabled)).groupBy("event").agg(F.count("*").alias("n"), F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"))
    return counted.withColumn("mean_ms", F.round(F.col("total_ms") / F.col("n"), 3))


def diagnostics(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: documents, failed tasks, tasks at work."""
    d = documents.agg(F.count("*").alias("n_documents"))
    t = tasks.agg(F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status").isin("running", "queued")).alias("n_active"))
    return d.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")


def interrupted(tasks: DataFrame) -> DataFrame:
    """Tasks after the program ended: what was at work has failed. ``cancelled`` tells
    tasks that were called off from those that failed."""
    broken = F.col("status").isin("running", "queued")
    return tasks.withColumn("cancelled", F.coalesce(F.col("stage") == "已取消", F.lit(False))).withColumn("status", F.when(broken, "failed").otherwise(F.col("status")))


def clear_finished(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)))


def regression(timed: DataFrame, gate: float = 0.95) -> DataFrame:
    """One row: how many finished, how many of them well, mean seconds, and the gate."""
    done = timed.filter(F.col("status").isin(*FINISHED))
    rate = F.when(F.count("*") > 0, F.count_if(F.col("status") == "done") / F.count("*")).otherwise(0.0)
    return done.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.round(rate, 6).alias("rate"), F.round(F.avg(F.col("ms") / 1000), 3).alias("mean_s"), (rate >= gate).alias("passed"))


def document_list(documents: DataFrame) -> DataFrame:
    created = T.parse_mixed_ts(F.col("created_at"))
    return documents.withColumn("created", created).orderBy(F.desc_nulls_last("created"), "doc_id")


def readable(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isin(*READABLE))


def with_read_status(documents: DataFrame, status: str) -> DataFrame:
    """"all", "read" or "unread"; a missing status is unread."""
    return documents if status == "all" else documents.filter(F.coalesce("read_status", F.lit("unread")) == status)


def set_read_status(documents: DataFrame, doc_id: str, status: str) -> DataFrame:
    """Documents with one status changed; ``ValueError`` for an unknown status."""
    if status not in ("read", "unread"):
        raise ValueError(f"a document is read or unread, not {status!r}")
    return documents.withColumn("read_status", F.when(F.col("id") == doc_id, status).otherwise(F.col("read_status")))


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\", ""), r"/+", "/")


def duplicate_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, first_doc): documents whose path an earlier one has."""
    path = canonical_path(F.col("file_path"))
    named = documents.filter("file_path IS NOT NULL").select("doc_id", path.alias("path"))
    first = named.groupBy("path").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")
    return named.join(first, "path").filter("doc_id <> first_doc").select("doc_id", "first_doc")


def check_imports(files: DataFrame, head: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Files (path, and bytes in ``head``) with a ``code``: E-1001 for another kind of file
    and for one that isn't what its name says, E-1003 for one that can't be read (no
    bytes), E-1002 for one whose path a document of ``known`` (file_path) has already, null
    for a good one. Codes are fixed values."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)) != "pdf"
    code = F.when(F.col("path").isNull() | kind, "E-1001")
    if head:
        code = code.when(F.col(head).isNull(), "E-1003").when(F.substring(F.col(head), 1, 5) != F.lit(b"%PDF-"), "E-1001")
    if known is None:
        return files.withColumn("code", code)
    paths = known.filter("file_path IS NOT NULL").select(canonical_path(F.col("file_path")).alias("_p")).distinct().withColumn("_known", F.lit(True))
    joined = files.withColumn("_p", canonical_path(F.col("path"))).join(paths, "_p", "left")
    return joined.withColumn("code", code.when(F.col("_known"), "E-1002")).drop("_p", "_known")


def clear_cache(documents: DataFrame, tasks: DataFrame, versions: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, tasks and versions with what was made of the chosen ones (id) gone."""
    keys = chosen.select("id").distinct()
    marked = documents.join(keys.withColumn("_c", F.lit(True)), "id", "left")
    reset = marked.withColumn("status", F.when(F.col("_c"), "pending").otherwise(F.col("status"))).withColumn("language", F.when(F.col("_c"), F.lit(None)).otherwise(F.col("language"))).drop("_c")
    doc = keys.withColumnRenamed("id", "doc_id")
    return reset, tasks.join(doc, "doc_id", "left_anti"), versions.join(doc, "doc_id", "left_anti")


def paper_language(c: Column) -> Column:
    """中文, 英文 or 其他, by script and function words; 其他 where unsure."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    han = F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))
    kana = F.length(F.regexp_replace(c, r"[^\x{3040}-\x{30ff}]", ""))
    words = F.split(F.lower(c), r"[^\p{L}]+")
    english = F.size(F.filter(words, lambda w: w.isin("the", "of", "and", "to", "was", "were", "for", "in", "that", "with", "is", "than", "by", "at")))
    return F.when((han > 0.4 * letters) & (kana * 20 < letters), "中文").when((english >= 2) & (english * 12 >= F.size(words)), "英文").otherwise("其他")


def mask_configs(configs: DataFrame) -> DataFrame:
    """API configurations without their keys, the default one first."""
    return configs.withColumn("key_ref", T.mask_key(F.col("key_ref"))).orderBy(F.desc("is_default"), "created_at")


def upsert_config(configs: DataFrame, change: DataFrame) -> DataFrame:
    """Configurations with one changed or added; an empty key keeps the old one, and a
    new default takes the place of the old."""
    keys = [c for c in configs.columns if c != "id"]
    new = change.select("id", *(F.col(c).alias(f"_{c}") for c in keys), F.lit(True).alias("_new"))
    joined = configs.join(new, "id", "full_outer")
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keys}
    fresh["key_ref"] = F.coalesce(F.when(F.col("_key_ref") != "", F.col("_key_ref")), F.col("key_ref"))
    takes = change.filter("is_default = 1").select(F.lit(1).alias("_one")).groupBy("_one").count().select(F.lit(1).alias("_k"), F.lit(True).alias("_takes"))
    out = joined.select("id", *(v.alias(c) for c, v in fresh.items()), F.coalesce("_new", F.lit(False)).alias("_new"), F.lit(1).alias("_k")).join(F.broadcast(takes), "_k", "left")
    return out.withColumn("is_default", F.when(F.col("_takes") & ~F.col("_new"), F.lit(0)).otherwise(F.col("is_default"))).drop("_new", "_k", "_takes")


def setting(settings: DataFrame, key: str) -> DataFrame:
    """(value) of a setting; empty where it isn't set."""
    return settings.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit("")).alias("value"))


def vision_config(own: Column, default: Column) -> Column:
    """A configuration of its own where all three parts are set, else the default."""
    whole = lambda c: (T.trim_all(c["base_url"]) != "") & (T.trim_all(c["api_key"]) != "") & (T.trim_all(c["model"]) != "")
    return F.when(F.coalesce(whole(own), F.lit(False)), own).when(default.isNotNull(), default)
