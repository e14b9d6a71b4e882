"""Translated segments: pairing, resuming, assembling, carrying images forward.

Segments are keyed by (doc_id, seg_index). One document may hold a large part of all
rows, so pairing and deduplication use both columns as their key and spread it over
all partitions; only operators that must keep a document's order gather one document.

Defined results: of repeated rows the one loaded last counts; a missing translation
is empty where pairs are shown and the original where texts are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.structure import sentences_of


def newest(rows: DataFrame) -> DataFrame:
    """(doc_id, seg_index, kind, original, translated, target_lang) loaded last."""
    kept = ("kind", "original", "translated", "target_lang")
    top = rows.groupBy("doc_id", "seg_index").agg(F.max(F.struct("loaded_at", "seg_id", *kept)).alias("_n"))
    return top.select("doc_id", "seg_index", *(F.col(f"_n.{c}").alias(c) for c in kept))


def pair(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """Every segment with its translation; empty where there is none."""
    t = translated.select("doc_id", F.col("seg_index").cast("int").alias("seg_index"), "translated")
    return segments.join(t, ["doc_id", "seg_index"], "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def pending(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments that have no translation yet."""
    keys = done.select("doc_id", F.col("seg_index").cast("int").alias("seg_index"))
    return segments.join(keys, ["doc_id", "seg_index"], "left_anti")


def assemble(rows: DataFrame) -> DataFrame:
    """(doc_id, n_segments, full_text): translations in order, originals where one is
    missing, parted by blank lines."""
    joined = in_order(rows.select("doc_id", "seg_index", F.coalesce("translated", "original").alias("t")))
    return joined.select("doc_id", F.col("n").alias("n_segments"), F.col("text").alias("full_text"))


#: Segments of a document that are joined in one go.
VOLUME = 512


def in_order(rows: DataFrame, between: str = "\n\n") -> DataFrame:
    """(doc_id, n, text): the texts ``t`` of a document by ``seg_index``. Volumes of a
    document are joined first, spread over all partitions, and the volumes after that:
    a document with a large part of all rows is never gathered row by row."""
    volume = F.floor(F.col("seg_index") / VOLUME)
    ordered = F.array_sort(F.collect_list(F.struct("seg_index", F.coalesce("t", F.lit("")).alias("t"), F.col("t").isNotNull().alias("said"))))
    said = lambda a: F.transform(F.filter(a, lambda x: x["said"]), lambda x: x["t"])
    parts = rows.groupBy("doc_id", volume.alias("v")).agg(F.count("*").alias("n"), ordered.alias("a")).select("doc_id", "v", "n", F.array_join(said("a"), between).alias("t"), (F.size(said("a")) > 0).alias("said"))
    volumes = F.array_sort(F.collect_list(F.struct("v", "t", "said")))
    return parts.groupBy("doc_id").agg(F.sum("n").alias("n"), volumes.alias("a")).select("doc_id", "n", F.array_join(said("a"), between).alias("text"))


def readable(rows: DataFrame) -> DataFrame:
    """(doc_id, text): translations that say something, in order."""
    kept = rows.filter(T.trim_all(F.col("translated")) != "")
    return in_order(kept.select("doc_id", "seg_index", F.col("translated").alias("t"))).select("doc_id", "text")


def write_checkpoint(rows: DataFrame) -> DataFrame:
    """(doc_id, checkpoint): a JSON object of index and translation."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("seg_index").cast("string").alias("k"), F.col("translated").alias("v"))))
    return rows.groupBy("doc_id").agg(F.to_json(F.map_from_entries(entries)).alias("checkpoint"))


def read_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """(doc_id, seg_index, translated): keys that are numbers, values that are text."""
    exploded = checkpoints.select("doc_id", F.explode(F.from_json("checkpoint", "map<string,string>")).alias("k", "translated"))
    return exploded.withColumn("seg_index", F.expr("try_cast(k AS INT)")).filter("seg_index IS NOT NULL AND translated IS NOT NULL").select("doc_id", "seg_index", "translated")


def carry_images(segments: DataFrame) -> DataFrame:
    """Segments with ``image``: the image of the latest caption up to here. A caption
    whose image has no path to speak of takes it away again."""
    upto = Window.partitionBy("doc_id").orderBy("seg_index").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when((F.col("kind") == "image_caption") & F.col("content").contains("!["), F.struct(T.first_image(F.col("content")).alias("p")))
    return segments.withColumn("image", F.last(here, ignorenulls=True).over(upto)["p"])


def by_position(rows: DataFrame) -> DataFrame:
    """(doc_id, seg_index, orig_no, trans_no): sentence i with sentence i; where one side
    has more, the surplus goes with the other's last."""
    sized = rows.select("doc_id", "seg_index", F.size(sentences_of(F.col("original"))).alias("n"), F.size(sentences_of(F.coalesce("translated", F.lit("")))).alias("m"))
    both = sized.filter("n > 0 AND m > 0").select("doc_id", "seg_index", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("orig_no"))
    return both.select("doc_id", "seg_index", "orig_no", F.least("orig_no", F.col("m") - 1).alias("trans_no"))


def glossary_prompt(glossary: DataFrame) -> DataFrame:
    """(language, lines): the terms of each direction as lines of a prompt."""
    clean = glossary.filter("term IS NOT NULL AND translation IS NOT NULL").select(F.lower(T.trim_all(F.col("language"))).alias("language"), T.trim_all(F.col("term")).alias("term"), T.trim_all(F.col("translation")).alias("translation")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("term", "translation")))
    return clean.groupBy("language").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["term"], F.lit(" = "), x["translation"])), "\n").alias("lines"))


def live_view(rows: DataFrame) -> DataFrame:
    """(doc_id, seg_index, translated): later loads overwrite, empty ones fill nothing."""
    said = F.coalesce(F.col("translated"), F.lit(""))
    best = F.max(F.struct((said != "").alias("has"), "loaded_at", said.alias("t")))
    return rows.groupBy("doc_id", "seg_index").agg(best.alias("b")).select("doc_id", "seg_index", F.col("b.t").alias("translated"))


def upsert_terms(glossary: DataFrame, changes: DataFrame) -> DataFrame:
    """The glossary with the changes (term, translation): rows of a known term get the
    translation, an unknown term a row of its own with an id made of it. Of several changes
    of a term the greatest translation counts; blank terms and translations are no change."""
    bare = changes.select(T.trim_all(F.col("term")).alias("term"), T.trim_all(F.col("translation")).alias("_new")).filter("term <> '' AND _new <> ''").groupBy("term").agg(F.max("_new").alias("_new"))
    kept = glossary.join(bare, "term", "left").withColumn("translation", F.coalesce("_new", "translation")).select(*glossary.columns)
    fresh = bare.join(glossary.select("term").distinct(), "term", "left_anti")
    made = {"id": F.sha2("term", 256), "term": F.col("term"), "translation": F.col("_new")}
    return kept.unionByName(fresh.select(*(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in glossary.dtypes)))


def delete_terms(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """The glossary without the rows of the terms (term)."""
    return glossary.join(terms.select("term").distinct(), "term", "left_anti")
