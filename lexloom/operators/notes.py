"""Notes: find and replace, excerpts, batches.

Defined results: a note that can't be read (null) is left alone and counts 0; an
empty search is an error; missing names are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import bilinguals


def find_and_replace(notes: DataFrame, search: str, by: str) -> DataFrame:
    """(name, n_replaced, replaced) of the notes (name, body) that hold ``search``."""
    if not search:
        raise ValueError("what shall be replaced?")
    counted = notes.filter("body IS NOT NULL").withColumn("n_replaced", T.occurrences(F.col("body"), search))
    return counted.filter("n_replaced > 0").select("name", "n_replaced", F.replace("body", F.lit(search), F.lit(by)).alias("replaced"))


def append_excerpts(excerpts: DataFrame) -> DataFrame:
    """(doc_id, n, note): all excerpts (doc_id, ord, excerpt) of a document, a rule between,
    joined in volumes first."""
    joined = bilinguals.in_order(excerpts.select("doc_id", F.col("ord").alias("seg_index"), F.col("excerpt").alias("t")), "\n---\n\n")
    return joined.select("doc_id", "n", F.col("text").alias("note"))


def select_notes(notes: DataFrame, names: DataFrame) -> DataFrame:
    """The notes that are named; names without a note are passed over."""
    return notes.join(names.select("name").distinct(), "name", "left_semi")


def list_notes(spark, folder: str) -> DataFrame:
    """(name, updated_at, size) of the markdown files of a folder, newest first; the
    files themselves aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select("path", "modificationTime", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), F.col("modificationTime").alias("updated_at"), F.col("length").alias("size")).orderBy(F.desc("updated_at"), "name")


def save_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The notes (name, body) with the changed ones in place of, or beside, the old; names
    are made fit for files, and of several changes of a name the greatest body counts."""
    new = changes.select(T.sanitize_name(F.col("name")).alias("name"), "body").groupBy("name").agg(F.max("body").alias("body"))
    return delete_notes(notes, new).unionByName(new)


def delete_notes(notes: DataFrame, names: DataFrame) -> DataFrame:
    """The notes but those named; names without a note are passed over."""
    return notes.join(names.select("name").distinct(), "name", "left_anti").select("name", "body")


def rename_notes(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, new_name, error) of renames (name, new_name), one a note: the error tells of a
    note that isn't there, and of a name that another note has (messages are fixed values)."""
    known = notes.select("name").distinct()
    fit = renames.select("name", T.sanitize_name(F.col("name")).alias("_old"), T.sanitize_name(F.col("new_name")).alias("new_name"))
    told = fit.join(known.withColumnRenamed("name", "_old").withColumn("_there", F.lit(True)), "_old", "left").join(known.withColumnRenamed("name", "new_name").withColumn("_taken", F.lit(True)), "new_name", "left")
    error = (
        F.when(F.col("_there").isNull(), F.concat(F.lit("笔记「"), "name", F.lit("」不存在")))
        .when((F.col("_old") != F.col("new_name")) & F.col("_taken"), F.concat(F.lit("已存在同名笔记「"), "new_name", F.lit("」，请换一个名称")))
    )
    return told.select("name", "new_name", error.alias("error"))
