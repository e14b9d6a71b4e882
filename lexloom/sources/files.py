"""Files as tables: PDFs to import, parsed markdown, notes, checkpoints, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import catalog


def pdf_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(path, name, size, modified, code): the PDF files of a folder, any case, with the
    code of what is wrong with each. Without ``content`` no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    checked = catalog.check_imports(named, "content" if content else None)
    return checked.drop("content").orderBy("name")


def new_files(found: DataFrame, imported: DataFrame) -> DataFrame:
    """Files whose path no document has."""
    known = imported.select(catalog.canonical_path(F.col("file_path")).alias("_p")).distinct()
    return found.withColumn("_p", catalog.canonical_path(F.col("path"))).join(known, "_p", "left_anti").drop("_p")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, md): the first markdown file in ``parsed`` of each document's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    named = files.select("path", F.decode("content", "utf-8").alias("md"))
    doc = F.regexp_extract("path", r"/([^/]+)/parsed/[^/]+$", 1)
    first = named.filter(doc != "").groupBy(doc.alias("doc_id")).agg(F.min(F.struct("path", "md")).alias("f"))
    return first.select("doc_id", F.col("f.md").alias("md"))


def json_map(c: Column) -> Column:
    """A JSON object of texts as a map; empty where it is missing or unreadable."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def log_tail(spark: SparkSession, path: str, lines: int = 200, chars: int = 8000) -> DataFrame:
    """(tail): the last lines of a log file, and of those the last letters. Only one
    file's tail is gathered."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    # Every task keeps its own last lines; only those are brought together.
    last = text.orderBy(F.desc("at")).limit(lines)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    return last.agg(joined.alias("all")).select(F.when(F.length("all") > chars, F.col("all").substr(F.length("all") - F.lit(chars) + 1, F.lit(chars))).otherwise(F.col("all")).alias("tail"))


def write_versions(new: DataFrame, path: str) -> None:
    """Append versions; old ones are never touched."""
    new.write.mode("append").parquet(path)


def first_set(*candidates: Column) -> Column:
    """The first candidate that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in candidates))
