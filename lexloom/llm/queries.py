"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import align, defects, encode, langid, leak, ocr, residue, sentences, split
from lexloom.session import materialize, table


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "bilingual_segments"), table(spark, sf_dir, "term_glossary"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("seg_id", "orig_start", "trans_start")


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "bilingual_segments")
    prototypes = langid.fit(segments.filter("kind = 'paragraph'"), "original")
    return defects.label_pairs(segments, prototypes)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.main_defect(p3_labels(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = materialize(ocr.newest(table(spark, sf_dir, "parsed_docs")))
    return ocr.find_noise(contents, ocr.learn(contents))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = materialize(ocr.newest(table(spark, sf_dir, "parsed_docs")))
    return ocr.repair_all(contents, ocr.learn(contents))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "bilingual_segments")
    model = sentences.learn(segments.filter("kind = 'paragraph'"), ("original", "translated"))
    return sentences.split_sides(sentences.latest(segments, ("paragraph",)), model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, parsed = (table(spark, sf_dir, name) for name in ("documents", "parsed_docs"))
    prototypes, residues = langid.fit(documents), residue.fit(documents)
    newest = parsed.groupBy("doc_id").agg(F.max(F.struct("parsed_at", "content")).alias("_n")).select("doc_id", F.col("_n.content").alias("content"))
    whole = langid.wrong_labels(documents, prototypes, residues).select("doc_id", F.lit(0).alias("block_no"), "lang_code")
    return whole.unionByName(langid.foreign_blocks(newest, prototypes).select("doc_id", "block_no", "lang_code"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents), ("doc_id",)).select("doc_id", "lang_code", "confidence")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, name) for name in ("parsed_docs", "segments", "split_limits"))
    return split.split_corpus(*tables)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = p7_pieces(spark, sf_dir).filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 0))
    return cut.select("field", "doc_id", "seg_index")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id", "residue")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p10_found": p10_found,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
}
