"""Extraction results: versions, fields, failures, markdown.

History is append-only: a new version never changes an old one. Contents are JSON
arrays of fields; old rows lack the error fields, and the oldest have one text only.

Defined results: an unreadable content has no fields; equal versions of a document
count once; a document without versions starts at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

FIELD = "struct<name:string,label:string,ftype:string,source:string,zh:string,en:string,`table`:string,failed:boolean,error_category:string,error_message:string,content:string>"


def parsed(content: Column) -> Column:
    """The fields of a content, in the present shape."""
    fields = F.coalesce(F.from_json(content, f"array<{FIELD}>"), F.array().cast(f"array<{FIELD}>"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(
        F.filter(fields, lambda f: f.isNotNull()),
        lambda f: F.struct(
            f["name"].alias("name"), f["label"].alias("label"), f["ftype"].alias("ftype"), f["source"].alias("source"), F.coalesce(f["zh"], f["content"], F.lit("")).alias("zh"), empty(f["en"]).alias("en"),
            f["table"].alias("table"), F.coalesce(f["failed"], F.lit(False)).alias("failed"), empty(f["error_category"]).alias("error_category"), empty(f["error_message"]).alias("error_message"),
        ),
    )


def once(versions: DataFrame) -> DataFrame:
    """One row for each version of each document: of differing ones always the same."""
    rest = [c for c in versions.columns if c not in ("doc_id", "version")]
    return versions.groupBy("doc_id", "version").agg(F.max(F.struct(*rest)).alias("_v")).select("doc_id", "version", "_v.*")


def fields(versions: DataFrame) -> DataFrame:
    """A row for each field of each version, ``ord`` giving its place."""
    return once(versions).select("doc_id", "version", F.posexplode(parsed(F.col("content"))).alias("ord", "f")).select("doc_id", "version", "ord", "f.*")


def latest(versions: DataFrame) -> DataFrame:
    """The row of each document's highest version."""
    rest = [c for c in versions.columns if c not in ("doc_id", "version")]
    top = versions.groupBy("doc_id").agg(F.max(F.struct("version", *rest)).alias("_v"))
    return top.select("doc_id", "_v.*")


def next_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, next_version)."""
    top = versions.groupBy("doc_id").agg(F.max("version").alias("_v"))
    return documents.join(top, "doc_id", "left").select("doc_id", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version"))


def rollback(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """New rows that repeat the content of ``chosen`` (doc_id, version) versions."""
    old = once(versions).join(chosen, ["doc_id", "version"], "left_semi").select("doc_id", "content")
    numbered = next_versions(old.select("doc_id"), versions)
    return old.join(numbered, "doc_id").select("doc_id", F.col("next_version").alias("version"), F.lit("").alias("field_schema"), "content", F.lit(0.0).alias("score"))


def at_version(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The fields of the chosen (doc_id, version) versions; missing ones give no rows."""
    return fields(versions.join(chosen.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi"))


def save_edits(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """New versions with the contents of ``edits`` (doc_id, content); documents that have
    no version yet get their first."""
    numbered = next_versions(edits.select("doc_id"), versions)
    return edits.join(numbered, "doc_id").select("doc_id", F.col("next_version").alias("version"), F.lit("").alias("field_schema"), "content", F.lit(0.0).alias("score"))


def skipped(failed: Column, zh: Column) -> Column:
    """Whether a field is left out of exports: failed, empty, or without a source."""
    bare = T.trim_all(zh)
    return failed | (bare == "") | (bare == "引用缺失")


def failures(fields: DataFrame) -> DataFrame:
    """(doc_id, n_failed, credential, network, llm, missing): why fields are missing."""
    skip = skipped(F.col("failed"), F.col("zh"))
    label = T.failure_label(F.col("error_category"), F.col("error_message"))
    why = lambda *ls: F.count_if(skip & F.col("failed") & label.isin(*ls))
    counted = fields.groupBy("doc_id").agg(F.count_if(skip).alias("n_skipped"), why("接口鉴权失败").alias("credential"), why("网络不可达").alias("network"), why("模型返回异常").alias("llm"))
    return counted.withColumn("missing", F.col("n_skipped") - F.col("credential") - F.col("network") - F.col("llm"))


def markdown(versions: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, markdown) of the fields that aren't left out."""
    kept = F.filter(parsed(F.col("content")), lambda f: ~skipped(f["failed"], f["zh"]))
    section = lambda f: F.concat(
        F.lit("## "), f["label"], F.lit("\n\n"), F.when(F.coalesce(f["table"], F.lit("")) != "", F.concat(f["table"], F.lit("\n"))).otherwise(""), T.clean_field(f["zh"]), F.lit("\n"),
        F.when(T.clean_field(f["en"]) != "", F.concat(F.lit("\n_English:_ "), T.clean_field(f["en"]), F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    joined = versions.join(titles, "doc_id", "left")
    return joined.select("doc_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.array_join(F.transform(kept, section), "")).alias("markdown"))


_PICKED = ("zh", "text", "content", "term", "definition")
_ITEM = ("term", "text", "item", "label", "definition", "zh")


def value_text(value: Column) -> Column:
    """A JSON value (as text) as words: strings as they are, arrays a line for each
    item, objects by their usual keys."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    string = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]

    def first_of(obj: Column, keys: tuple[str, ...]) -> Column:
        found = [F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(obj), f"$.{k}", "variant")) == "STRING", T.trim_all(F.get_json_object(obj, f"$.{k}"))) for k in keys]
        picked = F.coalesce(*found)
        return F.when(picked != "", picked)

    items = F.from_json(value, "array<string>")
    lines = F.filter(F.transform(items, lambda x: F.when(x.startswith("{"), F.coalesce(first_of(x, _ITEM), x)).otherwise(T.trim_all(x))), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(lines, "\n")
    return F.when(kind == "STRING", string).when(kind.startswith("ARRAY"), F.when(joined != "", joined)).when(kind.startswith("OBJECT"), first_of(value, _PICKED))


def parse_response(raw: Column, ftype: Column) -> Column:
    """A model's answer as struct (zh, en, table); what isn't JSON is the answer itself."""
    bare = T.trim_all(raw)
    cleaned = T.trim_all(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "^(?:```json)+", ""), "^(?:```)+", ""), "(?:```)+$", ""))

    def part(key: str) -> Column:
        inner = F.to_json(F.struct(F.try_variant_get(F.try_parse_json(cleaned), f"$.{key}", "variant").alias("v")))
        # {"v":...} with the value's own JSON inside.
        return F.coalesce(value_text(F.substring(inner, F.lit(6), F.length(inner) - 6)), F.lit(""))

    listed = ftype == "list[string]"
    zh, en = part("zh"), part("en")
    zh, en = F.when(listed, T.normalize_list(zh)).otherwise(zh), F.when(listed, T.normalize_list(en)).otherwise(en)
    told = F.struct(zh.alias("zh"), en.alias("en"), F.when((ftype == "table") & (part("table") != ""), part("table")).alias("table"))
    return F.when(zh != "", told).otherwise(F.struct(bare.alias("zh"), F.lit("").alias("en"), F.lit(None).cast("string").alias("table")))


_TEXT_KEYS = ("zh", "en", "text", "content", "term", "definition", "list")


def json_text(raw: Column) -> Column:
    """The text that a JSON answer carries: an object's first usual key with words, an
    array's items a line each; what is no JSON, or carries none, stays as it is."""
    bare = T.trim_all(raw)
    parsed = F.when(bare.startswith("{") | bare.startswith("["), F.try_parse_json(bare))

    def item(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        texts = [F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", T.trim_all(F.try_variant_get(x, f"$.{k}", "string"))) for k in _ITEM]
        return F.when(kind == "STRING", T.trim_all(F.try_variant_get(x, "$", "string"))).when(kind.startswith("OBJECT"), F.coalesce(*texts, F.to_json(x))).otherwise("")

    def picked(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        lines = F.array_join(F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), item), lambda t: t != ""), "\n")
        text = F.when(kind == "STRING", T.trim_all(F.try_variant_get(x, "$", "string"))).when(kind.startswith("ARRAY"), lines)
        return F.when(text != "", text)

    return F.coalesce(*(picked(F.try_variant_get(parsed, f"$.{k}", "variant")) for k in _TEXT_KEYS), F.when(bare.startswith("["), picked(parsed)), raw)
