"""Structure of markdown documents: segments, blocks, contents, locators, citations.

Every operator takes documents (doc_id, md), one row each. Lines are numbered by one
``posexplode``, and all further steps are windows over (doc_id, pos): documents that
come out of an aggregation on ``doc_id`` are hash-partitioned by it already, so the
whole chain adds sorts but no shuffle.

Defined results: null contents give no rows, empty ones no segments; an
unterminated fence takes the rest of its document; ties cannot occur, as the
position orders everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Headings after which text is a list of references (fixed values).
REFERENCE_HEADINGS = ["References", "REFERENCES", "Reference", "Bibliography", "BIBLIOGRAPHY", "参考文献", "引用文献"]


def newest_contents(parsed: DataFrame) -> DataFrame:
    """(doc_id, md): the version of each document that was parsed last."""
    newest = parsed.groupBy("doc_id").agg(F.max(F.struct("parsed_at", "content")).alias("_n"))
    return newest.select("doc_id", F.col("_n.content").alias("md"))


def _ordered(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("pos")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos from 1, line, t): the lines, and each without outer space."""
    exploded = docs.select("doc_id", F.posexplode(F.split("md", "\r?\n", -1)).alias("pos", "line"))
    return exploded.select("doc_id", (F.col("pos") + 1).alias("pos"), "line", T.trim_all(F.col("line")).alias("t"))


def in_fence(t: Column) -> Column:
    """Whether a fence is open before the line."""
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(t.startswith("```").cast("int")).over(before), F.lit(0)) % 2 == 1


def classified(docs: DataFrame) -> DataFrame:
    """Lines with their class: open, close, code, heading, table, blank, cap or text."""
    t = F.col("t")
    fenced = lines_of(docs).withColumn("inc", in_fence(t))
    cls = (
        F.when(t.startswith("```"), F.when(F.col("inc"), "close").otherwise("open"))
        .when(F.col("inc"), "code")
        .when(t.startswith("#"), "heading")
        .when(T.starts_any(t, ["|", "<table"]), "table")
        .when(t == "", "blank")
        .when(T.starts_any(t, ["![", "**Figure", "**图"]), "cap")
        .otherwise("text")
    )
    return fenced.withColumn("cls", cls)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_index, kind, content): headings, tables, code, captions,
    contents, references and paragraphs in reading order."""
    t, cls = F.col("t"), F.col("cls")
    titles = "|".join(REFERENCE_HEADINGS)
    opens = (cls == "heading") & t.rlike(rf"^#+{T.SPACE}*(?:{titles}){T.SPACE}*#*$")
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    goes_on = (cls == "code") | (cls.isin("text", "table") & (F.lag(cls).over(_ordered()) == cls))
    marked = (
        classified(docs)
        .withColumn("refs", F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)))
        .withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("grp", F.sum("new").over(upto))
    )
    first = F.min(F.struct("pos", "cls", "refs"))
    joined = (
        marked.filter(cls != "blank").groupBy("doc_id", "grp")
        .agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("pos", "line", "t"))).alias("ls"))
    )
    c = F.col("f.cls")
    kind = F.when(c.isin("open", "close", "code"), "code").when(c == "cap", "image_caption").when(c == "text", F.when(F.col("f.refs") == 1, "reference").otherwise("paragraph")).otherwise(c)
    leaders = F.size(F.filter("ls", lambda x: T.has_leader_or_page(x["t"])))
    toc = (kind == "paragraph") & (F.size("ls") >= 3) & (leaders * 10 >= F.size("ls") * 6)
    content = F.when(toc, F.array_join(F.transform("ls", lambda x: x["t"]), "  \n")).otherwise(T.trim_right(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")))
    shaped = joined.select("doc_id", F.col("f.pos").alias("pos"), F.when(toc, "toc").otherwise(kind).alias("kind"), content.alias("content"))
    return shaped.filter("content <> ''").select("doc_id", (F.row_number().over(_ordered()) - 1).alias("seg_index"), "kind", "content")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, no, heading, content): paragraphs numbered, headings between them."""
    kept = segments(docs).filter(F.col("kind").isin("paragraph", "heading"))
    by = Window.partitionBy("doc_id").orderBy("seg_index")
    para = F.col("kind") == "paragraph"
    no = F.when(para, F.sum(para.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    heading = F.when(~para, T.trim_all(F.regexp_replace("content", "^#+", "")))
    return kept.select("doc_id", (F.row_number().over(by) - 1).alias("ord"), no.alias("no"), heading.alias("heading"), F.when(para, F.col("content")).otherwise("").alias("content"))


def render_numbered(no: Column, heading: Column, content: Column) -> Column:
    """A segment as it stands in a prompt."""
    return F.when(no.isNotNull(), F.concat(F.lit("[段落 "), no.cast("string"), F.lit("]\n"), content, F.lit("\n\n"))).otherwise(F.concat(F.lit("【章节】"), F.coalesce(heading, F.lit("")), F.lit("\n\n")))


def interactive_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, interactive, body): paragraphs to read sentence by sentence, and
    everything that stays whole (a fence is one block; other structure runs together)."""
    t = F.col("t")
    by_line = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line")).withColumn("t", T.trim_all(F.col("line")))
    fenced = by_line.withColumn("inc", in_fence(t))
    held = t.rlike(rf"^#{{1,6}}{T.SPACE}") | T.starts_any(t, ["|", "![", "> "])
    cls = F.when(t.startswith("```"), F.when(F.col("inc"), "code").otherwise("open")).when(F.col("inc"), "code").when(t == "", "blank").when(held, "held").otherwise("body")
    goes_on = (F.col("cls") == "code") | (F.col("cls").isin("held", "body") & (F.lag("cls").over(_ordered()) == F.col("cls")))
    marked = fenced.withColumn("cls", cls).withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    grouped = marked.withColumn("grp", F.sum("new").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))).filter("cls <> 'blank'")
    joined = grouped.groupBy("doc_id", "grp").agg(F.min(F.struct("pos", "cls")).alias("f"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    body = T.trim_all(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    shaped = joined.select("doc_id", F.col("f.pos").alias("pos"), (F.col("f.cls") == "body").alias("interactive"), body.alias("body")).filter("body <> ''")
    return shaped.select("doc_id", (F.row_number().over(_ordered()) - 1).alias("block"), "interactive", "body")


_MATH = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"


def sentences_of(c: Column) -> Column:
    """Sentences of a block: formulas stay whole; Han text is cut at its marks, other
    text after a mark, space and capital."""
    formulas, around = F.regexp_extract_all(c, F.lit(_MATH), F.lit(0)), F.split(c, _MATH, -1)

    def cut(chunk: Column) -> Column:
        bare = T.trim_all(chunk)
        pieces = F.when(bare.rlike(r"[\x{4e00}-\x{9fff}]"), F.split(bare, r"(?<=[。！？；])", -1)).otherwise(F.split(bare, rf"(?<=[.!?]){T.SPACE}+(?=[A-Z])", -1))
        return F.filter(F.transform(pieces, T.trim_all), lambda s: s != "")

    mixed = F.transform(around, lambda chunk, j: F.concat(cut(chunk), F.when(j < F.size(formulas), F.array(F.get(formulas, j))).otherwise(F.array().cast("array<string>"))))
    return F.flatten(mixed)


def block_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, block, sentence_no, sentence) of interactive blocks."""
    return interactive_blocks(docs).filter("interactive").select("doc_id", "block", F.posexplode(sentences_of(F.col("body"))).alias("sentence_no", "sentence"))


def contents_table(docs: DataFrame) -> DataFrame:
    """(doc_id, id, level, title): headings of up to four levels outside fences."""
    t = F.col("t")
    pattern = rf"(?s)^(#{{1,4}}){T.SPACE}+(.*?){T.SPACE}*$"
    heads = lines_of(docs).withColumn("inc", in_fence(t)).filter(~F.col("inc") & ~t.startswith("```") & t.rlike(pattern))
    n = F.row_number().over(_ordered()) - 1
    return heads.select("doc_id", F.concat(F.lit("toc-"), n.cast("string")).alias("id"), F.length(F.regexp_extract(t, pattern, 1)).alias("level"), F.regexp_extract(t, pattern, 2).alias("title"))


def with_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, md): an anchor at the end of every heading of the contents."""
    t = F.col("t")
    by_line = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line")).withColumn("t", T.trim_all(F.col("line"))).withColumn("inc", in_fence(t))
    head = ~F.col("inc") & ~t.startswith("```") & t.rlike(rf"^#{{1,4}}{T.SPACE}+")
    marked = by_line.withColumn("head", head.cast("int")).withColumn("n", F.sum("head").over(_ordered().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    line = F.when(F.col("head") == 1, F.concat("line", F.lit(' <a id="toc-'), F.col("n").cast("string"), F.lit('"></a>'))).otherwise(F.col("line"))
    return marked.withColumn("line", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("md"))


_CITED = r"\[(\d+(?:[\t-\r\x{85}\p{Z},，\-–—]\s*\d+){0,7})\](?!\()"


def citation_edges(docs: DataFrame, expand: bool = False) -> DataFrame:
    """(doc_id, pos, ref): which line cites which reference. ``expand``: a range stands
    for all its numbers, not for its ends alone."""
    bodies = F.regexp_extract_all("line", F.lit(_CITED), F.lit(1))
    cited = lines_of(docs).select("doc_id", "pos", F.explode(bodies).alias("body"))
    if expand:
        ends = F.transform(F.split("body", r"[,，]"), lambda p: F.filter(F.transform(F.split(p, r"[^0-9]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
        numbers = F.flatten(F.transform(ends, lambda e: F.when((F.size(e) == 2) & (F.get(e, 1) >= F.get(e, 0)), F.sequence(F.get(e, 0), F.get(e, 1))).otherwise(e)))
    else:
        numbers = F.filter(F.transform(F.split("body", r"[^0-9]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return cited.select("doc_id", "pos", F.explode(numbers).alias("ref"))


def with_citation_links(docs: DataFrame) -> DataFrame:
    """(doc_id, md): entries of the list of references get anchors, and citations link
    to them; what is a link already stays."""
    t = F.col("t")
    plain = T.trim_all(F.replace(F.regexp_replace(t, rf"^#+{T.SPACE}*", ""), F.lit("**"), F.lit("")))
    named = F.lower(plain).isin(*(h.lower() for h in REFERENCE_HEADINGS))
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    by_line = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line")).withColumn("t", T.trim_all(F.col("line")))
    marked = by_line.withColumn("refs", F.coalesce(F.max(named.cast("int")).over(before), F.lit(0)))
    entry = F.regexp_extract(t, rf"^\[(\d+)\](?:[.:、．]|{T.SPACE}|$)", 1)
    around, bodies = F.split("line", _CITED, -1), F.regexp_extract_all("line", F.lit(_CITED), F.lit(1))
    numbers = lambda b: F.filter(F.split(b, r"[^0-9]+"), lambda n: n != "")
    link = lambda b: F.array_join(F.transform(numbers(b), lambda n: F.concat(F.lit("["), n, F.lit("](#ref-"), n, F.lit(")"))), ", ")
    linked = F.array_join(F.transform(around, lambda p, i: F.when(i < F.size(bodies), F.concat(p, link(F.get(bodies, i)))).otherwise(p)), "")
    line = F.when((F.col("refs") == 1) & (entry != ""), F.concat(F.lit('<a id="ref-'), entry, F.lit('"></a>'), linked)).otherwise(linked)
    held = marked.select("doc_id", "pos", line.alias("line"))
    return held.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("md"))


def locators(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, block, locator) from blocks (doc_id, block, interactive, body): the
    path of headings and the paragraph's number. ``titles`` (doc_id, title): a heading
    that repeats the title is left out of paths."""
    first = F.element_at(F.split("body", "\n", -1), 1)
    level = F.when(~F.col("interactive"), T.heading_level(first))
    entry = blocks.select("doc_id", "block", "interactive", level.alias("level"), F.when(level.isNotNull(), T.strip_inline(first)).alias("head"))
    if titles is not None:
        entry = entry.join(titles, "doc_id", "left").withColumn("head", F.when(F.coalesce(T.same_title(F.col("head"), F.col("title")), F.lit(False)), F.lit("")).otherwise(F.col("head")))
    upto = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    steps = []
    for depth in range(1, 7):
        mine = F.last(F.when(F.col("level") == depth, F.struct("block", "head")), ignorenulls=True).over(upto)
        above = F.max(F.when(F.col("level") < depth, F.col("block"))).over(upto)
        steps.append(F.when((mine["block"] > F.coalesce(above, F.lit(-1))) & (mine["head"] != ""), mine["head"]))
    no = F.sum(F.col("interactive").cast("int")).over(upto)
    path = F.concat_ws(" › ", *steps)
    place = F.concat(F.when(path != "", F.concat(path, F.lit(" · "))).otherwise(""), F.lit("第 "), no.cast("string"), F.lit(" 段"))
    return entry.select("doc_id", "block", F.when(F.col("interactive"), place).otherwise("").alias("locator"))


def excerpt_targets(picks: DataFrame, blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, block, text, locator) of what a reader picks (doc_id, block, sentence_no):
    the sentence, or the whole block where it has no such sentence; blank texts and unknown
    blocks give nothing."""
    placed = blocks.select("doc_id", "block", "body").join(locators(blocks), ["doc_id", "block"])
    joined = picks.join(placed, ["doc_id", "block"]).join(sentences.select("doc_id", "block", "sentence_no", "sentence"), ["doc_id", "block", "sentence_no"], "left")
    return joined.select("doc_id", "block", F.coalesce("sentence", "body").alias("text"), "locator").filter(T.trim_all(F.col("text")) != "")


def title_and_authors(docs: DataFrame) -> DataFrame:
    """(doc_id, title, authors): the first heading, and up to five short lines after it."""
    t = F.col("t")
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    head = t.startswith("#")
    lines = lines_of(docs).withColumn("past", F.max(head.cast("int")).over(upto))
    name = T.trim_all(F.element_at(F.split(t, ",", -1), 1))
    long = (F.col("past") == 1) & ~head & (t != "") & (F.octet_length(t) > 120)
    fits = (F.col("past") == 1) & ~head & (t != "") & (F.octet_length(name) <= 60) & (name != "") & ~name.contains("https://")
    named = lines.select("*", name.alias("name"), long.cast("int").alias("long"), fits.cast("int").alias("fits"))
    named = named.withColumn("stop", F.coalesce(F.max("long").over(before), F.lit(0)) + F.col("long")).withColumn("fits", F.when(F.col("stop") == 0, F.col("fits")).otherwise(0))
    named = named.withColumn("seen", F.coalesce(F.max("fits").over(before), F.lit(0)))
    named = named.withColumn("ended", F.coalesce(F.max(F.when((t == "") & (F.col("seen") == 1), 1)).over(before), F.lit(0)))
    heading = T.trim_all(F.regexp_replace("t", "^#+", ""))
    first = F.min(F.when(head, F.struct("pos", heading.alias("h"))))["h"]
    found = F.array_sort(F.collect_list(F.when((F.col("fits") == 1) & (F.col("ended") == 0), F.struct("pos", "name"))))
    names = F.slice(F.array_distinct(F.transform(found, lambda x: x["name"])), 1, 5)
    grouped = named.groupBy("doc_id").agg(first.alias("h"), names.alias("names"))
    return grouped.select("doc_id", F.when((F.col("h") != "") & (F.octet_length("h") <= 200), F.col("h")).alias("title"), F.when(F.size("names") > 0, F.array_join("names", ", ")).alias("authors"))


def keywords_line(md: Column) -> Column:
    """What the first line of keywords names; null without one."""
    space = r"[\t\x0b-\r\x{85}\p{Z}]"
    lines = F.regexp_extract_all(md, F.lit(rf"(?dim)^{space}*(?:\*\*)*{space}*(?:keywords|关键词|key words)[^\n]*"), F.lit(0))
    bare = F.transform(lines, lambda x: T.trim_all(F.regexp_replace(T.trim_all(x), r"^(?:\*\*)+", "")))
    bodies = F.transform(bare, lambda t: T.trim_all(F.when(t.rlike("[:：]"), F.regexp_replace(t, "(?s)^.*?[:：]", "")).otherwise(t)))
    return F.get(F.filter(bodies, lambda x: (x != "") & (F.octet_length(x) < 400)), 0)


def signals(docs: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, abstract, headings, body_sample, keywords, table_count,
    image_count, math_symbols): what a document shows of its kind. ``titles``
    (doc_id, title) go before the first heading."""
    by = F.array_sort(F.collect_list(F.struct("seg_index", "kind", "content")))
    whole = segments(docs).groupBy("doc_id").agg(by.alias("s"), F.count_if(F.col("kind") == "table").alias("table_count"), F.count_if(F.col("kind") == "image_caption").alias("caps"))
    texts = lambda kind: F.transform(F.filter("s", lambda x: x["kind"] == kind), lambda x: x["content"])
    heads = F.filter(F.transform(texts("heading"), lambda h: T.trim_all(F.regexp_replace(h, "^#+", ""))), lambda h: h != "")
    marks = docs.select("doc_id", T.occurrences(F.col("md"), "![").alias("marks"), T.occurrences(F.col("md"), "$").alias("math_symbols"), keywords_line(F.col("md")).alias("keywords"))
    joined = marks.join(whole, "doc_id", "left")
    if titles is not None:
        joined = joined.join(titles.select("doc_id", F.col("title").alias("given")), "doc_id", "left")
    else:
        joined = joined.withColumn("given", F.lit(None).cast("string"))
    words = F.coalesce("keywords", F.lit(""))
    paragraphs = F.coalesce(texts("paragraph"), F.array().cast("array<string>"))
    headings = F.coalesce(heads, F.array().cast("array<string>"))
    abstract = F.concat(F.array_join(F.slice(paragraphs, 1, 3), " "), F.when(words != "", F.concat(F.lit(" 关键词："), words)).otherwise(""))
    unnamed = F.col("given").isNull() | (T.trim_all(F.col("given")) == "") | (F.col("given") == "未命名")
    title = F.when(unnamed, F.coalesce(F.get(headings, 0), F.lit(""))).otherwise(F.col("given"))
    return joined.select(
        "doc_id", title.alias("title"), abstract.alias("abstract"), headings.alias("headings"), F.substring(F.array_join(F.slice(paragraphs, 1, 14), " "), 1, 6000).alias("body_sample"),
        words.alias("keywords"), F.coalesce("table_count", F.lit(0)).alias("table_count"), F.greatest(F.coalesce("caps", F.lit(0)), F.col("marks").cast("bigint")).alias("image_count"), "math_symbols",
    )
