"""Classification of documents by a lexicon, and the plan of fields that follows.

All terms are searched for in one projection: the lexicon is an array literal, so a
document stays one row and nothing is joined or exploded before scores are ranked.
Ranks are taken over arrays inside the row, too.

Defined results: a document that hits nothing has scores of 0 and no basis; ties
keep the lexicon's order; null signals count as empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import lexicons as L
from lexloom.operators.structure import render_numbered


#: The level of the dialogue's fields, after any second paradigm's.
DIALOGUE = 1000


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often it is used later:
    plain projections are merged, and would compute it at every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _terms(*terms: str) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def _hits(hay: Column, terms: tuple[str, ...]) -> Column:
    return T.distinct_hits(hay, list(terms))


def haystacks(signals: DataFrame) -> DataFrame:
    """Signals with the lower-case texts that terms are searched for in."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    heads = F.transform(F.coalesce("headings", F.array().cast("array<string>")), F.lower)
    hay = F.lower(F.concat_ws(" ", empty(F.col("title")), empty(F.col("abstract")), empty(F.col("body_sample")), F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " ")))
    return once(once(signals, "heads", heads), "hay", hay)


def in_headings(terms: tuple[str, ...]) -> Column:
    """The terms that stand in one of the headings."""
    return F.filter(_terms(*terms), lambda t: F.exists("heads", lambda h: F.contains(h, t))) if terms else F.array().cast("array<string>")


def is_empirical() -> Column:
    """The bones of an empirical study: two structure terms, or one and two of statistics."""
    structure = F.size(in_headings(L.STRUCTURE_TERMS))
    return (structure >= 2) | ((structure == 1) & (F.size(_hits(F.col("hay"), L.STATISTICS_TERMS)) >= 2))


def scores(signals: DataFrame, paradigms: tuple[L.Paradigm, ...] = L.PARADIGMS, priors: tuple = L.PRIORS, objects: dict = L.OBJECTS) -> DataFrame:
    """(doc_id, scored): for each paradigm, in order: ord, id, name, section_hit,
    keyword_hit, object_hit, prior, score, keywords found."""
    held = haystacks(signals).withColumn("empirical", is_empirical())
    prior_hits = [F.size(_hits(F.col("hay"), terms)) > 0 for terms, _, _ in priors]
    entries = []
    for i, p in enumerate(paradigms):
        prior = F.lit(0.0)
        for hit, (_, first, second) in zip(prior_hits, priors):
            gain = 0.06 if first == i else 0.03 if second == i else 0.0
            if gain:
                prior = prior + F.when(hit, F.lit(gain)).otherwise(F.lit(0.0))
        if p.sections:
            section = F.least(F.size(in_headings(p.sections)) / 2.0, F.lit(1.0))
        else:
            section = F.when(F.col("empirical"), 0.0).otherwise(1.0)
        found = _hits(F.col("hay"), p.keywords)
        keyword = F.least(F.size(found) / 4.0, F.lit(1.0))
        shown = F.lit(False)
        for what, test in (("tables", F.col("table_count") > 0), ("formulas", F.col("math_symbols") >= 4), ("images", F.col("image_count") > 0)):
            if p.id in objects.get(what, ()):
                shown = shown | test
        thing = F.when(shown, 1.0).otherwise(0.0)
        score = F.when((section > 0) | (keyword > 0), 0.45 * section + 0.40 * keyword + 0.15 * thing + prior).otherwise(0.0)
        entries.append(
            F.struct(
                F.lit(i).alias("ord"), F.lit(p.id).alias("id"), F.lit(p.name).alias("name"), section.alias("section_hit"), keyword.alias("keyword_hit"),
                thing.alias("object_hit"), prior.alias("prior"), score.alias("score"), F.slice(found, 1, 5).alias("found"),
            )
        )
    return held.select("doc_id", "title", "keywords", "hay", F.array(*entries).alias("scored"))


def basis(signals: DataFrame, paradigms: tuple[L.Paradigm, ...] = L.PARADIGMS) -> DataFrame:
    """(doc_id, ord, id, basis): what speaks for each paradigm: sections, up to five
    keywords, its object, the field of study, or the want of empirical sections."""
    held = haystacks(signals).withColumn("empirical", is_empirical())
    sections = {p.id: F.array_join(in_headings(p.sections), ", ") for p in paradigms}
    scored = scores(signals, paradigms).select("doc_id", F.explode("scored").alias("x"))
    found = once(held, "secs", F.create_map(*[v for p in paradigms for v in (F.lit(p.id), sections[p.id])])).select("doc_id", "secs", "empirical")
    joined = scored.join(found, "doc_id")
    label = F.create_map(*[F.lit(v) for p in paradigms for v in (p.id, p.object_label)])[F.col("x.id")]
    sectionless = F.col("x.id").isin(*(p.id for p in paradigms if not p.sections))
    here = F.col("secs")[F.col("x.id")]
    lines = F.array(
        F.when(here != "", F.concat(F.lit("sections: "), here)), F.when(F.size("x.found") > 0, F.concat(F.lit("keywords: "), F.array_join("x.found", ", "))),
        F.when((F.col("x.object_hit") > 0) & (label != ""), F.concat(F.lit("object: "), label)), F.when(F.col("x.prior") > 0, F.lit("field of study")),
        F.when(sectionless & ~F.col("empirical"), F.lit("no empirical sections")),
    )
    return joined.select("doc_id", F.col("x.ord").alias("ord"), F.col("x.id").alias("id"), F.concat_ws("; ", lines).alias("basis"))


def ranked(scored: DataFrame) -> DataFrame:
    """Scores with ``best``, ``rest`` (second paradigms, best first), ``cross_type``,
    ``confidence``, ``review`` and ``fallback``."""
    order = F.array_sort("scored", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ord"] - b["ord"]))
    held = once(scored, "_r", order)
    best = F.get("_r", 0)
    rest = F.filter(F.slice("_r", 2, 1000), lambda x: x["score"] >= 0.15)
    second = F.coalesce(F.get(rest, 0)["score"], F.lit(0.0))
    many = F.size(F.filter("_r", lambda x: x["score"] >= 0.15)) >= 3
    cross = F.when(best["score"] < 0.50, "单学科").when(many, "多学科交叉").when((best["score"] >= 0.75) & (second < 0.25), "单学科").when(second >= 0.25, "双学科交叉").otherwise("单学科")
    told = F.struct(
        best.alias("best"), rest.alias("rest"), cross.alias("cross_type"), F.least(best["score"], F.lit(1.0)).alias("confidence"),
        (best["score"] < 0.50).alias("review"), (best["score"] < 0.50).alias("fallback"),
    )
    return once(held, "_told", told).select("doc_id", "title", "keywords", "hay", "_told.*")


def _ranked_hits(table: tuple[L.Discipline, ...], found: Callable[[L.Discipline], Column]) -> Column:
    """Entries of a table with the terms found, by hits, ties in the table's order; terms
    are searched for once, and no comparator is called."""
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(d.name).alias("name"), F.lit(d.code).alias("code"), F.lit(d.group).alias("group"), found(d).alias("found")) for i, d in enumerate(table)]
    return F.array_sort(F.transform(F.array(*entries), lambda x: F.struct((-F.size(x["found"])).alias("less"), x["ord"].alias("ord"), F.size(x["found"]).alias("hits"), x["name"].alias("name"), x["code"].alias("code"), x["group"].alias("group"), x["found"].alias("found"))))


def disciplines(signals: DataFrame, schemes: dict[str, tuple[L.Discipline, ...]] = L.SCHEMES, weak: tuple[str, ...] = L.WEAK_TERMS) -> DataFrame:
    """(doc_id, scheme, group, code, name, confidence, basis, secondary): under each
    scheme the discipline whose terms are hit most, up to five of the terms, and up to
    three more disciplines with two hits. Weak terms count in title and keywords alone.
    Without a hit the name says so, and group and code are null."""
    held = haystacks(signals)
    narrow = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("keywords", F.lit(""))))
    held = once(held, "narrow", narrow)

    def found(d: L.Discipline) -> Column:
        # Weak terms are looked up apart, but the terms found keep their order.
        return F.filter(_terms(*d.terms), lambda t: F.when(t.isin(*weak), T.has_word(F.col("narrow"), t)).otherwise(T.has_word(F.col("hay"), t)))

    told = F.array(*(F.struct(F.lit(k).alias("scheme"), F.lit(L.UNIDENTIFIED.get(k, "Unidentified")).alias("none"), _ranked_hits(t, found).alias("r")) for k, t in schemes.items()))
    each = held.select("doc_id", F.explode(told).alias("x")).select("doc_id", "x.*")
    best = F.get("r", 0)
    none = best["hits"] == 0
    more = F.slice(F.filter(F.slice("r", 2, 1000), lambda x: x["hits"] >= 2), 1, 3)
    return each.select(
        "doc_id", "scheme", F.when(~none, best["group"]).alias("group"), F.when(~none, best["code"]).alias("code"), F.when(none, F.col("none")).otherwise(best["name"]).alias("name"),
        F.least(best["hits"] / 4.0, F.lit(1.0)).alias("confidence"), F.array_join(F.slice(best["found"], 1, 5), ", ").alias("basis"), F.array_join(F.transform(more, lambda x: x["name"]), ", ").alias("secondary"),
    )


def directions(signals: DataFrame, table: tuple[L.Discipline, ...] = L.DIRECTIONS) -> DataFrame:
    """(doc_id, rank, direction, weight): the three directions hit most, twice at least."""
    held = haystacks(signals)
    order = _ranked_hits(table, lambda d: T.word_hits(F.col("hay"), _terms(*d.terms)))
    top = held.select("doc_id", F.posexplode(F.slice(F.filter(order, lambda x: x["hits"] >= 2), 1, 3)).alias("rank", "x"))
    return top.select("doc_id", "rank", F.col("x.name").alias("direction"), F.least(F.col("x.hits") / 3.0, F.lit(1.0)).alias("weight"))


def _levels(recognised: DataFrame, definitions: tuple[L.FieldDef, ...]) -> DataFrame:
    """Every field of every level that a document has, in order: common ones, the best
    paradigm's, second ones' by weight, and the dialogue's; ``nth`` counts a name's
    occurrences. The fields are a literal of known size, so nothing is joined."""
    shape = "struct<family:string,name:string,label:string,ftype:string,description:string,required:boolean,choices:array<string>>"
    literal = F.from_json(F.lit(_json(definitions)), f"array<{shape}>")
    best = F.col("best.id")
    least = F.when(F.col("cross_type") == "多学科交叉", 0.15).when(F.col("cross_type") == "双学科交叉", 0.25)
    seconds = F.filter("rest", lambda x: F.coalesce(x["score"] >= least, F.lit(False)))
    names = F.create_map(*[F.lit(v) for kv in L.SHORT_NAMES.items() for v in kv])
    of = lambda family: F.filter("_f", lambda f: f["family"] == family)
    tagged = lambda fs, source, level: F.transform(fs, lambda f: f.withField("source", source).withField("level", level))
    held = once(recognised, "_f", literal)
    levels = F.concat(
        tagged(of(F.lit("common")), F.lit("通用"), F.lit(0)),
        tagged(of(best), F.concat(F.lit("主范式·"), names[best]), F.lit(1)),
        F.flatten(F.transform(seconds, lambda s, i: tagged(of(s["id"]), F.concat(F.lit("次范式·"), names[s["id"]]), i + 2))),
        F.when(F.col("cross_type") == "多学科交叉", tagged(of(F.lit("dialogue")), F.lit("交叉对话"), F.lit(DIALOGUE))).otherwise(tagged(F.array().cast(f"array<{shape}>"), F.lit(""), F.lit(0))),
    )
    every = held.select("doc_id", "cross_type", F.posexplode(levels).alias("pos", "x")).select("doc_id", "cross_type", "pos", "x.name", "x.label", "x.ftype", "x.description", "x.required", "x.choices", "x.source", "x.level")
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("pos")))


def field_plan(recognised: DataFrame, fields: tuple[L.FieldDef, ...] = L.FIELDS, near: dict[str, str] = L.NEAR_FIELDS) -> DataFrame:
    """(doc_id, ord, name, label, ftype, description, required, choices, source,
    cross_type, strategy): the fields to fill. A name that an earlier level has is left
    out (see :func:`plan_notes`). Windows are over documents, which are partitioned by
    their id already."""
    kept = _levels(recognised, fields).filter("nth = 1")
    by_doc = Window.partitionBy("doc_id")
    close = F.lit(False)
    for second, first in near.items():
        close = close | ((F.col("name") == second) & F.coalesce(F.min(F.when(F.col("name") == first, F.col("pos"))).over(by_doc) < F.col("pos"), F.lit(False)))
    close = close & F.col("level").between(2, DIALOGUE - 1)
    kept = kept.withColumn("_close", close).withColumn("ord", F.row_number().over(by_doc.orderBy("pos")) - 1)
    strategy = F.when(F.col("cross_type") == "单学科", "通用字段 + 主范式特有字段").when(F.col("cross_type") == "双学科交叉", "通用字段 + 主范式特有字段 + 次范式特有字段").otherwise("通用字段 + 各范式特有字段 + 交叉对话字段")
    return kept.select(
        "doc_id", "ord", "name", F.when(F.col("_close"), F.concat("label", F.lit("（次范式视角）"))).otherwise(F.col("label")).alias("label"), "ftype", "description", "required", "choices",
        F.when(F.col("_close"), F.replace("source", F.lit("次范式·"), F.lit("次范式视角·"))).otherwise(F.col("source")).alias("source"), "cross_type", strategy.alias("strategy"),
    )


def plan_notes(recognised: DataFrame, fields: tuple[L.FieldDef, ...] = L.FIELDS) -> DataFrame:
    """(doc_id, pos, note): a note for each field of a second paradigm that an earlier
    level's field of its name stands for."""
    clash = _levels(recognised, fields).filter((F.col("nth") > 1) & F.col("level").between(2, DIALOGUE - 1))
    return clash.select("doc_id", "pos", F.concat(F.lit("字段「"), "label", F.lit("」同名冲突：采用主范式定义，跳过次范式同名项")).alias("note"))


def _json(definitions: tuple[L.FieldDef, ...]) -> str:
    return json.dumps([{"family": d.family, "name": d.name, "label": d.label, "ftype": d.ftype, "description": d.description, "required": d.required, "choices": d.values} for d in definitions], ensure_ascii=False)


def field_terms(name: Column, label: Column, description: Column) -> Column:
    """What a field is searched by: words of its name and description, pairs of letters
    of its label."""
    words = F.concat(F.split(name, "[^A-Za-z0-9]+"), F.split(F.coalesce(description, F.lit("")), "[^A-Za-z0-9]+"))
    latin = F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 4)
    han = F.regexp_replace(label, r"[\x00-\x{7f}\p{Z}]", "")
    pairs = F.when(F.length(han) >= 2, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substring(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(latin, pairs)))


def relevance(content: Column, terms: Column) -> Column:
    """How many of the terms stand in a segment."""
    low = F.lower(content)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def choose_context(scores: Column, sizes: Column, cap: Column) -> Column:
    """Places (from 0) of the segments that go into a field's context, in reading
    order; ``scores`` and ``sizes`` have an entry for each segment. Segments with hits
    come first, best first, within seven tenths of ``cap``; then the others in reading
    order. What doesn't fit is passed over. Both passes look at each segment once; what
    they gather is bounded by ``cap``."""
    places = F.sequence(F.lit(0), F.size(scores) - 1)
    entries = F.when(F.size(scores) > 0, F.transform(places, lambda i: F.struct((-F.get(scores, i)).alias("less"), i.alias("i"), F.get(sizes, i).alias("size"))))
    empty = F.array().cast("array<int>")

    def fill(queue: Column, state: Column, room: Column) -> Column:
        """Entries of the queue, but those whose place is next in ``done`` (in order)."""
        return F.aggregate(
            queue, state,
            lambda s, e: F.when(F.get(s["done"], s["at"]) == e["i"], s.withField("at", s["at"] + 1))
            .when(s["used"] + e["size"] <= room, F.struct((s["used"] + e["size"]).alias("used"), F.array_append(s["taken"], e["i"]).alias("taken"), s["done"].alias("done"), s["at"].alias("at"))).otherwise(s),
        )

    state = lambda used, done: F.struct(used.alias("used"), empty.alias("taken"), done.alias("done"), F.lit(0).alias("at"))
    hits = fill(F.array_sort(F.filter(entries, lambda e: e["less"] < 0)), state(F.lit(0), empty), F.floor(cap * 7 / 10).cast("int"))
    # Once computed, the first pass is used twice.
    both = F.transform(F.array(hits), lambda h: F.concat(h["taken"], fill(entries, state(h["used"], F.array_sort(h["taken"])), cap)["taken"]))
    return F.coalesce(F.array_sort(F.get(both, 0)), empty)


def field_contexts(plan: DataFrame, numbered: DataFrame, cap: int = 60_000) -> DataFrame:
    """(doc_id, ord, name, label, ftype, n_chosen, context_chars, paragraphs): the
    context of each field. Every segment is scored for all fields of its document where
    it stands; then its text is dropped, and only numbers are gathered and chosen from."""
    terms = plan.select("doc_id", F.struct("ord", "name", "label", "ftype", field_terms(F.col("name"), F.col("label"), F.col("description")).alias("terms")).alias("f"))
    asked = terms.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    sized = numbered.select("doc_id", F.col("ord").alias("seg"), "no", F.length(render_numbered(F.col("no"), F.col("heading"), F.col("content"))).alias("size"), F.lower("content").alias("low"))
    found = F.transform("fields", lambda f: F.size(F.filter(f["terms"], lambda t: F.contains(F.col("low"), t))))
    told = F.transform("fields", lambda f: F.struct(f["ord"].alias("ord"), f["name"].alias("name"), f["label"].alias("label"), f["ftype"].alias("ftype")))
    scored = sized.join(asked, "doc_id").select("doc_id", told.alias("fields"), F.struct("seg", "no", "size", found.alias("scores")).alias("s"))
    # Both sides are laid out by document, and so is what follows: the plan is made once.
    whole = scored.groupBy("doc_id").agg(F.first("fields").alias("fields"), F.array_sort(F.collect_list("s")).alias("segs"))
    numbers = whole.select("doc_id", "fields", F.transform("segs", lambda s: s["size"]).alias("sizes"), F.transform("segs", lambda s: s["no"]).alias("nos"), F.transform("segs", lambda s: s["scores"]).alias("scores"))
    of_field = F.transform("fields", lambda f, i: f.withField("scores", F.transform("scores", lambda s: F.get(s, i))))
    each = numbers.select("doc_id", "sizes", "nos", F.explode(of_field).alias("f")).select("doc_id", "sizes", "nos", "f.*")
    chosen = once(each, "chosen", choose_context(F.col("scores"), F.col("sizes"), F.lit(cap)))
    return chosen.select(
        "doc_id", "ord", "name", "label", "ftype", F.size("chosen").alias("n_chosen"), F.aggregate("chosen", F.lit(0), lambda a, i: a + F.get("sizes", i)).alias("context_chars"),
        F.array_join(F.filter(F.transform("chosen", lambda i: F.get("nos", i).cast("string")), lambda n: n.isNotNull()), ",").alias("paragraphs"),
    )
