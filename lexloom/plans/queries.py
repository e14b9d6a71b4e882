"""The queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import bilinguals, catalog, digests, export, lexicons, notes, packed, recognize, slots, structure, transport
from lexloom.session import table
from lexloom.sources import files
from lexloom.streaming import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query; whole numbers come out as BIGINT, as SQL has them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack_fields(table(spark, sf_dir, "documents"), ("doc_id",), ("authors",), ("tags",))


QUERIES["p2_found"] = p2_found


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.newest_contents(table(spark, sf_dir, "parsed_docs"))


@query
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.segments(contents(spark, sf_dir))


@query
def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = structure.segments(contents(spark, sf_dir)).groupBy("kind")
    return kinds.agg(F.count("*").alias("n_segments"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("content")).alias("n_chars"))


@query
def toc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.segments(contents(spark, sf_dir)).filter("kind = 'toc'")
    return found.select("doc_id", "seg_index", F.size(F.split("content", "  \n", -1)).alias("n_lines"))


@query
def numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = structure.numbered(contents(spark, sf_dir))
    return n.select("doc_id", "ord", "no", "heading", structure.render_numbered(F.col("no"), F.col("heading"), F.col("content")).alias("rendered"))


@query
def interactive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.interactive_blocks(contents(spark, sf_dir))


@query
def block_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.block_sentences(contents(spark, sf_dir))


@query
def contents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.contents_table(contents(spark, sf_dir))


@query
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.with_anchors(contents(spark, sf_dir))


@query
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = structure.citation_edges(contents(spark, sf_dir))
    return edges.groupBy("doc_id", "ref").agg(F.count("*").alias("n_cited"), F.min("pos").alias("first_line"))


@query
def locator_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.locators(structure.interactive_blocks(contents(spark, sf_dir)))


@query
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence of every paragraph, quoted with its place."""
    blocks = structure.interactive_blocks(contents(spark, sf_dir))
    first = F.get(structure.sentences_of(F.col("body")), 0)
    placed = structure.locators(blocks).filter("locator <> ''")
    titles = table(spark, sf_dir, "documents").select("doc_id", "title")
    quoted = blocks.filter("interactive").select("doc_id", "block", first.alias("s")).join(placed, ["doc_id", "block"]).join(titles, "doc_id", "left")
    return quoted.select("doc_id", "block", T.excerpt(F.col("s"), F.col("locator"), F.col("title")).alias("excerpt"))


@query
def excerpt_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second sentence of every block, or the block where it has none."""
    docs = contents(spark, sf_dir)
    blocks = structure.interactive_blocks(docs)
    return structure.excerpt_targets(blocks.select("doc_id", "block", F.lit(1).alias("sentence_no")), blocks, structure.block_sentences(docs))


@query
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local images of every document, the first twelve in order of appearance."""
    refs = contents(spark, sf_dir).select("doc_id", F.posexplode(F.slice(T.image_refs(F.col("md")), 1, 12)).alias("ord", "path"))
    return refs


@query
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.segments(contents(spark, sf_dir)).filter("kind = 'image_caption'")
    c = F.col("content")
    return found.select("doc_id", "seg_index", T.first_image(c).alias("path"), T.is_pure_image(c).alias("pure"), T.is_pure_image(c, strict=False).alias("pure_after_image"), T.is_caption(c).alias("captioned"))


@query
def title_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.title_and_authors(contents(spark, sf_dir))


@query
def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = structure.signals(contents(spark, sf_dir), table(spark, sf_dir, "documents"))
    return s.select("doc_id", "title", F.array_join("headings", " | ").alias("headings"), F.length("abstract").alias("abstract_chars"), "body_sample", "keywords", "table_count", "image_count", "math_symbols")


@query
def inline_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and table rows as HTML."""
    kept = structure.segments(contents(spark, sf_dir)).filter(F.col("kind").isin("image_caption", "table"))
    return kept.select("doc_id", "seg_index", T.inline_html(F.col("content")).alias("html"))


@query
def inline_markup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every kind but code as HTML."""
    kept = structure.segments(contents(spark, sf_dir)).filter("kind <> 'code'")
    return kept.select("doc_id", "seg_index", T.inline_html(F.col("content")).alias("html"))


@query
def heading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = structure.segments(contents(spark, sf_dir)).filter("kind = 'heading'")
    return heads.select("doc_id", "seg_index", T.heading_level(F.col("content")).alias("level"), T.strip_inline(F.col("content")).alias("plain"))


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.signals(contents(spark, sf_dir), table(spark, sf_dir, "documents"))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.ranked(recognize.scores(signals_of(spark, sf_dir)))


@query
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct terms of each paradigm stand in a document, as parts and as words."""
    held = recognize.haystacks(signals_of(spark, sf_dir))
    entries = [
        F.struct(F.lit(p.id).alias("id"), F.size(T.distinct_hits(F.col("hay"), list(p.keywords))).alias("parts"), F.size(T.word_hits(F.col("hay"), F.array(*map(F.lit, p.keywords)))).alias("words"))
        for p in lexicons.PARADIGMS
    ]
    return held.select("doc_id", F.explode(F.array(*entries)).alias("x")).select("doc_id", "x.id", "x.parts", "x.words")


@query
def recognise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = recognize.scores(signals_of(spark, sf_dir)).select("doc_id", F.explode("scored").alias("x"))
    r = lambda c: F.round(F.col(f"x.{c}"), 6).alias(c)
    return long.select("doc_id", "x.ord", "x.id", r("section_hit"), r("keyword_hit"), r("object_hit"), r("prior"), r("score"), F.array_join("x.found", ", ").alias("found"))


@query
def recognise_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.basis(signals_of(spark, sf_dir))


@query
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.system_prompts(recognised(spark, sf_dir))


@query
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.with_citation_links(contents(spark, sf_dir))


@query
def recognise_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recognised(spark, sf_dir)
    return r.select("doc_id", F.col("best.id").alias("paradigm"), F.round("confidence", 6).alias("confidence"), "cross_type", "review", F.array_join(F.transform("rest", lambda x: x["id"]), ", ").alias("secondary"))


@query
def disciplines_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the national and the international scheme."""
    return recognize.disciplines(signals_of(spark, sf_dir))


@query
def directions_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.directions(signals_of(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def sample_papers(spark: SparkSession) -> DataFrame:
    """Signals of six papers whose kind of study, discipline and directions are known."""
    return spark.createDataFrame(lexicons.SAMPLE_PAPERS, "doc_id bigint, title string, abstract string, headings array<string>, body_sample string, keywords string, table_count int, image_count int, math_symbols int")


@query
def sample_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sample_papers(spark)
    told = recognize.ranked(recognize.scores(s)).select("doc_id", F.col("best.id").alias("paradigm"), F.round("confidence", 6).alias("confidence"), "cross_type")
    by = recognize.disciplines(s).groupBy("doc_id").agg(*(F.max(F.when(F.col("scheme") == k, F.col("name"))).alias(k) for k in lexicons.SCHEMES))
    to = recognize.directions(s).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "direction"))), lambda x: x["direction"]), ", ").alias("directions"))
    return told.join(by, "doc_id").join(to, "doc_id", "left").withColumn("directions", F.coalesce("directions", F.lit("")))


@query
def field_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.field_plan(recognised(spark, sf_dir)).withColumn("choices", F.array_join("choices", ", "))


@query
def plan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that clash, where every paradigm but the best is a second one and each has a
    field named like a common one."""
    every = recognised(spark, sf_dir).withColumn("rest", F.transform("rest", lambda x: x.withField("score", F.lit(0.5)))).withColumn("cross_type", F.lit("多学科交叉"))
    return recognize.plan_notes(every, lexicons.FIELDS + CLASHING)


#: A field of every paradigm that has a common field's name.
CLASHING = tuple(lexicons.FieldDef(p.id, "source", "来源", "string", "") for p in lexicons.PARADIGMS)


@query
def field_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each field is searched by."""
    rows = [(d.family, d.name, d.label, d.description) for d in lexicons.FIELDS]
    df = spark.createDataFrame(rows, "family string, name string, label string, description string")
    return df.select("family", "name", F.array_join(recognize.field_terms(F.col("name"), F.col("label"), F.col("description")), " ").alias("terms"))


@query
def field_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each planned field, 3,000 letters long at most."""
    docs = contents(spark, sf_dir)
    return recognize.field_contexts(recognize.field_plan(recognised(spark, sf_dir)), structure.numbered(docs), 3000).drop("ord", "ftype")


@query
def field_context_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each planned field, with the full budget."""
    docs = contents(spark, sf_dir)
    return recognize.field_contexts(recognize.field_plan(recognised(spark, sf_dir)), structure.numbered(docs)).drop("ord", "ftype")


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to signals, paradigm, plan, and context of each field, with the full budget."""
    plan = recognize.field_plan(recognised(spark, sf_dir))
    return recognize.field_contexts(plan, structure.numbered(contents(spark, sf_dir))).select("doc_id", "name", "n_chosen", "context_chars")


@query
def digest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fields(table(spark, sf_dir, "digest_versions"))


@query
def latest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digests.latest(table(spark, sf_dir, "digest_versions"))
    return d.select("doc_id", "version", "score")


@query
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.next_versions(table(spark, sf_dir, "documents").select(F.col("id").alias("doc_id")), table(spark, sf_dir, "digest_versions"))


@query
def version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = digests.once(table(spark, sf_dir, "digest_versions"))
    return v.select("doc_id", "version", T.parse_mixed_ts(F.col("created_at")).alias("created"), F.size(digests.parsed(F.col("content"))).alias("n_fields"))


@query
def rollback_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document set back to its first version: a new version with that content."""
    versions = table(spark, sf_dir, "digest_versions")
    first = versions.groupBy("doc_id").agg(F.min("version").alias("version"))
    return digests.rollback(versions, first).select("doc_id", "version", "field_schema", "score", F.length("content").alias("content_chars"))


@query
def failure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.failures(digests.fields(digests.latest(table(spark, sf_dir, "digest_versions"))))


@query
def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = digests.fields(table(spark, sf_dir, "digest_versions")).filter("failed")
    label = T.failure_label(F.col("error_category"), F.col("error_message"))
    return f.groupBy(label.alias("label"), T.is_credential_error(F.col("error_category"), F.col("error_message")).alias("credential")).agg(F.count("*").alias("n"))


@query
def digest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select(F.col("id").alias("doc_id"), "title")
    return digests.markdown(digests.latest(table(spark, sf_dir, "digest_versions")), titles)


@query
def digest_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = digests.fields(table(spark, sf_dir, "digest_versions"))
    return f.groupBy("name", "ftype").agg(F.count("*").alias("n"), F.count_if(T.has_citation(F.col("zh"))).alias("n_cited"), F.count_if(digests.skipped(F.col("failed"), F.col("zh"))).alias("n_skipped"))


@query
def list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put in list form, item by item."""
    f = digests.fields(table(spark, sf_dir, "digest_versions")).filter("zh IS NOT NULL")
    return f.select("doc_id", "version", "name", T.normalize_list(F.col("zh")).alias("items"), T.count_item_markers(F.col("zh")).alias("n_markers"))


@query
def authors_as_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed fields put in list form by the rules for answers."""
    d = table(spark, sf_dir, "documents").filter("authors IS NOT NULL")
    return d.select("doc_id", T.normalize_list(F.concat(F.lit("1. "), F.replace("authors", F.lit(";"), F.lit("; - ")))).alias("items"))


@query
def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their translations; what has none has an empty one."""
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments"))
    segs = structure.segments(contents(spark, sf_dir))
    return bilinguals.pair(segs, b).select("doc_id", "seg_index", "kind", F.length("content").alias("n_original"), "translated")


@query
def pending_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments")).filter("translated IS NOT NULL")
    return bilinguals.pending(structure.segments(contents(spark, sf_dir)), b).groupBy("doc_id", "kind").agg(F.count("*").alias("n_pending"))


@query
def assembled_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments"))
    return bilinguals.assemble(b).select("doc_id", "n_segments", "full_text")


@query
def readable_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinguals.readable(bilinguals.newest(table(spark, sf_dir, "bilingual_segments")))


@query
def checkpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint map written as JSON and read again."""
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments")).filter("translated IS NOT NULL")
    return bilinguals.read_checkpoint(bilinguals.write_checkpoint(b)).select("doc_id", "seg_index", F.length("translated").alias("n_chars"))


@query
def normalized_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments")).filter("translated IS NOT NULL")
    t = F.col("translated")
    return b.select("doc_id", "seg_index", "kind", T.normalize_translated(F.col("kind"), t).alias("normalized"), T.is_meta_reply(t).alias("meta_reply"))


@query
def image_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each segment the image of the last caption before it."""
    return bilinguals.carry_images(structure.segments(contents(spark, sf_dir))).select("doc_id", "seg_index", "image")


@query
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of both sides by position; surplus ones go to the last."""
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments")).filter("kind = 'paragraph'")
    return bilinguals.by_position(b)


@query
def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinguals.glossary_prompt(table(spark, sf_dir, "term_glossary"))


@query
def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events overwrite, snapshots fill gaps: the latest text of each segment."""
    return bilinguals.live_view(table(spark, sf_dir, "bilingual_segments")).select("doc_id", "seg_index", F.length("translated").alias("n_chars"))


@query
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, documents = table(spark, sf_dir, "tasks"), table(spark, sf_dir, "documents")
    return catalog.task_list(catalog.latest_tasks(tasks), documents).select("id", "title", "type", "status", "progress", "stage", "happened")


@query
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.task_counts(catalog.latest_tasks(table(spark, sf_dir, "tasks")))


@query
def task_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.latest_tasks(table(spark, sf_dir, "tasks"))
    return t.select("id", T.parse_mixed_ts(F.col("created_at")).alias("created"), T.parse_mixed_ts(F.col("updated_at")).alias("updated"))


@query
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, total and mean milliseconds of each kind of task."""
    return catalog.event_stats(catalog.durations(catalog.latest_tasks(table(spark, sf_dir, "tasks"))))


@query
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("ms"))
    return catalog.event_stats(e)


@query
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.diagnostics(table(spark, sf_dir, "documents"), catalog.latest_tasks(table(spark, sf_dir, "tasks")))


@query
def tasks_after_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.interrupted(catalog.latest_tasks(table(spark, sf_dir, "tasks")))
    return t.groupBy("status", "cancelled").agg(F.count("*").alias("n"))


@query
def tasks_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clear_finished(catalog.latest_tasks(table(spark, sf_dir, "tasks"))).select("id", "status")


@query
def parse_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.regression(catalog.durations(catalog.latest_tasks(table(spark, sf_dir, "tasks")).filter("type = 'parse'")))


@query
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.document_list(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "title", "status", "read_status", "created")


@query
def unread_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.readable(catalog.with_read_status(table(spark, sf_dir, "documents"), "unread"))
    return d.select("doc_id", "status")


@query
def imported_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose path an earlier document has already: every path also comes again,
    as Windows writes it and with a slash too many."""
    d = table(spark, sf_dir, "documents").select("doc_id", "file_path")
    again = d.select((F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), F.concat(F.lit("\\\\?\\"), F.replace("file_path", F.lit("/"), F.lit("//"))).alias("file_path"))
    return catalog.duplicate_paths(d.unionByName(again))


@query
def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's path as a file to import: as it is, new, damaged, unreadable, and
    of another kind."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("file_path").alias("p"))
    cases = {"again": ("p", "%PDF-1.7"), "new": ("new", "%PDF-1.4"), "damaged": ("new", "%PD"), "unreadable": ("new", None), "other": ("other", "%PDF-1.7")}
    paths = {"p": F.col("p"), "new": F.concat(F.lit("/new"), "p"), "other": F.concat("p", F.lit(".docx"))}
    files = F.array(*(F.struct(F.lit(k).alias("case"), paths[p].alias("path"), F.lit(h).cast("binary").alias("head")) for k, (p, h) in cases.items()))
    checked = catalog.check_imports(d.select(F.explode(files).alias("f")).select("f.*"), "head", table(spark, sf_dir, "documents"))
    return checked.groupBy("case", "code").agg(F.count("*").alias("n"))


@query
def read_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document, by its id, marked as read."""
    d = table(spark, sf_dir, "documents")
    first = d.agg(F.min("id")).first()[0]
    return catalog.set_read_status(d, first, "read").groupBy("read_status").agg(F.count("*").alias("n"))


@query
def config_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations with one changed and one added, which becomes the default; keys masked."""
    shape = "id string, name string, base_url string, model string, params string, key_ref string, is_default bigint, created_at string"
    old = spark.createDataFrame([("a", "one", "http://one", "m1", "{}", "sk-1234567890", 1, "2024-01-01"), ("b", "two", "http://two", "m2", "{}", "short", 0, "2024-01-02")], shape)
    change = spark.createDataFrame([("b", "two too", "http://two", "m2", "{}", "", 0, "2024-01-02"), ("c", "three", "http://three", "m3", "{}", "sk-abcdefghij", 1, "2024-01-03")], shape)
    return catalog.mask_configs(catalog.upsert_config(old, change)).select("id", "name", "key_ref", "is_default")


@query
def coded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed fields' messages with the code of their category."""
    f = digests.fields(table(spark, sf_dir, "digest_versions")).filter("failed")
    return f.select("doc_id", "version", "name", F.concat(F.lit("["), T.category_code(F.col("error_category")), F.lit("] "), "error_message").alias("told"))


@query
def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of tasks told as failed connections, of the kind their words show."""
    t = catalog.latest_tasks(table(spark, sf_dir, "tasks")).filter("error IS NOT NULL")
    kind = F.when(F.lower("error").rlike("time(d )?out|超时"), "timeout").when(F.lower("error").rlike("connect|连接"), "connect").otherwise("other")
    return t.select("id", T.network_error(kind, F.col("error")).alias("e")).select("id", "e.category", "e.message", "e.hint")


@query
def directions_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of glossary terms, with a coded message where none is given."""
    g = table(spark, sf_dir, "term_glossary")
    return g.select("id", "language", T.direction(F.col("language")).alias("direction"), F.when(F.col("language").isNull(), T.coded_error("E-9999", F.col("term"))).alias("error"))


@query
def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of note name, title and id that isn't blank."""
    return table(spark, sf_dir, "documents").select("doc_id", files.first_set(F.col("note_name"), F.col("title"), F.col("id")).alias("name"))


@query
def rescued_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that came as JSON, in five forms, put back into words."""
    f = digests.fields(table(spark, sf_dir, "digest_versions"))
    zh, en = F.col("zh"), F.col("en")
    forms = {
        "plain": zh, "object": F.to_json(F.struct(en.alias("text"), zh.alias("definition"))), "list": F.to_json(F.struct(F.array(zh, en).alias("list"))),
        "items": F.concat(F.lit("["), F.to_json(F.struct(zh.alias("term"))), F.lit(', {"item": " x "}, 7, {"other":1}, "last"]')), "broken": F.concat(F.lit("{"), zh),
    }
    each = f.select("doc_id", "version", "name", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in forms.items()))).alias("x"))
    return each.select("doc_id", "version", "name", "x.form", digests.json_text(F.col("x.raw")).alias("words"))


@query
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model gives them, fenced or plain, for fields of text and of a table."""
    f = digests.fields(table(spark, sf_dir, "digest_versions"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct("zh", "en", F.lit("|a|").alias("table"))), F.lit("\n```"))
    each = f.select("doc_id", "version", "name", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), r.alias("raw"), F.lit(t).alias("ftype")) for k, r in (("fenced", fenced), ("plain", F.col("zh"))) for t in ("text", "table")))).alias("x"))
    return each.select("doc_id", "version", "name", "x.form", "x.ftype", digests.parse_response(F.col("x.raw"), F.col("x.ftype")).alias("a")).select("doc_id", "version", "name", "form", "ftype", "a.zh", "a.en", "a.table")


@query
def vision_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of its own for images where it is whole, else the default."""
    part = "struct<base_url:string,api_key:string,model:string>"
    rows = [(1, ("u", "k", "m"), ("d", "d", "d")), (2, ("u", " ", "m"), ("d", "d", "d")), (3, None, ("d", "d", "d")), (4, ("u", "k", None), None), (5, ("u", "k", "m"), None)]
    df = spark.createDataFrame(rows, f"id bigint, own {part}, fallback {part}")
    return df.select("id", catalog.vision_config(F.col("own"), F.col("fallback"))["model"].alias("model"))


@query
def edited_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's latest content saved as an edit: a new version."""
    versions = table(spark, sf_dir, "digest_versions")
    edits = digests.latest(versions).select("doc_id", F.concat(F.lit(" "), "content").alias("content"))
    return digests.save_edits(versions, edits).select("doc_id", "version", "score", F.length("content").alias("content_chars"))


@query
def first_version_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "digest_versions")
    return digests.at_version(versions, versions.groupBy("doc_id").agg(F.min("version").alias("version"))).select("doc_id", "version", "ord", "name", "zh")


@query
def glossary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with a new translation, names of journals added, terms with spaces deleted."""
    g = table(spark, sf_dir, "term_glossary")
    journals = table(spark, sf_dir, "documents").select(F.col("journal").alias("term"), F.lit("期刊").alias("translation"))
    changed = bilinguals.upsert_terms(g, g.select("term", F.concat("translation", F.lit("！")).alias("translation")).unionByName(journals))
    return bilinguals.delete_terms(changed, g.filter("term LIKE '% %'").select("term")).select("id", "term", "translation")


@query
def renamed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes named by titles; each is to get its journal's name, and titles from nowhere one."""
    d = table(spark, sf_dir, "documents").filter("title IS NOT NULL AND journal IS NOT NULL")
    kept = d.groupBy(T.sanitize_name(F.col("title")).alias("name")).agg(F.max("text").alias("body"))
    renames = d.groupBy("title").agg(F.max("journal").alias("j")).select(F.col("title").alias("name"), F.col("j").alias("new_name"))
    swapped = renames.select(F.col("new_name").alias("name"), F.col("name").alias("new_name")).groupBy("name").agg(F.max("new_name").alias("new_name"))
    return notes.rename_notes(kept, renames.unionByName(swapped))


@query
def quiet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that none follows within an hour."""
    return views.debounced(table(spark, sf_dir, "events"), "user_id", "ts", 3_600_000).select("event_id", "user_id")


@query
def cleared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All translated documents set back to pending, their tasks and versions gone."""
    documents = table(spark, sf_dir, "documents")
    chosen = documents.filter("status = 'translated'").select("id")
    d, t, v = catalog.clear_cache(documents, table(spark, sf_dir, "tasks"), table(spark, sf_dir, "digest_versions"), chosen)
    counted = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return counted(d.filter("status = 'pending'"), "pending").unionByName(counted(t, "tasks")).unionByName(counted(v, "versions"))


@query
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = T.note_name(F.coalesce("title", F.lit("")), F.col("authors"), F.col("year"), F.lit("08-24"))
    return d.select("doc_id", name.alias("note"), T.sanitize_name(name).alias("file_name"), T.shorten_title(F.coalesce("title", F.lit("")), 20).alias("short"))


@query
def masked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.mask_key(F.col("id")).alias("masked"), T.mask_key(F.col("source")).alias("masked_source"), F.regexp_replace(F.base64(F.encode("source", "utf-8")), "\r?\n", "").alias("coded"))


@query
def retitled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first heading repeats their title, but for case and marks."""
    found = structure.title_and_authors(contents(spark, sf_dir)).select("doc_id", F.col("title").alias("head"))
    d = table(spark, sf_dir, "documents").select("doc_id", "title")
    return found.join(d, "doc_id").select("doc_id", F.coalesce(T.same_title(F.col("head"), F.col("title")), F.lit(False)).alias("same"))


@query
def replace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.find_and_replace(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("body")), "the", "THE")
    return found.select("name", "n_replaced", F.length("replaced").alias("n_chars"))


@query
def note_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of each document appended to one note."""
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments")).filter("kind = 'image_caption'")
    return notes.append_excerpts(b.select("doc_id", F.col("seg_index").alias("ord"), F.col("original").alias("excerpt")))


@query
def segment_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each document, of every kind, appended to one note."""
    b = bilinguals.newest(table(spark, sf_dir, "bilingual_segments"))
    return notes.append_excerpts(b.select("doc_id", F.col("seg_index").alias("ord"), F.col("original").alias("excerpt")))


@query
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = export.parts(table(spark, sf_dir, "documents"), contents(spark, sf_dir), bilinguals.assemble(bilinguals.newest(table(spark, sf_dir, "bilingual_segments"))), digests.latest(table(spark, sf_dir, "digest_versions")))
    scopes = F.explode(F.array(*map(F.lit, ("all", "no-original", "bilingual", "translated", "digest"))))
    return parts.select("*", scopes.alias("scope")).select("doc_id", "scope", export.compose_markdown(F.col("scope")).alias("markdown"))


@query
def export_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = export.parts(table(spark, sf_dir, "documents"), contents(spark, sf_dir), bilinguals.assemble(bilinguals.newest(table(spark, sf_dir, "bilingual_segments"))), digests.latest(table(spark, sf_dir, "digest_versions")))
    return export.compose_html(parts, "sepia", "all")


@query
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = structure.segments(contents(spark, sf_dir)).filter("kind = 'table'")
    return tables.select("doc_id", "seg_index", export.table_html(F.col("content")).alias("html"))


@query
def translation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be sent for each pending segment."""
    segs = structure.segments(contents(spark, sf_dir))
    return transport.translation_prompts(segs).select("doc_id", "seg_index", "passthrough", F.length("prompt").alias("n_chars"))


@query
def field_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = recognize.field_plan(recognised(spark, sf_dir))
    return transport.field_prompts(plan).groupBy("doc_id").agg(F.count("*").alias("n_prompts"), F.sum(F.length("prompt")).alias("n_chars"))


@query
def http_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error bodies of every status, told apart."""
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, (400, 401, 403, 404, 429, 500, 503, 418))), (F.col("event_id") % 8 + 1).cast("int")).alias("status"), F.col("props").alias("body"))
    return e.select("event_id", "status", T.retryable(F.col("status")).alias("retryable"), transport.error_code(F.col("status")).alias("code"), T.error_detail(F.col("body")).alias("detail"))


@query
def paper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.length(F.trim("text")) > 0)
    return d.select("doc_id", catalog.paper_language(F.substring("text", 1, 2000)).alias("language"))


@query
def task_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks replayed as commands: one runs and one waits for each document."""
    return slots.replay(slots.commands_of(table(spark, sf_dir, "tasks")))
