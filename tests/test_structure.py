"""Small documents with known structure, and a procedural model on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import structure


def docs(spark, *mds):
    return spark.createDataFrame(list(enumerate(mds)), "doc_id bigint, md string")


def segs(spark, md):
    return [(r.kind, r.content) for r in structure.segments(docs(spark, md)).orderBy("seg_index").collect()]


def test_contents_become_one_segment(spark):
    got = segs(spark, "# 论文标题\n\n1. Introduction .... 3\n2. Methods .... 5\n3. Results .... 9\n\n正文段落内容。")
    toc = [c for k, c in got if k == "toc"]
    assert len(toc) == 1 and toc[0].count("  \n") == 2
    assert ("paragraph", "正文段落内容。") in got
    assert all(k != "toc" for k, _ in segs(spark, "第一行正文。\n第二行正文。\n第三行正文。"))


def test_fences_tables_captions_references(spark):
    md = "a\n```py\n# no heading\n\n| x\n```\n| a | b |\n|---|---|\n![](p.png)\n**Figure 1** x\n## References ##\n[1] One\n## Appendix\nstill a reference\n```\nopen"
    assert [k for k, _ in segs(spark, md)] == ["paragraph", "code", "code", "table", "image_caption", "image_caption", "heading", "reference", "heading", "reference", "code"]


@pytest.mark.parametrize("md", [None, "", " \n\t\n", "\r\n\r\n"])
def test_nothing_to_segment(spark, md):
    assert segs(spark, md) == []


def model(md):
    """Segments by walking the lines once: an independent, procedural formulation."""
    out, run, run_kind, fenced, refs = [], [], None, False, False

    def end():
        nonlocal run, run_kind
        body = "\n".join(run).rstrip()
        if body:
            bare = [x.strip() for x in run]
            hits = sum("...." in x or "…" in x or (len(x) >= 5 and x[-1].isdigit() and (p := x.rstrip("0123456789")) != "" and (p[-1].isspace() or p[-1] in ".…")) for x in bare)
            toc = run_kind == "paragraph" and len(bare) >= 3 and 10 * hits >= 6 * len(bare)
            out.append(("toc", "  \n".join(bare)) if toc else (run_kind, body))
        run, run_kind = [], None

    for line in md.split("\n"):
        t = line.strip()
        if t.startswith("```"):
            if fenced:
                end()
                run, run_kind = [line], "code"
                end()
            else:
                end()
                run, run_kind = [line], "code"
            fenced = not fenced
        elif fenced:
            run.append(line)
        elif t.startswith("#"):
            end()
            run, run_kind = [line], "heading"
            end()
            refs = refs or t.lstrip("#").strip().rstrip("#").strip() in structure.REFERENCE_HEADINGS
        elif not t:
            end()
        elif t.startswith(("![", "**Figure", "**图")):
            end()
            run, run_kind = [line], "image_caption"
            end()
        else:
            kind = "table" if t.startswith(("|", "<table")) else "reference" if refs else "paragraph"
            if run_kind != kind:
                end()
            run_kind = kind
            run.append(line)
    end()
    return out


def test_random_documents_match_the_model(spark):
    rng = random.Random(11)
    pool = ["text one", "  indented", "# Head", "## References", "```", "| a |", "<table>", "", "![](x)", "**图 1** y", "1. A .... 3", "2. B 12345 7", "x … y", "end 12", "  ", "参考文献"]
    mds = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = {}
    for r in structure.segments(docs(spark, *mds)).orderBy("doc_id", "seg_index").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.content))
    for i, md in enumerate(mds):
        assert got.get(i, []) == model(md), md


def test_numbering(spark):
    rows = structure.numbered(docs(spark, "## 1. Introduction\n\nFirst.\n\nSecond.\n\n## 2. Methods\n\nThird.\n\n")).orderBy("ord").collect()
    assert [r.no for r in rows if r.no] == [1, 2, 3]
    assert [r.heading for r in rows if r.heading] == ["1. Introduction", "2. Methods"]


SAMPLE = "# Paper\n\n## 1. Introduction\n\nA one.\n\nA two.\n\n### 1.1 Background\n\nB one.\n\n| t |\n\n> quoted\n\nB two.\n\n### 1.2 Prior work\n\n![](x.png)\n\nC one."


def test_locators(spark):
    d = docs(spark, SAMPLE)
    titles = spark.createDataFrame([(0, "PAPER!")], "doc_id bigint, title string")
    got = [r.locator for r in structure.locators(structure.interactive_blocks(d), titles).orderBy("block").collect() if r.locator]
    assert got == ["1. Introduction · 第 1 段", "1. Introduction · 第 2 段", "1. Introduction › 1.1 Background · 第 3 段", "1. Introduction › 1.1 Background · 第 4 段", "1. Introduction › 1.2 Prior work · 第 5 段"]
    with_title = structure.locators(structure.interactive_blocks(d)).orderBy("block").collect()
    assert with_title[2].locator == "Paper › 1. Introduction · 第 1 段"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("See Fig. 1 and i.e. x. Next one! Then? yes", ["See Fig. 1 and i.e. x.", "Next one!", "Then? yes"]),
        ("首句。次句！$a. B$末句；尾", ["首句。", "次句！", "$a. B$", "末句；", "尾"]),
        ("Cost $5. But ok", ["Cost $5.", "But ok"]),
        ("A. B. C", ["A.", "B.", "C"]),
        ("", []),
    ],
)
def test_block_sentences(spark, text, expected):
    assert spark.range(1).select(structure.sentences_of(F.lit(text)).alias("s")).first().s == expected


def test_contents_and_anchors(spark):
    d = docs(spark, "# A\n```\n# no\n```\n##### too deep\n## B ")
    assert [(r.id, r.level, r.title) for r in structure.contents_table(d).orderBy("id").collect()] == [("toc-0", 1, "A"), ("toc-1", 2, "B")]
    assert structure.with_anchors(d).first().md.startswith('# A <a id="toc-0"></a>\n```\n# no')


def test_citations(spark):
    d = docs(spark, "x [1] y [2,3] z [4-6] w [7](u) [1,2,3,4,5,6,7,8,9]")
    plain = sorted(r.ref for r in structure.citation_edges(d).collect())
    assert plain == [1, 2, 3, 4, 6]
    assert sorted(r.ref for r in structure.citation_edges(d, expand=True).collect()) == [1, 2, 3, 4, 5, 6]


def test_title_and_authors(spark):
    md = "intro\n# A Title\nAnn Lee, University\nBo Li\nBo Li\nhttps://x.y, z\n\nAbstract starts here"
    r = structure.title_and_authors(docs(spark, md)).first()
    assert (r.title, r.authors) == ("A Title", "Ann Lee, Bo Li")
    none = structure.title_and_authors(docs(spark, "no heading at all")).first()
    assert (none.title, none.authors) == (None, None)


def test_keywords(spark):
    mds = docs(spark, "**Keywords:** a, b", "关键词：甲；乙\nKeywords: c", "nothing", "Key words x", "text\r\n \u3000**keywords：\r\n关键词 \r\nA Keywords: no")
    got = {r.doc_id: r.keywords for r in mds.select("doc_id", structure.keywords_line(F.col("md")).alias("keywords")).collect()}
    assert got == {0: "** a, b", 1: "甲；乙", 2: None, 3: "Key words x", 4: "关键词"}


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("一、关键词A [段落 3]；二、关键词B [段落 5]", "关键词A [段落 3]\n关键词B [段落 5]"),
        ("- 人工智能（AI）[段落14]\n- 虚拟现实（VR）[段落14]", "人工智能（AI）[段落14]\n虚拟现实（VR）[段落14]"),
        ("只有一个关键词", "只有一个关键词"),
        ("", ""),
    ],
)
def test_list_text(spark, raw, expected):
    assert spark.range(1).select(T.normalize_list(F.lit(raw)).alias("x")).first().x == expected


@pytest.mark.parametrize(("raw", "expected"), [("2.1 研究方法", "2.1 研究方法"), ("1. 研究问题", "研究问题"), ("（2）研究方法", "研究方法"), ("① x", "x"), ("[3]", "[3]"), ("• y", "y")])
def test_item_markers(spark, raw, expected):
    assert spark.range(1).select(T.strip_item_marker(F.lit(raw)).alias("x")).first().x == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("研究*进展?", "研究进展"), ('a<b>c|d"e', "abcde"), ("路径/穿越\\攻击", "路径穿越攻击"), ("结尾点...", "结尾点"), ("末尾空格   ", "末尾空格"), ("CON", "CON_"), ("com1", "com1_"), ("///", "未命名笔记"), (" ", "未命名笔记")],
)
def test_file_names(spark, raw, expected):
    assert spark.range(1).select(T.sanitize_name(F.lit(raw)).alias("x")).first().x == expected


def test_note_names_and_excerpts(spark):
    row = spark.range(1).select(
        T.note_name(F.lit("T" * 60), F.lit("Yuqi Liu; B"), F.lit(2024), F.lit("08-24")).alias("n"),
        T.note_name(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit("08-24")).alias("m"),
        T.excerpt(F.lit("Line1\nLine2"), F.lit("1. Introduction · 第 3 段"), F.lit("t")).alias("e"),
        T.excerpt(F.lit("Words"), F.lit(" "), F.lit("Some Title")).alias("f"),
        T.normalize_translated(F.lit("toc"), F.lit("1、引言 .... 3\n2、方法 .... 5\n")).alias("t"),
        T.normalize_translated(F.lit("paragraph"), F.lit("一句一换行\n的译文\n应当折叠")).alias("p"),
        T.is_pure_image(F.lit("text ![](x)")).alias("strict"), T.is_pure_image(F.lit("text ![](x)"), strict=False).alias("loose"),
        F.base64(F.lit(b"hello")).alias("b"),
    ).first()
    assert row.n == "08-24-" + "T" * 48 + "…-Yuqi Liu-2024-阅读笔记"
    assert row.m == "08-24-阅读笔记"
    assert row.e == "> Line1\n> Line2\n> —— 1. Introduction · 第 3 段"
    assert row.f == "> Words\n> —— 《Some Title》"
    assert row.t == "1、引言 .... 3  \n2、方法 .... 5"
    assert row.p == "一句一换行 的译文 应当折叠"
    assert (row.strict, row.loose, row.b) == (False, True, "aGVsbG8=")


def test_one_shuffle_carries_all_windows(spark):
    """The newest content is found by document, and every later step keeps that layout."""
    parsed = spark.createDataFrame([(1, "# A\n\nx", None, None)], "doc_id bigint, content string, base_dir string, parsed_at timestamp_ntz")
    plan = structure.segments(structure.newest_contents(parsed))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_markup_of_every_kind_but_code(spark):
    import oracle_tools

    from lexloom.plans import queries

    kinds = queries.QUERIES["segment_kinds"](spark, oracle_tools.DATA).filter("kind <> 'code'").selectExpr("sum(n_segments)").first()[0]
    assert queries.QUERIES["inline_markup_all"](spark, oracle_tools.DATA).count() == kinds
