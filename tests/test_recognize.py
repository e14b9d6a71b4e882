import pytest
from pyspark.sql import functions as F

from lexloom.operators import lexicons as L
from lexloom.operators import recognize

SHAPE = "doc_id bigint, title string, abstract string, headings array<string>, body_sample string, keywords string, table_count int, image_count int, math_symbols int"


def signals(spark, **kw):
    row = {"doc_id": 1, "title": "", "abstract": "", "headings": [], "body_sample": "", "keywords": "", "table_count": 0, "image_count": 0, "math_symbols": 0} | kw
    return spark.createDataFrame([tuple(row.values())], SHAPE)


def test_experimental_paper(spark):
    s = signals(spark, headings=["Introduction", "Method", "Experiments", "Results", "Conclusion"], body_sample="baseline state-of-the-art ablation benchmark accuracy", table_count=3)
    r = recognize.ranked(recognize.scores(s)).first()
    assert r.best.id == "paradigm-experimental-baseline" and r.confidence >= 0.7


def test_theoretical_paper(spark):
    s = signals(spark, headings=["理性的限度", "回应"], body_sample="we argue a critique of the concept of reason; objection and discourse")
    assert recognize.ranked(recognize.scores(s)).first().best.id == "paradigm-theoretical"


def test_review(spark):
    s = signals(spark, title="元分析", headings=["文献综述", "元分析"], body_sample="纳入标准 排除标准 发表偏倚 森林图 效应量")
    assert recognize.ranked(recognize.scores(s)).first().best.id == "paradigm-systematic-review"


def test_nothing_found_falls_back(spark):
    r = recognize.ranked(recognize.scores(signals(spark, headings=["Method", "Results"]))).first()
    assert r.review and r.cross_type == "单学科"


def recognition(spark, rest, cross):
    entry = "struct<ord:int,id:string,score:double>"
    df = spark.createDataFrame([(1, (0, "paradigm-experimental-baseline", 0.9), rest, cross)], f"doc_id bigint, best {entry}, rest array<{entry}>, cross_type string")
    return recognize.field_plan(df).orderBy("ord").collect()


def test_plans(spark):
    one = recognition(spark, [], "单学科")
    assert len(one) == 19 and "ablation_study" in [r.name for r in one] and all(r.source != "交叉对话" for r in one)
    two = recognition(spark, [(7, "paradigm-design-science", 0.3)], "双学科交叉")
    assert len(two) == 27 and "artifact_description" in [r.name for r in two]
    many = recognition(spark, [(7, "paradigm-design-science", 0.3), (6, "paradigm-computational-sim", 0.2)], "多学科交叉")
    assert {"cross_points", "borrowed_methods"} <= {r.name for r in many}
    near = {r.name: r for r in recognition(spark, [(6, "paradigm-computational-sim", 0.3)], "双学科交叉")}
    assert near["validation_metrics"].label.endswith("（次范式视角）") and near["validation_metrics"].source == "次范式视角·计算模拟型"
    assert len(near) == len(recognition(spark, [(6, "paradigm-computational-sim", 0.3)], "双学科交叉"))
    assert len(recognition(spark, [(6, "paradigm-computational-sim", 0.24)], "双学科交叉")) == 19


def test_field_definitions():
    fields = L.FIELDS
    assert len(fields) == 95 and len({(f.family, f.name) for f in fields}) == 95
    assert next(f for f in fields if f.name == "blinding").values == ("开放", "单盲", "双盲", "三盲", "评估者盲")


@pytest.mark.parametrize(("hay", "term", "expected"), [("state of the art now", "art", True), ("many arts here", "art", True), ("participant", "art", False), ("数字遗产", "遗产", True), ("an f1-score", "f1-score", True)])
def test_words(spark, hay, term, expected):
    from lexloom.functions.text import has_word

    assert spark.range(1).select(has_word(F.lit(hay), F.lit(term)).alias("x")).first().x is expected


def choose(spark, entries, cap):
    df = spark.createDataFrame([([e[1] for e in entries], [e[2] for e in entries], cap)], "s array<int>, n array<int>, cap int")
    return df.select(recognize.choose_context(F.col("s"), F.col("n"), F.col("cap")).alias("c")).first().c


def test_context_skips_what_does_not_fit(spark):
    assert choose(spark, [(0, 3, 50), (1, 2, 60), (2, 1, 15)], 100) == [0, 2]
    assert choose(spark, [(0, 0, 40), (1, 5, 80), (2, 0, 30)], 100) == [0, 2]
    assert choose(spark, [], 100) == []
    assert choose(spark, [(0, 1, 10), (1, 1, 10)], 10) == [0]


def test_context_against_a_greedy_model(spark):
    import random

    rng = random.Random(5)
    cases = [([(i, rng.randint(0, 3), rng.randint(1, 40)) for i in range(rng.randint(0, 9))], rng.randint(10, 120)) for _ in range(80)]
    df = spark.createDataFrame([(i, [x[1] for x in e], [x[2] for x in e], c) for i, (e, c) in enumerate(cases)], "id int, s array<int>, n array<int>, cap int")
    got = {r.id: r.c for r in df.select("id", recognize.choose_context(F.col("s"), F.col("n"), F.col("cap")).alias("c")).collect()}
    for i, (entries, cap) in enumerate(cases):
        used, taken = 0, []
        queue = sorted((e for e in entries if e[1] > 0), key=lambda e: (-e[1], e[0]))
        for room, es in ((cap * 7 // 10, queue), (cap, entries)):
            for o, _, n in es:
                if o not in taken and used + n <= room:
                    used += n
                    taken.append(o)
        assert got[i] == sorted(taken)


def test_full_contexts_are_those_of_the_flagship(spark):
    import oracle_tools

    from lexloom.plans import queries

    full, flagship = (queries.QUERIES[n](spark, oracle_tools.DATA) for n in ("field_context_full", "flagship"))
    assert full.select(*flagship.columns).exceptAll(flagship).count() == 0 and full.count() == flagship.count()
    assert full.selectExpr("max(context_chars)").first()[0] > 3000


def test_no_text_is_carried_once_it_is_scored(spark):
    import oracle_tools

    from lexloom.plans import queries

    plan = queries.QUERIES["flagship"](spark, oracle_tools.DATA)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.split("\n") if "Aggregate [doc_id" in line and "collect_list(s#" in line]
    assert gathered and all("low" not in line and "content" not in line for line in gathered)


def test_sample_papers(spark):
    from lexloom.plans import queries

    got = {r.doc_id: r for r in queries.QUERIES["sample_recognition"](spark, "").collect()}
    kinds = ["experimental-baseline", "theoretical", "empirical-stat", "experimental-baseline", "systematic-review", "design-science"]
    assert [got[i + 1].paradigm for i in range(6)] == [f"paradigm-{k}" for k in kinds]
    assert got[1].confidence >= 0.7 and got[1].cross_type == "单学科" and got[4].confidence > 0.7
    assert got[4].domestic != "新闻传播学"
    assert (got[6].domestic, got[6].international) == ("非物质文化遗产学", "Conservation")
    assert {"数字遗产与非遗数字化", "虚拟现实与沉浸式技术"} <= set(got[6].directions.split(", "))
