import random

import pytest

from lexloom.llm import residue

PROSE = ["The mean of {} rose by {} percent after the second round.", "We measured {} at {} sites between two years.", "This paper asks how {} shapes the harvest over {} years.", "No difference was found for {} in all {} groups."]
THINGS = ["heat loss", "river flow", "sleep quality", "tax burden", "crop yield", "gene activity"]


def corpus():
    rng = random.Random(5)
    prose = lambda n=3: " ".join(rng.choice(PROSE).format(rng.choice(THINGS), rng.randint(2, 90)) for _ in range(n))
    rows = [(i, prose()) for i in range(600)]
    truth = {}
    slots = ["{{ author }}", "[INSERT TITLE HERE]", "<<abstract>>", "${doi}"]
    errors = ["Error 503: Service Unavailable. Try again later.", "404 Not Found\nThe page could not be delivered.", "Access denied. Your session has ended; sign in again."]
    scripts = ["Please enable JavaScript to view this article.", "JavaScript appears to be disabled. The text cannot be displayed without it."]
    fillers = ["Sample text. " * 6, "Dummy sentence for layout only. " * 5]
    for k in range(60):
        for kind, texts in (("placeholder", [f"{rng.choice(slots)}\n{rng.choice(slots)}"]), ("error_page", errors), ("script_notice", scripts), ("filler", fillers)):
            i = len(rows)
            text = rng.choice(texts)
            rows.append((i, text if k % 2 else f"{prose()}\n\n{text}\n\n{prose(1)}"))
            truth[i] = kind
    for _ in range(40):
        rows.append((len(rows), prose() + ' We counted how often pages answered "404 Not Found" in the archive of the study.'))
        rows.append((len(rows), prose() + " Each prompt follows the pattern {{question}}, which the harness fills in later."))
    return rows, truth


def test_planted_residue(spark):
    rows, truth = corpus()
    got: dict = {}
    for r in residue.find_residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.residue)
    right = sum(truth[i] in got.get(i, ()) for i in truth)
    assert right >= 0.9 * len(truth)
    assert sum(i not in truth for i in got) <= 4


def test_whole_records(spark):
    rows, truth = corpus()
    whole = {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.whole}
    assert all(len(dict(rows)[i]) < 250 for i in whole)


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (3, " \n")], [(1, "Only prose of the ordinary kind.")]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert residue.find_residue(df).count() == 0
    assert residue.find_residue(df.limit(0)).count() == 0


def test_passages():
    assert residue.passages("One. Two!\n\nThree") == ["One.", "Two!", "Three"]
    assert residue.passages("{{a}}, By 2003 it rose.") == ["{{a}}", "By 2003 it rose."]
    assert residue.passages("") == []
    assert "4xx" in residue.features("Error 404") and "0" in residue.features("in 2024")


def test_furniture_gives_no_second_kind():
    kinds = len(residue.KINDS)
    at = residue.KINDS.index
    weights = {}
    for word, kind in (("gateway", "error_page"), ("bad", "error_page"), ("menu", "script_notice"), ("help", "script_notice"), ("javascript", "script_notice"), ("enable", "script_notice")):
        weights[word] = tuple(9.0 if i == at(kind) else -9.0 for i in range(kinds))
    weights["bad"] = weights["gateway"] = tuple(12.0 if i == at("error_page") else -9.0 for i in range(kinds))
    scorer = residue.Scorer(weights)
    assert scorer.decide("Bad gateway.\nMenu help")[0] == {"error_page"}
    assert scorer.decide("Bad gateway.\nEnable JavaScript")[0] == {"error_page", "script_notice"}
    assert scorer.decide("Menu help")[0] == {"script_notice"}
    assert scorer.decide("")[0] == set()


def test_copies_change_no_model(spark):
    once = spark.createDataFrame(corpus()[0], "doc_id bigint, text string")
    model = residue.fit(once)
    copied = residue.fit(once.crossJoin(spark.range(40).withColumnRenamed("id", "copy")))
    assert set(copied) == set(model)
    assert all(copied[f] == pytest.approx(w, abs=1e-6) for f, w in model.items())


def test_rare_kind_in_a_large_table(spark):
    notice = "Turn on JavaScript to view this page."
    prose = spark.range(600_000).selectExpr("concat('The mean of case ', id, ' rose by ', id % 90, ' percent after the second round.') AS text")
    weights = residue.fit(prose.union(spark.createDataFrame([(notice,)], "text string")))
    assert residue.Scorer(weights).decide(notice)[0] == {"script_notice"}
