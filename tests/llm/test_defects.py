import numpy as np
from test_langid import TEXTS

from lexloom.llm import defects, langid

SHAPE = "seg_id bigint, doc_id bigint, seg_index int, kind string, original string, translated string, target_lang string, saved_at string, loaded_at string"


def test_planted_defects(spark):
    good = [(i, 1, i, "paragraph", f"The mean of heat loss rose by {i} percent, and it was measured at {i + 7} sites in the north.", f"第二轮之后，热损失的均值上升了{i}%，我们在{i + 7}个地点进行了测量。", "zh") for i in range(300)]
    bad, truth = [], {}
    for k in range(12):
        o = f"The value of {k}.5 was taken as the lower bound for the control group of {k + 20} people."
        cases = {
            "empty": [None, "", "  ", "——"][k % 4], "copy": o if k % 2 else "Translation: " + o, "refusal": ["抱歉，我无法翻译这段内容。", "I'm sorry, but I am not able to translate this passage."][k % 2],
            "wrong_language": f"Der Wert {k}.5 diente als Untergrenze für die Größe der Gruppe von {k + 20} Personen.", "truncated": f"我们把{k}.5作为对照组的",
        }
        for defect, t in cases.items():
            seg = 1000 + len(bad)
            truth[seg] = defect
            bad.append((seg, 2, seg, "paragraph", o, t, "zh"))
    df = spark.createDataFrame([(*r, "2024-01-01", "2024-01-01") for r in good + bad], SHAPE)
    prototypes = langid.build_prototypes({k: [v] for k, v in TEXTS.items()})
    got = {r.seg_id: r.defect for r in defects.main_defect(defects.label_pairs(df, prototypes)).collect()}
    right = sum(got.get(s) == d for s, d in truth.items())
    assert right >= 0.9 * len(truth), {s: (d, got.get(s)) for s, d in truth.items() if got.get(s) != d}
    assert sum(s < 1000 for s in got) <= 3


def test_nothing_to_label(spark):
    prototypes = langid.build_prototypes({})
    empty = spark.createDataFrame([], SHAPE)
    assert defects.main_defect(defects.label_pairs(empty, prototypes)).count() == 0
    odd = spark.createDataFrame([(1, 1, 1, "paragraph", None, None, None, None, None), (2, 1, 2, "code", "x", None, "zh", None, None), (3, 1, 3, "paragraph", "a " * 20_000, "甲" * 20_000 + "。", "zh", None, None)], SHAPE)
    got = {r.seg_id: r.defect for r in defects.main_defect(defects.label_pairs(odd, prototypes)).collect()}
    assert got.get(1) == "empty" and 2 not in got


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.05
    right = (0.95, 0.9, 0.8)
    votes = np.stack([np.where(rng.random(5000) < r, truth, ~truth) for r in right], 1).astype(int)
    votes[rng.random(votes.shape) < 0.1] = -1
    counts: dict = {}
    for v in map(tuple, votes):
        counts[v] = counts.get(v, 0) + 1
    model = defects.LabelModel(counts, 0.02)
    halves = ({}, {})
    for i, v in enumerate(map(tuple, votes)):
        halves[i % 2][v] = halves[i % 2].get(v, 0) + 1
    cutoff = defects.validated_cutoff(halves, 0.02)
    assert 0.5 <= cutoff < 1 and defects.validated_cutoff((halves[0], {}), 0.02) == 0.5
    told = np.array([model.posterior(tuple(v)) >= cutoff for v in votes])
    assert abs(model.prior - 0.05) < 0.03
    assert (told & truth).sum() / truth.sum() > 0.6 and (told & truth).sum() / max(1, told.sum()) > 0.8


def test_copies():
    assert defects.copied("Some text here to copy.", "“some TEXT here to copy”") == (1.0, 1.0)
    assert defects.copied("abc", "") == (0.0, 0.0)
    assert max(defects.copied("完全不同的内容在这里", "something else entirely")) < 0.1


def test_stock_counts_different_prompts(spark):
    """Repeated works and phrases translated again and again are no stock; refusals are."""
    rows = [(i, "paragraph", 1, 1) for i in range(5)]
    rows += [(10 + i, "paragraph", 100 + i % 3, 2) for i in range(9)]
    rows += [(20 + i, "paragraph", 200 + i, 3) for i in range(4)]
    keyed = spark.createDataFrame(rows, "seg_id bigint, kind string, _prompt bigint, _key bigint")
    assert [tuple(r) for r in defects.stock_responses(keyed).collect()] == [(3, 4)]


def test_no_defect_hides_another():
    prompt = "Participants were told nothing about it."
    refused = defects.votes("paragraph", prompt, "Sorry, I cannot translate this passage", "zh", (("en", 1.0), ("en", 1.0)), 1.0)
    assert refused["truncated"][:2] == (1, 1) and refused["refusal"][:2] == (1, 1)
    foreign = defects.votes("paragraph", prompt, "Leider kann ich das nicht. Sorry, cannot help", "zh", (("en", 1.0), ("de", 1.0)), 1.0)
    assert foreign["wrong_language"][0] == 1 and foreign["refusal"][0] == 1
    # A prompt that declines may be rendered so.
    told = defects.votes("paragraph", "We cannot provide the data.", "很遗憾，无法提供数据。", "zh", (("en", 1.0), ("zh", 1.0)), 1.0)
    assert told["refusal"][0] == 1 and told["refusal"][-1] == 0
