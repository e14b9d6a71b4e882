import random

import numpy as np

from lexloom.llm import align

EN = {"heat": "热量", "river": "河流", "sleep": "睡眠", "price": "价格", "water": "水位", "gene": "基因", "tax": "税收", "crop": "作物"}
FRAMES = [("Participants were told nothing about {}.", "参与者没有被告知任何有关{}的信息。"), ("This paper asks how {} changes over time.", "本文探讨{}如何随时间变化。"), ("We regret that the files on {} cannot be shared.", "很遗憾，关于{}的文件无法共享。"), ("No difference was found for {} here.", "{}在这里未发现差异。")]


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out, truth = [], {}
    for i in range(n):
        picks = [(rng.choice(FRAMES), rng.choice(list(EN.items()))) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
        a = [f[0].format(w) for f, (w, _) in picks]
        order = list(range(len(picks)))
        if len(order) == 3 and rng.random() < 0.4:
            rng.shuffle(order)
        b = [picks[j][0][1].format(picks[j][1][1]) for j in order]
        starts_a, starts_b, at = [], {}, 0
        for s in a:
            starts_a.append(at)
            at += len(s) + 1
        at = 0
        for j, s in zip(order, b):
            starts_b[j] = at
            at += len(s)
        truth[i] = {(starts_a[j], starts_b[j]) for j in order}
        out.append((i, i % 7, i, "paragraph", " ".join(a), "".join(b), "zh", "2024-01-01", "2024-01-01"))
    return out, truth


SHAPE = "seg_id bigint, doc_id bigint, seg_index int, kind string, original string, translated string, target_lang string, saved_at string, loaded_at string"
GLOSSARY = "id string, term string, translation string, language string, created_at string"


def test_recovers_planted_pairs(spark):
    data, truth = rows()
    glossary = spark.createDataFrame([("1", "heat", "热量", "en_to_zh", None), ("2", None, "x", None, None)], GLOSSARY)
    got: dict[int, set] = {}
    for r in align.align(spark.createDataFrame(data, SHAPE), glossary).collect():
        got.setdefault(r.seg_id, set()).add((r.orig_start, r.trans_start))
    right = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    assert right >= 0.9 * sum(map(len, truth.values()))
    assert right >= 0.9 * sum(map(len, got.values()))


def test_nothing_to_align(spark):
    glossary = spark.createDataFrame([], GLOSSARY)
    data = [(1, 1, 1, "paragraph", None, "x", "zh", None, None), (2, 1, 2, "paragraph", "The same of the text.", "The same of the text.", "zh", None, None), (3, 1, 3, "heading", "# A", "# 甲", "zh", None, None)]
    df = spark.createDataFrame(data, SHAPE)
    assert align.align(df, glossary).count() == 0
    assert align.align(df.limit(0), glossary).count() == 0


def test_warping_finds_the_cheapest_path():
    rng = np.random.default_rng(1)
    cost = rng.random((5, 6))

    def best(i, j):
        if i == j == 0:
            return cost[0, 0]
        return cost[i, j] + min(best(a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0)

    path = align.warp(cost)
    assert path[0] == (0, 0) and path[-1] == (4, 5)
    assert abs(sum(cost[i, j] for i, j in path) - best(4, 5)) < 1e-9


def test_coarse_to_fine_on_long_texts(monkeypatch):
    monkeypatch.setattr(align, "EXACT_CELLS", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = align.coarse_to_fine(x, np.delete(x, [40, 41], 0))
    assert sum(i == (j if i < 40 else j + 2) for i, j in path) >= 110


def test_procrustes_is_orthogonal_and_exact():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 8))
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    w = align.procrustes(x, x @ q)
    assert np.allclose(w @ w.T, np.eye(8), atol=1e-4) and np.allclose(x @ w, x @ q, atol=1e-3)


def test_vectors_bring_neighbours_together():
    counts = np.zeros((6, 6), np.float32)
    for a, b in ((0, 1), (2, 3), (4, 5)):
        counts[a, b] = counts[b, a] = 50
    counts[0, 4] = counts[4, 0] = counts[1, 5] = counts[5, 1] = 30
    v, outer = align.fit_vectors(counts, 100, 8)
    assert v.shape == outer.shape == (6, 8) and np.isfinite(v).all()
    assert align.fit_vectors(np.zeros((0, 0), np.float32))[0].shape[0] == 0


def test_further_words_come_near_words_with_their_contexts():
    rng = np.random.default_rng(4)
    topics = np.kron(np.eye(4), np.ones((10, 10))) * 20 + rng.poisson(1, (40, 40))
    counts = (topics + topics.T).astype(np.float32)
    inner, outer = align.fit_vectors(counts, 100, 16)
    further = np.stack([rng.poisson(counts[k] / 10) for k in (3, 14, 25, 36)]).astype(np.float32)
    folded = align.fold_vectors(further, outer, counts.sum(0))
    centre = inner.mean(0)
    unit = lambda x: (x - centre) / np.linalg.norm(x - centre, axis=1, keepdims=True)
    assert [int(k) // 10 for k in (unit(folded) @ unit(inner).T).argmax(1)] == [0, 1, 2, 3]
    assert not align.fold_vectors(np.zeros((1, 40), np.float32), outer, counts.sum(0)).any()


def test_rare_words_have_vectors(spark):
    """Ten times as many words as are frequent: each has a vector."""
    rng = random.Random(5)
    common = ["".join(rng.choice("aeiou") + rng.choice("bdfgklmnprst") for _ in range(3)) for _ in range(40)]
    rare = ["".join(rng.choice("aeiou") + rng.choice("bdfgklmnprst") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(["the", "of", *rng.choices(common, k=30), rare[i % 400]]).capitalize() + "." for i in range(1600)]
    data = [(i, t, "参与者没有被告知任何信息。", "en", "zh", [0, len(t)], [0, 13]) for i, t in enumerate(texts)]
    monkey = align.CORE_SHARE
    align.CORE_SHARE = 5e-3
    try:
        space = align.learn(spark.createDataFrame(data, align.CUT), spark.createDataFrame([], GLOSSARY))
    finally:
        align.CORE_SHARE = monkey
    index, vectors, weights, frequent = space._vectors["en"]
    assert frequent < 60 and len(index) > 400 and len(vectors) == len(weights) == len(index)
    assert (np.abs(vectors.astype(int)).sum(1) > 0).all() and vectors.dtype == np.int8


def test_seeds_are_those_of_the_ratio_on_the_driver(spark):
    from lexloom.llm import sentences

    rng = random.Random(8)
    rows = [(float(k), float(k + rng.randint(0, 30)), float(k + rng.randint(0, 30)), 400.0) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "k double, a double, b double, n double")
    got = [r.x for r in df.select(align.log_likelihood(df.k, df.a, df.b, df.n).alias("x")).collect()]
    assert np.allclose(got, [sentences.dunning(*r) for r in rows])


def numbered_texts(n, seed=4):
    rng = random.Random(seed)
    a = [f"Item {rng.randint(1000, 9999)} and {rng.randint(1000, 9999)} rose by {k}." for k in range(n)]
    return a, ["第" + x.split(" ")[1] + "与" + x.split(" ")[3] + "上升" + x.split(" ")[-1][:-1] + "。" for x in a]


def test_blocks_change_nothing(monkeypatch):
    a, b = numbered_texts(130)
    b = b[:40] + b[100:110] + b[41:100] + b[110:]
    held = align.pair_sentences(a, b, ("en", "zh"), align.Space({}))
    monkeypatch.setattr(align, "HELD_CELLS", 1_500)
    assert align.pair_sentences(a, b, ("en", "zh"), align.Space({})) == held
    assert {(100, 40), (105, 45), (39, 39), (129, 128)} <= set(held)


def test_moved_sentences_of_very_long_texts():
    """Sentences that moved by half a text of 2,000 sentences find their partners."""
    a, b = numbered_texts(2_000)
    order = list(range(2_000))
    moved = [200, 201, 777, 1_400]
    for k in moved:
        order.remove(k)
        order.insert((k + 1_000) % 1_990, k)
    got = set(align.pair_sentences(a, [b[k] for k in order], ("en", "zh"), align.Space({})))
    truth = {(k, at) for at, k in enumerate(order)}
    assert {(k, order.index(k)) for k in moved} <= got
    assert len(got & truth) >= 0.99 * len(truth) and len(got - truth) <= 20
