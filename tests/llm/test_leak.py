import random
import re

import numpy as np
import pytest

from lexloom.llm import leak

WORDS = [a + b for a in ("bre", "kol", "mir", "tan", "vus", "zel", "dro", "fip") for b in ("nak", "lom", "sid", "per", "gox", "huv", "wey", "cta")]
HAN = "隧道渡船锯齿灯塔推动凉亭厚实日晷遮暗风箱石碑罗盘坚韧铁砧承载壁炉生动栈桥连接磨坊箭袋庇护城垛"


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + ".") for i in range(12)] + [(100 + i, "".join(rng.choice(HAN) for _ in range(100))) for i in range(6)]
    docs, truth = [], set()
    for d in range(n):
        prose = " ".join(rng.choice(["the", "mean", "of", "heat", "loss", "rose", "after", "second", "round"]) for _ in range(60))
        item_id, item = rng.choice(items)
        han = item_id >= 100
        units = list(item) if han else item.rstrip(".").split(" ")
        share = rng.choice([0.12, 0.45, 0.6, 1.0])
        take = int(len(units) * share)
        at = rng.randint(0, len(units) - take)
        part = units[at : at + take]
        for k in range(len(part)):
            if rng.random() < 0.04:
                part[k] = rng.choice(HAN if han else WORDS)
        passage = ("" if han else rng.choice([" ", "  ", ", ", "\n"])).join(part)
        docs.append((d, f"{prose}. {passage.upper() if rng.random() < 0.3 else passage} {prose}"))
        if share > 0.3:
            truth.add((d, item_id))
    return items, docs, truth


def test_recall_and_precision_against_planted_passages(spark):
    items, docs, truth = corpus()
    found = leak.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    brute = {(d, i) for d, text in docs[:40] for i, item in items if leak.shared_part(leak.fold(item)[0], leak.fold(text)[0]) >= leak.SHARE}
    assert len(got & truth) >= 0.97 * len(truth)
    got = {(d, i) for d, i in got if d < 40}
    assert got <= brute and len(brute - got) <= 0.03 * len(brute)


def test_walks_bring_near_strings_together():
    rng = random.Random(4)
    text = "".join(rng.choice(WORDS) for _ in range(40))
    a, _ = leak.fold(text)
    b, _ = leak.fold(text[:13] + "q" + text[14:])
    other, _ = leak.fold("".join(rng.choice(WORDS) for _ in range(40)))
    starts = {32: np.array([0])}
    keys = lambda x: {(n, int(k[0])) for _, n, k in leak.walks().keys(x, starts, False)}
    assert keys(a) == keys(a.copy())
    assert len(keys(a)) == leak.WALKS * leak.SAMPLES
    assert len(keys(a) & keys(b)) >= len(keys(a) & keys(other))


def test_one_walk_gives_the_keys_of_all_widths():
    rng = random.Random(5)
    letters, _ = leak.fold("".join(rng.choice(WORDS) for _ in range(400)))
    both = leak.starts_of(letters, {16, 64}, False)
    assert set(both[64]) < set(both[16])
    together = {(w, n): k.tolist() for w, n, k in leak.walks().keys(letters, both, False)}
    for w in both:
        for _, n, k in leak.walks().keys(letters, {w: both[w]}, False):
            assert together[w, n] == k.tolist()


def test_every_run_of_letters_has_an_anchor():
    rng = random.Random(6)
    letters, _ = leak.fold("".join(rng.choice(WORDS) for _ in range(300)))
    for width in (16, 32, 64):
        places = leak.anchors(leak._grams(letters), width)
        assert np.diff(places).max() <= width // 2


@pytest.mark.parametrize("change", [lambda t: " ".join(t), lambda t: t.replace(" ", ""), lambda t: re.sub(r"(\w+) (\w+)", r"\1\2", t), lambda t: re.sub(r"(\w{3})(\w{3})", r"\1- \2", t), str.upper])
def test_spacing_does_not_count(change):
    items, _, _ = corpus()
    known = leak.Items(items)
    prose = "the mean of heat loss rose after second round. "
    found = {(i, known.ids[n]) for i, n, part in known.find([prose + change(t) + prose for _, t in items]) if part >= 0.95}
    assert {(i, k) for i, (k, _) in enumerate(items)} <= found


def test_recall_of_the_shortest_passages():
    """Two fifths of an item, a tenth of its words replaced: against what was planted."""
    rng = random.Random(9)
    items, _, _ = corpus()
    known, texts, truth = leak.Items(items), [], set()
    for n in range(400):
        item_id, item = items[n % 12]
        units = item.split(" ")
        at = rng.randint(0, int(len(units) * 0.6))
        part = [rng.choice(WORDS) if rng.random() < 0.1 else w for w in units[at : at + int(len(units) * 0.4) + 1]]
        texts.append("the second round rose " + " ".join(part) + " after heat loss")
        truth.add((n, item_id))
    assert len({(i, known.ids[m]) for i, m, _ in known.find(texts)} & truth) >= 0.9 * len(truth)


def test_items_in_blocks_give_the_same_pairs(spark):
    items, docs, _ = corpus()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    whole = rows(leak.find_leaks(d, i))
    assert whole and whole == rows(leak.find_leaks(d, i, block_letters=1_500))


def test_nulls_short_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "x" * 200_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, None), (2, "tiny"), (3, " ".join(WORDS[:40]))], "item_id bigint, item_text string")
    assert leak.find_leaks(docs, items).count() == 0
    assert leak.find_leaks(docs.limit(0), items).count() == 0
    assert leak.find_leaks(docs, items.limit(0)).count() == 0


def test_part_in_one_passage():
    part = lambda a, b: leak.shared_part(leak.fold(a)[0], leak.fold(b)[0])
    assert part("abcdefghij", "abcdefghij") == 1.0
    assert part("abcdefghij", "xyz cd-efg zzz") == 0.5
    assert part("abcdefghij", "abcdeXfghij") == 1.0
    assert part("abcdefghij", "klmnop") == 0.0


def test_short_items_are_sought_as_they_stand(spark):
    docs = [(1, "Before it, the answer is: Seven Lamps! And after."), (2, "Qux."), (3, "He wrote 隧道渡船 there."), (4, "quxes and seven lanterns"), (5, "the end is qux")]
    items = [(1, "seven lamps"), (2, "qux"), (3, "隧道渡船"), (4, "?!")]
    found = leak.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, item_text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect() if r.shared == 1.0}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 2)}


def test_pairs_depend_on_no_other_document():
    items, docs, _ = corpus()
    known = leak.Items(items)
    texts = [text for _, text in docs[:20]]
    assert any(known.find([text]) for text in texts)
    for before in ("one", "one two"):
        for text in texts:
            assert [(m, p) for n, m, p in known.find([before, text]) if n == 1] == [(m, p) for _, m, p in known.find([text])]
