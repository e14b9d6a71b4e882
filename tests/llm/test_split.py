import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import split


@pytest.mark.parametrize(("limit", "overlap"), [(50, 0), (50, 10), (30, 29), (7, 3)])
def test_pieces_keep_the_promises(limit, overlap):
    rng = random.Random(limit)
    for _ in range(120):
        text = "".join(rng.choice(["word ", "a", ". ", "\n", "\n\n", "句。", "é", "👩‍🔬", "\r\n", ", "]) for _ in range(rng.randint(0, 200)))
        pieces = split.pieces_of(text, limit, overlap)
        assert all(e - s <= limit for s, e in pieces)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        joined = text[: pieces[0][1]]
        for (s, e), (_, before) in zip(pieces[1:], pieces):
            assert before - s == min(overlap, before)
            joined += text[before:e]
        assert joined == text
        assert (len(pieces) == 1) == (len(text) <= limit)


def test_cuts_fall_on_strong_boundaries():
    text = "A first paragraph that is long enough.\n\nA second paragraph, also long enough to matter."
    (s, e), *_ = split.pieces_of(text, 60, 0)
    assert text[s:e].endswith("\n\n")


def test_no_boundary_at_all():
    pieces = split.pieces_of("x" * 1000, 100, 20)
    assert all(e - s <= 100 for s, e in pieces)
    accent = "e" + "́" * 3
    for s, _ in split.pieces_of(accent * 100, 50, 0)[1:]:
        assert (accent * 100)[s] == "e"


def test_overlaps_begin_at_whole_characters():
    text = "e\u0301" * 300
    for s, e in split.pieces_of(text, 101, 8)[1:]:
        assert text[s] == "e"
    mixed = ("wo\u0301rd " * 9 + "\u0301".join("aeiou") + ". ") * 8
    assert all(not split._glued(mixed)[s] for s, _ in split.pieces_of(mixed, 101, 7)[1:])


def test_items(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 5), (4, "word " * 30), (4, "word " * 30)], "doc_id bigint, content string")
    out = split.split_items(df, "content", F.lit(40), F.lit(5), ("doc_id",)).collect()
    assert {r.doc_id for r in out} == {2, 3, 4}
    assert [r.piece for r in out if r.doc_id == 3] == ["xxxxx"]
    four = sorted(r.piece_no for r in out if r.doc_id == 4)
    assert len(four) % 2 == 0 and four[0] == four[1] == 0
    assert split.split_items(df.limit(0), "content", F.lit(40), F.lit(5), ("doc_id",)).count() == 0
    with pytest.raises(ValueError):
        split.pieces_of("x" * 50, 10, 10)
