import pytest

from lexloom.llm import sentences

CORPUS = (
    ["According to Dr. Zandrox et al., heat loss fell by 3.4 points. Prof. Mirlin called it \"the missing piece.\"", "As Fig. 3 shows, it rose (cf. Sec. 7). Studies should include diaries, etc. We stopped.", "We used ver. 2.1 here, i.e. more than approx. 30 runs.", "Studies should include interviews, diaries, etc."] * 40
    + ["Nach Dr. Tarn u. a. hängt die Größe ab, d. h. schwach. Wir haben es in Vers. 7,1 geprüft (vgl. Kap. 2).", "Künftige Studien sollten Tagebücher usw. einbeziehen. Die Kosten fielen auf 3 Mio. Taler."] * 40
    + ["Le prof. Tarn parle de la chaleur dans les deux groupes. Le prof. Mirlin et les autres le disent aussi."] * 40
    + ["ผู้เข้าร่วมไม่ได้รับแจ้ง เราวัดใน 10 แห่งระหว่างปี 1990 ถึง 1994", "เราวัดใน 20 แห่งระหว่างปี 1991 ถึง 1995 ผู้เข้าร่วมไม่ได้รับแจ้ง"] * 40
)


@pytest.fixture(scope="module")
def model(spark):
    return sentences.learn(spark.createDataFrame([(t, None) for t in CORPUS], "a string, b string"), ("a", "b"))


def cut(text, model):
    return [text[a:b] for a, b in sentences.split(text, model)]


def test_learns_abbreviations(model):
    assert {"dr", "prof", "fig", "sec", "cf", "ver"} <= model.never_last["en"]
    assert "etc" not in model.never_last["en"] and "etc" in model.abbreviations["en"]
    assert {"dr", "vgl", "kap", "mio"} <= model.never_last["de"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("According to Dr. Lee et al., it fell. As Fig. 2 shows, it rose.", 2),
        ("Include diaries, etc. We measured 3.4 points (cf. Sec. 2).", 2),
        ('"We saw no effect. We stopped," wrote Lee in the report. It fell!', 2),
        ('Prof. Lee called it "the missing piece." However, it rose.', 2),
        ("It fell (r = 0.3).However, the price rose.As we saw.", 3),
        ("Only then ... and it changed. Really? Yes!", 3),
        ("One: two; three, four", 1),
        ("(Translator's note: as found.) It fell.", 2),
        ("“我们没有看到效果。我们停止了试验。”某某这样写道。然而……情况改变。（译者注：从原文。）", 3),
        ("某某称之为“缺失的一环。”本文探讨（r = 5.64）。", 2),
        ("「効果は見られなかった。試験は中止した。」とXは書いている。Yは「足りない一片。」と呼んだ。", 2),
        ("Le prof. Lee parle de « pièce manquante. » Cependant, le lien est faible dans les deux sites.", 2),
        ("Nach Dr. Tarn u. a. hängt es ab, d. h. zum Teil. Die Kosten fielen auf 3 Mio. Taler.", 2),
        ("ผู้เข้าร่วมไม่ได้รับแจ้ง เราวัดใน 10 แห่งระหว่างปี 1990 ถึง 1994", 2),
        ("we regret it. only then did we turn. it fell", 3),
        ("unfinished senten", 1),
        ("", 0),
        (" … 。 -", 0),
        (None, 0),
    ],
)
def test_counts(text, expected, model):
    if text is None:
        assert sentences.split(None, model) == []
    else:
        assert len(cut(text, model)) == expected, cut(text, model)


def test_positions_cover_the_text(model):
    text = "  First one.  Second (a. b.) one!\n\nThird　 "
    spans = sentences.split(text, model)
    assert [text[a:b] for a, b in spans] == ["First one.", "Second (a. b.) one!", "Third"]
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_sides_take_the_last_load(spark, model):
    rows = [(1, "paragraph", "Old. Text.", "旧。", "zh", "2024-01-01", "2024-01-01"), (1, "paragraph", "New one.", "新。句。", "zh", "2024-01-01", "2024-01-02"), (2, "heading", "# x.", "# y。", "zh", "2024-01-01", "2024-01-01"), (3, "paragraph", None, "　", "zh", None, None)]
    df = spark.createDataFrame(rows, "seg_id bigint, kind string, original string, translated string, target_lang string, saved_at string, loaded_at string")
    got = sorted((r.seg_id, r.side, r.start_pos, r.end_pos) for r in sentences.split_sides(sentences.latest(df, ("paragraph",)), model).collect())
    assert got == [(1, "original", 0, 8), (1, "translated", 0, 2), (1, "translated", 2, 4)]
    assert sentences.split_sides(sentences.latest(df.limit(0), ("paragraph",)), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = sentences.learn(spark.createDataFrame([(None, "")], "a string, b string"), ("a", "b"))
    assert len(cut("It fell. It rose.", empty)) == 2
