import random
from collections import Counter

import pytest

from lexloom.llm import ocr

WORDS = "the gradual survey measured public harvest water level moisture market pattern follows seasonal district inventory threshold estimate signal record between north school climate".split()


def page(rng, number, text_lines, header):
    return [*text_lines, "", f"- {number} -", header, ""]


@pytest.fixture(scope="module")
def known():
    rng = random.Random(1)
    counts: Counter = Counter()
    for _ in range(300):
        ocr.count_document("\n".join(" ".join(rng.choice(WORDS) for _ in range(9)) + "." for _ in range(6)), counts)
    out: dict = {}
    for (what, key), n in counts.items():
        if n >= ocr.LEAST_COUNT:
            out.setdefault(what, {})[key] = n
    return ocr.Statistics(out)


SCAN = "A Title of Some Length\n\nThe gradual survey measured the pub-\nlic harvest between scbool and north.\nThe water level follows the siirvey.\n\n- 12 -\nA Title of Some Length\nThe market pattern follows.\n12   34   56\nThe district inven‐\n\n- 13 -\nA Title of S0me Length\n\ntory record follows.\n```\n530\n```\n"


def test_noise(known):
    assert ocr.noise_of(SCAN, known) == [
        (3, "hyphen"), (4, "ocr"), (5, "ocr"), (7, "page_number"), (8, "header"), (11, "hyphen"), (13, "page_number"), (14, "header"),
    ]


def test_repair(known):
    text = ocr.repair(SCAN, known)
    assert "public harvest between school and north. The water level follows the survey." in text
    assert "inventory record follows." in text
    assert "- 12 -" not in text and "S0me" not in text and "12   34   56" in text and "530" in text


@pytest.mark.parametrize("content", [None, "", " \n\n", "# Clean\n\nThe gradual survey measured water.\n\n| a |\n"])
def test_nothing_wrong(content, known):
    assert ocr.noise_of(content, known) == []
    assert ocr.repair(content, known) == content


def test_automaton_retrieves_every_word_within_two_edits():
    rng = random.Random(7)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    trie = ocr.Trie(iter(words))
    for _ in range(60):
        probe = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        for most in (0, 1, 2):
            assert sorted(trie.within(probe, most)) == sorted(w for w in words if ocr.near(w, probe, most))


@pytest.mark.parametrize(("true", "seen", "at"), [("modern", "rnodern", 0), ("surface", "siirface", 1), ("less", "le5s", 2), ("pressure", "prcssurc", 2), ("water", "woter", None), ("same", "same", None)])
def test_explanations(true, seen, at):
    assert ocr.explained(true, seen) == at


@pytest.mark.parametrize(("seen", "true"), [("guality", "quality"), ("qualily", "quality"), ("averaqe", "average"), ("aveiage", "average"), ("metnod", "method"), ("hospitol", "hospital"), ("hospitat", "hospital"), ("rnodern", "modern"), ("rnethod", "method"), ("paticnt", "patient")])
def test_any_one_edit_from_a_frequent_word(seen, true):
    six = ocr.Statistics({"word": dict.fromkeys(("quality", "average", "method", "hospital", "modern", "patient"), 400)})
    assert six.best(seen, "")[0] == true


@pytest.mark.parametrize("word", ["methods", "Averagi", "qualities", "zebra", "hospital", "ward"])
def test_other_words_stay(word):
    six = ocr.Statistics({"word": dict.fromkeys(("quality", "average", "method", "hospital", "modern", "patient"), 400) | {"ward": 300, "word": 900}})
    assert six.best(word, "") is None


def test_letters_in_other_letters_places_gain_weight(spark):
    words = {w: 400 for w in ("quality", "average", "hospital", "pattern", "season", "market")}
    rare = [w.replace("a", "o") for w in words]
    known = ocr.Statistics({"word": words})
    got = ocr.weigh(spark.createDataFrame([(w,) for w in [*words, *rare]], "key string"), known)
    assert ocr.STRANGE < got["a", "o"] < 1


def test_unknown_words_are_spelled(known):
    assert known.spelled("surva1") is None
    assert known.spelled("lev3l") is None
    assert known.spelled("mar1el") is None
    letters = ocr.Statistics({"word": {"tarvika": 9, "rulbath": 9}})
    assert letters.spelled("tarv!ka") == ("tarvika", 4)


def test_page_tops_count_once_a_document(spark):
    page_of = lambda title: f"{title}\n\nThe survey measured water.\n\n- 2 -\n{title}\n\nThe harvest.\n\n- 3 -\n{title}\n\nMore.\n"
    docs = [(i, page_of("Journal of Plain Things" if i < 3 else f"Title number {'abcdefgh'[i]} of many")) for i in range(8)]
    learnt = ocr.learn(spark.createDataFrame(docs, "doc_id bigint, content string"))
    assert learnt.tops == {"journal of plain things": 3}


def test_planted_pages_are_repaired(known):
    """Clean paragraphs, printed as pages with every kind of noise, come out again."""
    rng = random.Random(11)
    right = total = 0
    for _ in range(30):
        paragraphs = [" ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(5)) for _ in range(3)]
        lines = ["A Title of Some Length", ""]
        for n, paragraph in enumerate(paragraphs):
            held = ""
            for word in paragraph.split(" "):
                if len(held) + len(word) > 60:
                    if len(word) > 7 and word.isalpha() and rng.random() < 0.5:
                        lines.append(f"{held} {word[:4]}-".strip())
                        held = word[4:]
                        continue
                    lines.append(held)
                    held = word
                else:
                    held = f"{held} {word}".strip()
                if word.isalpha() and word.islower() and len(word) > 5 and rng.random() < 0.04 and "e" in word:
                    held = held[: -len(word)] + word.replace("e", "c", 1)
            lines += [held, "", f"- {n + 7} -", "A Title of Some Length", ""]
        repaired = ocr.repair("\n".join(lines), known).split("\n\n")
        right += sum(p in repaired for p in paragraphs)
        total += len(paragraphs)
    assert right >= 0.93 * total


def test_tables(spark, known):
    parsed = spark.createDataFrame([(1, "old", "d", "2024-01-01"), (1, SCAN, "d", "2024-01-02"), (2, None, "d", "2024-01-01"), (3, "x" * 200_000, "d", None)], "doc_id bigint, content string, base_dir string, parsed_at string")
    newest = ocr.newest(parsed)
    assert {r.doc_id for r in ocr.find_noise(newest, known).collect()} == {1}
    assert newest.count() == 3 and ocr.repair_all(newest, known).count() == 3
    learnt = ocr.learn(newest.limit(0))
    assert ocr.find_noise(newest.limit(0), learnt).count() == 0
