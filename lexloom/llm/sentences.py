"""Sentence boundaries across languages and scripts, learnt without labels.

Counts over all texts of a language (one distributed pass) tell by log-likelihood
ratios which words go with a period more than chance has it (abbreviations), which
of them never close a text (those never close a sentence either), which pairs of
abbreviation and following word belong together (collocations), and which words
open texts (sentence starters; for Thai, beginnings of chunks between spaces). Each
period, and in Thai each space, is then classified by these statistics; other
marks, quotes and brackets follow fixed rules.

A sentence ends with its closing mark, quotes and brackets included. Marks inside
quotes or brackets don't end it, unless the quote or bracket closes right after
the mark and the sentence with it. Colons, commas and semicolons never end one.

Defined results: null texts and texts without a letter or digit give no sentence;
an unfinished last sentence is one; unbalanced quotes are ordinary characters;
repeated rows are split alike; positions count code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import langid
from lexloom.session import materialize

#: A statistic is kept when it makes up this share of its language's tokens, and is
#: seen this often: so at most 1 / LEAST_SHARE of them can reach the driver.
LEAST_SHARE, LEAST_COUNT = 2e-6, 3
#: Log-likelihood ratios are scaled to a corpus of so many tokens, to mean the same at every size.
REFERENCE = 100_000
ABBREVIATION, SURE = 0.3, 6.63
PREFIXES = range(2, 9)

_OPEN = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "【": "】", "‹": "›"}
_CLOSE = frozenset("”»“」』）)]》】›\"")
_MARK = re.compile(r"[.!?。！？｡]+|…+")
_LETTER = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'“”„«»‹›()[]{}（）「」『』¿¡—–-"
_THAI = re.compile(r"[฀-๿]")


def dunning(with_a: float, a: float, with_all: float, n: float) -> float:
    """Log-likelihood ratio that ``with_a`` of ``a`` differs from ``with_all`` of ``n``; signed."""

    def part(k: float, m: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    rest, rest_with = max(n - a, 1e-9), max(with_all - with_a, 0.0)
    p, p_rest, p_a = with_all / n, rest_with / rest, with_a / a
    ratio = 2 * (part(with_a, a, p_a) + part(rest_with, rest, p_rest) - part(with_a, a, p) - part(rest_with, rest, p))
    return ratio if p_a >= p else -ratio


def language_of(text: str) -> str:
    """The text's language, by script and function words; the likeliest where unsure."""
    if plain := langid.plain_language(text):
        return plain
    for code, pattern in langid._SCRIPTS:
        if 3 * len(pattern.findall(text)) > len(_LETTER.findall(text)):
            return code
    low = text.lower()
    words = Counter(langid._WORD.findall(low))
    return max(langid._WORDS, key=lambda k: (sum(words[w] for w in langid._WORDS[k]) + 0.5 * sum(map(low.count, langid.OWN_LETTERS[k])), k == "en"))


def _norm(token: str) -> str:
    bare = token.strip(_EDGE).lower()
    return "0" if bare[:1].isdigit() else bare


def count_text(text: str, language: str, counts: Counter) -> None:
    """Add a text's statistics: (language, what, key) -> number."""
    if language == "th":
        for i, chunk in enumerate(re.split(r"\s+", text.strip())):
            if _THAI.match(chunk.lstrip('"“')):
                bare = chunk.lstrip('"“')
                for n in PREFIXES:
                    if len(bare) >= n:
                        counts[language, "first" if i == 0 else "later", bare[:n]] += 1
                counts[language, "n", "first" if i == 0 else "later"] += 1
        return
    if language in ("zh", "ja"):
        return
    tokens = _TOKEN.findall(text)
    for i, token in enumerate(tokens):
        bare = token.rstrip("”“»\"')]")
        counts[language, "n", "tokens"] += 1
        word = _norm(bare.rstrip("."))
        if bare.endswith(".") and not bare.endswith(".."):
            last = i + 1 == len(tokens)
            counts[language, "period", word] += 1
            counts[language, "n", "periods"] += 1
            if last:
                counts[language, "final", word] += 1
                counts[language, "n", "finals"] += 1
            else:
                after = _norm(tokens[i + 1].rstrip(".,;:"))
                if len(word) <= 4:
                    counts[language, "pair", f"{word} {after}"] += 1
        else:
            counts[language, "word", _norm(bare.rstrip(".,;:!?"))] += 1
        if i == 0 or tokens[i - 1][-1:] in "!?":
            counts[language, "start", _norm(bare.rstrip(".,;:!?"))] += 1
            counts[language, "n", "starts"] += 1


class Model:
    """What the counts say: for each language, abbreviations and starters."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        by: dict[str, dict[str, Counter]] = {}
        for (language, what, key), n in counts.items():
            by.setdefault(language, {}).setdefault(what, Counter())[key] += n
        self.never_last: dict[str, frozenset[str]] = {}
        self.abbreviations: dict[str, frozenset[str]] = {}
        self.starters: dict[str, frozenset[str]] = {}
        self.collocations: dict[str, frozenset[str]] = {}
        self.thai: dict[str, bool] = {}
        for language, c in by.items():
            if language == "th":
                self._thai(c)
            else:
                self._words(language, c)

    def _words(self, language: str, c: dict[str, Counter]) -> None:
        empty: Counter = Counter()
        word, period, final, start, pair = (c.get(k, empty) for k in ("word", "period", "final", "start", "pair"))
        n, periods, finals, starts = (max(1, c["n"][k]) for k in ("tokens", "periods", "finals", "starts"))
        scale = min(1.0, REFERENCE / n)
        abbreviations, never = set(), set()
        for w, k in period.items():
            if not w or w == "0":
                continue
            without, inner, letters = word[w], w.count(".") + 1, max(1, len(w.replace(".", "")))
            ratio = scale * dunning(k, k + without, periods, n)
            if ratio > 0 and ratio * math.exp(-letters) * inner * letters ** -min(60.0, without * scale) >= ABBREVIATION:
                abbreviations.add(w)
            # Scarcer at the end of texts than sentences' last words are.
            if k >= LEAST_COUNT and dunning(final[w], k, finals, periods) < -SURE and 4 * final[w] * periods < finals * k:
                never.add(w)
        self.abbreviations[language], self.never_last[language] = frozenset(abbreviations | never), frozenset(never)
        self.starters[language] = frozenset(w for w, k in start.items() if w and dunning(k, k + word[w] + period[w], starts, n) > SURE)
        self.collocations[language] = frozenset(p for p, k in pair.items() if (w := p.split(" ")[0]) in abbreviations and dunning(k, period[w], word[p.split(" ", 1)[1]] + k, n) > SURE)

    def _thai(self, c: dict[str, Counter]) -> None:
        first, later = c.get("first", Counter()), c.get("later", Counter())
        n_first, n_later = c["n"]["first"], c["n"]["later"]
        for prefix in first.keys() | later.keys():
            k, total = first[prefix], first[prefix] + later[prefix]
            # Openers stand first about as often as any sentence does; that a rare one never did says little.
            if total >= LEAST_COUNT and (k > 0 or total >= 12):
                self.thai[prefix] = k / total >= 0.25 * n_first / max(1, n_first + n_later)

    def opens_thai(self, chunk: str) -> bool:
        bare = chunk.lstrip('"“')
        for n in reversed(PREFIXES):
            if len(bare) >= n and (known := self.thai.get(bare[:n])) is not None:
                return known
        return False


def learn(texts: DataFrame, text_cols: tuple[str, ...]) -> Model:
    """The model of all texts in the columns; counts are summed by the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    if text and _LETTER.search(text):
                        count_text(text, language_of(text), counts)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    # Written once: the texts are walked one time, though the counts are read twice.
    summed = materialize(texts.select(*text_cols).mapInArrow(run, "lang string, what string, key string, n bigint").groupBy("lang", "what", "key").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in summed.filter("what = 'n'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, max(1.0, v * LEAST_SHARE))]) if totals else None
    kept = summed.filter((F.col("what") == "n") | (F.col("n") >= least[F.col("lang")])) if totals else summed
    return Model({(r.lang, r.what, r.key): r.n for r in kept.collect()})


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(zip(*counts)) or [[], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(counts.values()), pa.int64())], names=["lang", "what", "key", "n"])


def _depths(text: str) -> list[tuple[int, int]]:
    """(opening, closing) position of quotes and brackets that match."""
    stack: list[int] = []
    pairs = []
    for i, ch in enumerate(text):
        if ch == '"':
            if any(text[j] == '"' for j in stack):
                while text[stack[-1]] != '"':
                    stack.pop()
                pairs.append((stack.pop(), i))
            else:
                stack.append(i)
        elif stack and ch in _CLOSE and any(ch in _OPEN.get(text[j], "") for j in stack):
            while ch not in _OPEN.get(text[stack[-1]], ""):
                stack.pop()
            pairs.append((stack.pop(), i))
        elif ch in _OPEN:
            stack.append(i)
    return sorted(pairs)


#: Kana that carry a sentence on after a quotation.
_CARRY_ON = frozenset("とってはがをにでのもやへ、，。")


def _ends_at_period(text: str, i: int, end: int, begin: int, language: str, model: Model, small: bool) -> bool:
    """Whether the period before ``end``, the first mark at ``i``, ends a sentence."""
    before = text[begin:i].split()
    word = _norm(before[-1]) if before else ""
    rest = text[end:]
    after = rest.lstrip()
    follow = after.lstrip(_EDGE)[:1]
    spaced = rest[:1].isspace()
    if follow.islower() and not small:
        return False
    if not word:
        return spaced
    never, abbreviations = model.never_last.get(language, frozenset()), model.abbreviations.get(language, frozenset())
    tail = word.rsplit("-", 1)[-1]
    if not spaced:
        # A missing space: a whole word, then a capitalised word.
        nxt = re.match(r"[^\W\d_]{2,}|[^\W\d_](?=\s)", after.lstrip(_EDGE))
        wide = bool(re.match(r"[぀-ヿ㐀-鿿]", after))
        return (wide or bool(nxt and follow.isupper())) and (len(word) > 1 or text[i - 1] in ")]”»") and word not in never and "." not in word and not re.search(r"://|www\.", before[-1])
    if text[i - 1] in ")]）］”»\"":
        return True
    if word in never or tail in never:
        return False
    next_word = _norm(after.split()[0].rstrip(".,;:")) if after else ""
    if f"{word} {next_word}" in model.collocations.get(language, frozenset()) and next_word not in model.starters.get(language, frozenset()):
        return False
    if word in abbreviations:
        return not follow.isdigit() and not (small and next_word not in model.starters.get(language, frozenset()))
    bare = before[-1].strip(_EDGE)
    if len(bare) == 1 and bare.isupper():
        return False
    return True


def split(text: str | None, model: Model, language: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence."""
    if not text or not _LETTER.search(text):
        return []
    language = language or language_of(text)
    pairs = _depths(text)
    # A text without capitals can't show where sentences begin.
    small = text == text.lower()
    bare = text.strip()
    lead = len(text) - len(text.lstrip())
    # Quotes about the whole text hold sentences, they aren't in one.
    pairs = [(a, b) for a, b in pairs if not (a == lead and b == lead + len(bare) - 1 and text[a] not in "([（")]
    outer: list[tuple[int, int]] = []
    for a, b in pairs:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    inside = [-1] * len(text)
    for n, (a, b) in enumerate(outer):
        inside[a : b + 1] = [n] * (b + 1 - a)

    cuts: list[int] = []
    begin = 0

    def start_of(at: int) -> int:
        while at < len(text) and text[at].isspace():
            at += 1
        return at

    if language == "th":
        for m in re.finditer(r"\s+|(?<=[\])0-9A-Za-z])(?=[\u0e00-\u0e7f])", text):
            if (m.start() == m.end() or inside[m.start()] < 0) and m.end() < len(text) and m.start() > 0 and inside[m.start() - 1] in (-1, inside[m.start() - 1] if outer and outer[inside[m.start() - 1]][1] == m.start() - 1 else -1):
                rest = text[m.end() :]
                quoted = rest[0] in '"“' and bool(_THAI.match(rest[1:2])) and inside[m.end()] >= 0 and outer[inside[m.end()]][0] == m.end()
                if quoted or (_THAI.match(rest) and model.opens_thai(rest.split(None, 1)[0])):
                    cuts.append(m.start())
    else:
        for m in _MARK.finditer(text):
            i, end = m.start(), m.end()
            mark = m.group()
            if mark[0] == "…" or mark.startswith(".."):
                follow = text[end:].lstrip()[:1]
                if inside[i] >= 0 or not (text[end : end + 1].isspace() and follow.isupper()):
                    continue
            held = inside[i]
            if held >= 0:
                # A space may stand between the mark and the quote it closes with.
                gap = re.compile(r"\s+").match(text, end)
                if gap and gap.end() == outer[held][1]:
                    end = gap.end()
            while end < len(text) and text[end] in _CLOSE and (inside[end] == held or held < 0) and inside[end] >= 0 and text[end] not in _OPEN:
                end += 1
            if held >= 0:
                a, b = outer[held]
                if end <= b:
                    closer = text[end : end + 1]
                    if not (closer and closer in _CLOSE and end == b):
                        continue
                    end = b + 1
                if begin_is(text, begin, a) and text[a] not in "(（[":
                    # A quotation opens the sentence: what follows belongs to it.
                    if text[end:].strip():
                        continue
                after = text[end:].lstrip()[:1]
                if after and (after in ",，、;；:：" or (language == "ja" and after in _CARRY_ON) or (after.islower() and not small) or after in ".。！？!?"):
                    continue
            else:
                while end < len(text) and text[end] in "”»」』）)\"" and inside[end] < 0:
                    end += 1
                if mark[0] in "。！？｡":
                    pass
                elif mark.startswith(".") and not mark.startswith("..") and len(mark) == 1:
                    if i > 0 and text[i - 1].isdigit() and text[end : end + 1].isdigit():
                        continue
                    if text[end:].strip() and not _ends_at_period(text, i, end, begin, language, model, small):
                        continue
                else:
                    after = text[end:].lstrip()
                    if after and ((after.lstrip(_EDGE)[:1].islower() and not small) or (not text[end : end + 1].isspace() and not after.lstrip(_EDGE)[:1].isupper() and not re.match(r"[぀-鿿]", after))):
                        continue
            cuts.append(end)
            begin = end
    out, at = [], 0
    for cut in [*cuts, len(text)]:
        start, stop = start_of(at), cut
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            if _LETTER.search(text, start, stop):
                out.append((start, stop))
            elif out:
                out[-1] = (out[-1][0], stop)
        at = cut
    return out


def begin_is(text: str, begin: int, at: int) -> bool:
    """Whether nothing but space stands between the sentence's begin and ``at``."""
    return not text[begin:at].strip()


def latest(segments: DataFrame, kinds: tuple[str, ...], columns: tuple[str, ...] = ("kind", "original", "translated", "target_lang")) -> DataFrame:
    """(seg_id, *columns) once for every segment: the row loaded last. Partial
    aggregates go before the shuffle, so a hot document costs no more than others."""
    newest = segments.filter(F.col("kind").isin(*kinds)).groupBy("seg_id").agg(F.max(F.struct("loaded_at", "saved_at", *columns)).alias("_n"))
    return newest.select("seg_id", *(F.col(f"_n.{c}").alias(c) for c in columns))


def split_sides(segments: DataFrame, model: Model) -> DataFrame:
    """(seg_id, side, start_pos, end_pos) of both sides' sentences. The model is a few
    word lists, bounded by ``LEAST_SHARE``."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for side, column in zip(("original", "translated"), batch.columns[1:]):
                for key, text in zip(keys, column.to_pylist()):
                    rows += [(key, side, a, b) for a, b in split(text, shared.value)]
            columns = list(zip(*rows)) or [[], [], [], []]
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["seg_id", "side", "start_pos", "end_pos"])

    return segments.select("seg_id", "original", "translated").mapInArrow(run, "seg_id bigint, side string, start_pos int, end_pos int")
