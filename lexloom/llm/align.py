"""Sentence alignment in bilingual documents.

Skip-gram pairs of each language are counted over all texts by the cluster; from
the counts, executors fit vectors to the skip-gram objective with negative samples,
taken in expectation, so every run gives the same vectors. The frequent words of a
language (``CORE_SHARE``) are fitted together, each language in a task of bounded size;
every other word (``WORD_SHARE``) is fitted to the same objective by itself, its
contexts being the frequent words. Seed translations come from the glossary and from
segments of one sentence on either side, whose words must correspond (best by
log-likelihood ratio both ways); an orthogonal Procrustes map per language turns its
vectors into the pivot's space. Strings that translations keep (numbers, names,
labels) are seeds of their own, each with the same random vector in every language.

A sentence is the weighted mean of its words. Segments are aligned by time warping
over one minus cosine, coarse to fine where they are long; pairs on the path that
are alike enough stay, and spans left over are rematched by mutual best cosine,
which recovers sentences that moved and sentences merged into one. Spans are rematched
over the whole text, in blocks where it is long, so no length changes what is found.

Defined results: a side without sentences gives no pair, nor do sides or sentences
in one language; repeated rows of a segment count once (the row loaded last); ties
go to the earlier sentence; words too rare to have a vector count only where they are
strings that translations keep.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import langid, sentences
from lexloom.session import materialize

PIVOT = "zh"
DIMENSIONS, KEPT_DIMENSIONS = 160, 96
WINDOW, NEGATIVES, ITERATIONS = 12, 1, 100
#: Words of at least this share of their language's words have vectors, and frequent ones
#: are each other's contexts: at most 1 / share of either.
WORD_SHARE, CORE_SHARE = 1e-5, 3e-4
#: Words rarer than this count nearly fully in a sentence's mean.
RARE = 3e-3
SEED_SURE = 10.8
#: A pair is kept on the warping path, joins a sentence that has a partner, or fills a
#: gap on the path from these cosines on.
ALIKE, REMATCH, BETWEEN = 0.4, 0.52, 0.22
#: Cells of a cost matrix that are warped without coarsening; radius of the finer search.
EXACT_CELLS, RADIUS = 10_000, 3
#: Cosines that are held at once; more are computed again in blocks.
HELD_CELLS = 4_000_000

_KEPT = re.compile(r"[A-Z]{3,}-\d+|\d+(?:[.,\u00a0\u2009\u202f]\d+)*|[A-Z][a-zß-ÿ]{4,}")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[฀-๿]+|[^\W\d_぀-ヿ㐀-鿿฀-๿]+")
_NUMBER = re.compile(r"[.,\u00a0\u2009\u202f]")


def kept_strings(sentence: str) -> list[str]:
    """Numbers (digits only), labels and names."""
    return [_NUMBER.sub("", w).lower() if w[0].isdigit() else w.lower() for w in _KEPT.findall(sentence)]


def words(sentence: str, language: str) -> list[str]:
    """Words of a language; pairs of letters (threes in Thai) where no spaces part words."""
    out = []
    for run in _WORD.findall(sentence):
        first = run[0]
        if "぀" <= first <= "鿿":
            if language in ("zh", "ja"):
                out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
        elif "฀" <= first <= "๿":
            if language == "th":
                out += [run[i : i + 3] for i in range(max(1, len(run) - 2))]
        elif language not in ("zh", "ja", "th"):
            out.append(run.lower())
    return out


def fit_vectors(counts: np.ndarray, iterations: int = ITERATIONS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) for the skip-gram objective with negative samples,
    whose expectation over all pairs the counts give, by full-batch adaptive steps."""
    size = len(counts)
    if size == 0 or counts.sum() == 0:
        return np.zeros((size, dimensions), np.float32), np.zeros((size, dimensions), np.float32)
    rng = np.random.default_rng(7)
    inner = rng.normal(0, 0.1, (size, dimensions)).astype(np.float32)
    outer = rng.normal(0, 0.1, (size, dimensions)).astype(np.float32)
    positive, negative = _expected(counts, counts.sum(0))
    slope = [np.full(x.shape, 1e-6, np.float32) for x in (inner, outer)]
    for _ in range(iterations):
        push = _push(inner, outer, positive, negative)
        for x, grad, s in ((inner, push @ outer, slope[0]), (outer, push.T @ inner, slope[1])):
            s += grad**2
            x += 0.25 * grad / np.sqrt(s)
    return inner, outer


def fold_vectors(counts: np.ndarray, outer: np.ndarray, frequency: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Vectors of further words by their counts with the contexts, which stay as they are."""
    inner = np.zeros((len(counts), outer.shape[1]), np.float32)
    positive, negative = _expected(counts, frequency)
    slope = np.full(inner.shape, 1e-6, np.float32)
    for _ in range(iterations):
        grad = _push(inner, outer, positive, negative) @ outer
        slope += grad**2
        inner += 0.25 * grad / np.sqrt(slope)
    return inner


def _expected(counts: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair is seen and drawn; frequent words must not drown the others."""
    row = counts.sum(1, keepdims=True)
    smooth = frequency[None, :] ** 0.75
    weight = (1 / np.maximum(row, 1)) ** 0.5
    return (counts * weight).astype(np.float32), (NEGATIVES * row * (smooth / max(1e-9, smooth.sum())) * weight).astype(np.float32)


def _push(inner: np.ndarray, outer: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    chance = 1 / (1 + np.exp(-np.clip(inner @ outer.T, -20, 20)))
    return positive * (1 - chance) - negative * chance


def procrustes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The orthogonal map that takes the rows of ``x`` nearest to those of ``y``."""
    u, _, v = np.linalg.svd(x.T @ y)
    return (u @ v).astype(np.float32)


def warp(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone path through all cells."""
    n, m = cost.shape
    return _warp_band(lambda i, low, high: cost[i, low:high], n, [(0, m)] * n)


def _warp_band(cost: Callable[[int, int, int], np.ndarray], n: int, band: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cheapest path within ``band`` (from, to) of each row; memory follows the band."""
    rows: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    before: dict[int, float] = {}
    for i in range(n):
        low, high = band[i]
        here, row, step = cost(i, low, high), np.full(high - low, np.inf), np.zeros(high - low, np.int8)
        left = np.inf
        for k in range(high - low):
            j = low + k
            options = (before.get(j - 1, np.inf), before.get(j, np.inf), left)
            best = 0.0 if i == 0 and j == 0 else min(options)
            row[k] = left = here[k] + best
            step[k] = options.index(min(options))
        rows.append(row)
        steps.append(step)
        before = {low + k: v for k, v in enumerate(row.tolist())}
    path, i, j = [], n - 1, band[-1][1] - 1
    while True:
        path.append((i, j))
        if i == 0 and j == 0:
            return path[::-1]
        step = 2 if i == 0 else 1 if j == 0 else steps[i][j - band[i][0]]
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)


def coarse_to_fine(a: np.ndarray, b: np.ndarray, cost: Callable[[int, int, int], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """:func:`warp` of two rows of vectors; long ones are halved, warped, and warped
    again near the projected path, by ``cost`` (of a row, from, to) at last."""
    if len(a) * len(b) <= EXACT_CELLS or min(len(a), len(b)) < 4:
        return warp(1 - a @ b.T)

    def half(x: np.ndarray) -> np.ndarray:
        even = x[: len(x) // 2 * 2].reshape(-1, 2, x.shape[1]).sum(1)
        y = np.concatenate((even, x[-1:])) if len(x) % 2 else even
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    low, high = [len(b)] * len(a), [0] * len(a)
    for i, j in coarse_to_fine(half(a), half(b)):
        for k in range(max(0, 2 * i - RADIUS), min(len(a), 2 * i + 2 + RADIUS)):
            low[k], high[k] = min(low[k], max(0, 2 * j - RADIUS)), max(high[k], min(len(b), 2 * j + 2 + RADIUS))
    return _warp_band(cost or (lambda i, lo, hi: 1 - b[lo:hi] @ a[i]), len(a), list(zip(low, high)))


class Space:
    """Vectors of all languages in the pivot's space."""

    def __init__(self, vectors: dict[str, tuple[dict[str, int], np.ndarray, np.ndarray, int]]):
        """For each language its words, their vectors and weights, and how many of the
        first of them are frequent."""
        self._vectors = vectors
        self._kept: dict[str, np.ndarray] = {}

    def _kept_vector(self, string: str) -> np.ndarray:
        if (v := self._kept.get(string)) is None:
            if len(self._kept) > 50_000:
                self._kept = {}
            v = self._kept[string] = np.random.default_rng(zlib.crc32(string.encode())).normal(0, 1, KEPT_DIMENSIONS).astype(np.float32) / math.sqrt(KEPT_DIMENSIONS)
        return v

    def sentence(self, text: str, language: str) -> np.ndarray:
        out = np.zeros(DIMENSIONS + KEPT_DIMENSIONS, np.float32)
        strings = kept_strings(text)
        if known := self._vectors.get(language):
            index, vectors, weights, frequent = known
            # A capitalised word that the language has often is no name, and a name no word.
            strings = [s for s in strings if index.get(s, frequent) >= frequent]
            found = map(index.get, [w for w in words(text, language) if w not in strings] if strings else words(text, language))
            if at := [i for i in found if i is not None]:
                # Whole numbers up to 127 stand for the parts of a vector of length one.
                out[:DIMENSIONS] = _unit(weights[at] @ vectors[at].astype(np.float32))
        if strings:
            out[DIMENSIONS:] = _unit(np.sum([self._kept_vector(s) for s in strings], axis=0))
        return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(1e-9, math.sqrt(float(x @ x)))


_JOINT = re.compile(r"[;；]\s*|，")


def halves(text: str) -> list[str]:
    """The parts before and after each mark that may join two sentences."""
    out = []
    for m in _JOINT.finditer(text):
        left, right = text[: m.start()], text[m.end() :]
        if min(len(left), len(right)) >= 0.25 * len(text):
            out += [left, right]
    return out


class Near:
    """Cosines of all sentences of two texts; a sentence of one side may render a half of
    the other's. Many are not held, but computed again where they are asked for."""

    def __init__(self, a: list[str], b: list[str], languages: tuple[str, str], space: Space):
        self.x = np.stack([space.sentence(s, languages[0]) for s in a])
        self.y = np.stack([space.sentence(s, languages[1]) for s in b])
        self._halves = [self._of_halves(texts, language, space) for texts, language in ((a, languages[0]), (b, languages[1]))]
        self.shape = len(a), len(b)
        self.held = self._compute(slice(None), slice(None)) if len(a) * len(b) <= HELD_CELLS else None

    @staticmethod
    def _of_halves(texts: list[str], language: str, space: Space) -> dict[int, np.ndarray]:
        return {i: np.stack([space.sentence(p, language) for p in parts]) for i, text in enumerate(texts) if (parts := halves(text))}

    def _compute(self, rows: np.ndarray | slice, columns: np.ndarray | slice) -> np.ndarray:
        x, y = self.x[rows], self.y[columns]
        out = x @ y.T
        if self._halves[0]:
            for k, i in enumerate(np.arange(self.shape[0])[rows].tolist()):
                if i in self._halves[0]:
                    out[k] = np.maximum(out[k], 0.95 * (self._halves[0][i] @ y.T).max(0))
        if self._halves[1]:
            for k, j in enumerate(np.arange(self.shape[1])[columns].tolist()):
                if j in self._halves[1]:
                    out[:, k] = np.maximum(out[:, k], 0.95 * (x @ self._halves[1][j].T).max(1))
        return out

    def at(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if self.held is None:
            return self._compute(rows, columns)
        return self.held if (len(rows), len(columns)) == self.shape else self.held[np.ix_(rows, columns)]

    def cost(self, i: int, low: int, high: int) -> np.ndarray:
        return 1 - (self._compute(np.array([i]), np.arange(low, high))[0] if self.held is None else self.held[i, low:high])

    def blocks(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines with all columns), a bounded number of cells at a time."""
        step = max(1, HELD_CELLS // max(1, len(columns)))
        for k in range(0, len(rows), step):
            yield rows[k : k + step], self.at(rows[k : k + step], columns)

    def best(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row the best column and its cosine, and the same for each column;
        ties go to the earlier one."""
        row_at, row_top = np.zeros(len(rows), np.intp), np.zeros(len(rows), np.float32)
        column_at, column_top = np.zeros(len(columns), np.intp), np.full(len(columns), -2, np.float32)
        k = 0
        for some, cells in self.blocks(rows, columns):
            row_at[k : k + len(some)], row_top[k : k + len(some)] = columns[cells.argmax(1)], cells.max(1)
            better = cells.max(0) > column_top
            column_at[better], column_top[better] = some[cells.argmax(0)[better]], cells.max(0)[better]
            k += len(some)
        return row_at, row_top, column_at, column_top


def pair_sentences(a: list[str], b: list[str], languages: tuple[str, str], space: Space, alike: float = ALIKE, rematch: float = REMATCH, between: float = BETWEEN) -> list[tuple[int, int]]:
    """(index in a, index in b) of sentences that render each other."""
    near = Near(a, b, languages, space)
    every_a, every_b = np.arange(len(a)), np.arange(len(b))
    row_at, row_top, column_at, column_top = near.best(every_a, every_b)
    path = warp(1 - near.held) if len(a) * len(b) <= EXACT_CELLS else coarse_to_fine(near.x, near.y, near.cost)
    found: dict[tuple[int, int], float] = {}
    on_path = {(i, j): float(near.held[i, j]) if near.held is not None else 1 - float(near.cost(i, j, j + 1)[0]) for i, j in path}
    for (i, j), cosine in on_path.items():
        # A path visits neighbours on its way: a pair must be a best one for either side.
        if cosine >= alike and (cosine >= row_top[i] - 1e-6 or cosine >= column_top[j] - 1e-6):
            found[i, j] = cosine
    # A sentence on the path twice keeps its weaker partner only if that one is as sure of it.
    of_a, of_b = defaultdict(set), defaultdict(set)
    for i, j in found:
        of_a[i].add(j)
        of_b[j].add(i)
    for i, j in sorted(found):
        if found[i, j] < rematch and max([found[i, k] for k in of_a[i]] + [found[k, j] for k in of_b[j]]) > found[i, j]:
            del found[i, j]
            of_a[i].discard(j)
            of_b[j].discard(i)
    left_a, left_b = (np.array(sorted(set(range(n)) - {p[side] for p in found}), np.intp) for side, n in ((0, len(a)), (1, len(b))))
    # What the path left over is matched with its best partner wherever that stands.
    while len(left_a) and len(left_b):
        at, top, back, _ = near.best(left_a, left_b)
        place = {j: k for k, j in enumerate(left_b.tolist())}
        mutual = [(i, j) for i, j, c in zip(left_a.tolist(), at.tolist(), top.tolist()) if c >= alike and back[place[j]] == i]
        if not mutual:
            break
        found.update((p, 1.0) for p in mutual)
        left_a, left_b = np.setdiff1d(left_a, [i for i, _ in mutual]), np.setdiff1d(left_b, [j for _, j in mutual])
    # Sentences left alone between the same neighbours are each other's likeliest partners.
    for (i, j), cosine in on_path.items() if len(left_a) and len(left_b) else ():
        if cosine >= between and i in left_a and j in left_b and cosine >= near.at(left_a, np.array([j])).max() - 1e-6 and cosine >= near.at(np.array([i]), left_b).max() - 1e-6:
            found[i, j] = cosine
            left_a, left_b = left_a[left_a != i], left_b[left_b != j]
    # What is still alone may be part of a sentence that has a partner already.
    for i in left_a.tolist():
        if row_top[i] >= rematch and row_top[i] >= 0.8 * column_top[row_at[i]]:
            found[i, int(row_at[i])] = 1.0
    for j in left_b.tolist():
        if column_top[j] >= rematch and column_top[j] >= 0.8 * row_top[column_at[j]]:
            found[int(column_at[j]), j] = 1.0
    return sorted(found)


#: What :func:`cut_pairs` gives: places are starts and ends in turn.
CUT = "seg_id bigint, original string, translated string, tongue_a string, tongue_b string, places_a array<int>, places_b array<int>"


def cut_pairs(pairs: DataFrame, model) -> DataFrame:
    """Segments whose sides have sentences in different languages, with the sentences'
    places: they are found once, and used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seg_id, original, translated in zip(*(c.to_pylist() for c in batch.columns)):
                if not original or not translated:
                    continue
                tongues = sentences.language_of(original), sentences.language_of(translated)
                if tongues[0] == tongues[1]:
                    continue
                places = [[p for span in sentences.split(t, model.value, k) for p in span] for t, k in zip((original, translated), tongues)]
                if places[0] and places[1]:
                    rows.append((seg_id, original, translated, *tongues, *places))
            columns = list(zip(*rows)) or [[] for _ in range(7)]
            types = (pa.int64(), *[pa.string()] * 4, *[pa.list_(pa.int32())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["seg_id", "original", "translated", "tongue_a", "tongue_b", "places_a", "places_b"])

    return pairs.select("seg_id", "original", "translated").mapInArrow(run, CUT)


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list, tuple[str, str]]]:
    """(seg_id, sentences of either side with their starts, languages) of cut segments."""
    for seg_id, original, translated, tongue_a, tongue_b, places_a, places_b in zip(*(c.to_pylist() for c in batch.columns)):
        sides = [[(s, t[s:e]) for s, e in zip(places[::2], places[1::2])] for t, places in ((original, places_a), (translated, places_b))]
        yield seg_id, *sides, (tongue_a, tongue_b)


def _counts(pairs: DataFrame) -> DataFrame:
    """(what, lang, a, b, n): skip-gram pairs "near" and seed pairs "seed"; "word" counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(what, lang, *(key if isinstance(key, tuple) else (key, "")), n) for (what, lang), c in counts.items() for key, n in c.items()]
            counts.clear()
            columns = list(zip(*rows)) or [[] for _ in range(5)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], names=["what", "lang", "a", "b", "n"])

        for batch in batches:
            for _, a, b, tongues in _pairs_of(batch):
                cut = [[words(s, k) for _, s in side] for side, k in zip((a, b), tongues)]
                for side, k in zip(cut, tongues):
                    for sentence in side:
                        counts["word", k].update(sentence)
                        for apart in range(1, min(WINDOW, len(sentence) - 1) + 1):
                            counts["near", k].update(zip(sentence, sentence[apart:]))
                if len(cut[0]) == 1 and len(cut[1]) == 1:
                    other, pivot = (0, 1) if tongues[1] == PIVOT else (1, 0) if tongues[0] == PIVOT else (None, None)
                    if other is not None:
                        k = tongues[other]
                        mine, theirs = set(cut[other][0]), set(cut[pivot][0])
                        counts["sides", k][""] += 1
                        counts["mine", k].update(mine)
                        counts["theirs", k].update(theirs)
                        counts["seed", k].update((w, v) for w in mine for v in theirs)
            if sum(map(len, counts.values())) > 400_000:
                yield flush()
        yield flush()

    return pairs.mapInArrow(run, "what string, lang string, a string, b string, n bigint").groupBy("what", "lang", "a", "b").agg(F.sum("n").alias("n"))


def learn(pairs: DataFrame, glossary: DataFrame) -> Space:
    """The space of all cut pairs of segments. What comes to the driver are words above
    ``WORD_SHARE`` with their vectors, a byte a dimension, and one seed a word."""
    spark = pairs.sparkSession
    counts = materialize(_counts(pairs))
    totals = {r.lang: r.n for r in counts.filter("what = 'word'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Space({})
    least = lambda share: F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, max(2.0, n * share))])[F.col("lang")]
    # At most 1 / WORD_SHARE words a language, so a window per language is bounded.
    place = (F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "a")) - 1).alias("i")
    known = materialize(counts.filter("what = 'word'").filter(F.col("n") >= least(WORD_SHARE)).select("lang", "a", place, "n", (F.col("n") >= least(CORE_SHARE)).alias("core")))
    # At most 1 / CORE_SHARE words a language.
    core = known.filter("core").select("lang", F.col("a").alias("b"), F.col("i").alias("j"))
    near = counts.filter("what = 'near'").select("lang", "a", "b", "n")
    both = near.unionByName(near.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    seen = both.join(F.broadcast(core), ["lang", "b"]).join(known.select("lang", "a", "i", "core"), ["lang", "a"])
    seen = materialize(seen.groupBy("lang", "i", "core", "j").agg(F.sum("n").alias("n")))
    sizes = {r.lang: r.n for r in core.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    fitted = seen.filter("core").select("lang", "i", "j", "n").groupBy("lang").applyInPandas(_fit_core(sizes), "lang string, i int, inner binary, outer binary, n double").collect()
    contexts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {k: (np.zeros((n, DIMENSIONS), np.float32), np.zeros((n, DIMENSIONS), np.float32), np.zeros(n)) for k, n in sizes.items()}
    for r in fitted:
        inner, outer, n = contexts[r.lang]
        inner[r.i], outer[r.i], n[r.i] = np.frombuffer(r.inner, np.float32), np.frombuffer(r.outer, np.float32), r.n
    shared = spark.sparkContext.broadcast({k: (outer, n) for k, (_, outer, n) in contexts.items()})
    rare = seen.filter("NOT core").groupBy("lang", "i").agg(F.collect_list("j").alias("js"), F.collect_list("n").alias("ns"))
    folded = rare.mapInArrow(_fold(shared), "lang string, i int, inner binary").collect()

    vocabulary: dict[str, dict[str, int]] = defaultdict(dict)
    frequency: dict[str, list[int]] = defaultdict(list)
    for r in known.orderBy("lang", "i").collect():
        vocabulary[r.lang][r.a] = r.i
        frequency[r.lang].append(r.n)
    vectors = {k: np.zeros((len(v), DIMENSIONS), np.float32) for k, v in vocabulary.items()}
    for k, (inner, _, _) in contexts.items():
        vectors[k][: len(inner)] = inner
    for r in folded:
        vectors[r.lang][r.i] = np.frombuffer(r.inner, np.float32)
    weights = {}
    for k, v in vectors.items():
        p = np.array(frequency[k], np.float32) / totals[k]
        weights[k] = RARE / (RARE + p)
        n = sizes.get(k, 0)
        present = np.abs(v).sum(1, keepdims=True) > 0
        v -= present * ((p[:n, None] * v[:n]).sum(0) / max(1e-9, float(p[:n].sum())))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    dictionary = defaultdict(list)
    for r in seed_pairs(counts, core).collect():
        dictionary[r.lang].append((r.a, r.b, r.ratio))
    terms = [(r.term, r.translation, r.language) for r in glossary.select("term", "translation", "language").collect()]
    index = vocabulary.get(PIVOT, {})
    for k in vectors:
        if k == PIVOT or PIVOT not in vectors:
            continue
        x, y, w = [], [], []
        for a, b, sure in dictionary.get(k, ()):
            x.append(vectors[k][vocabulary[k][a]])
            y.append(vectors[PIVOT][index[b]])
            w.append(math.sqrt(sure))
        for term, translation, direction in terms:
            if (direction or "").lower().strip() == f"{k}_to_{PIVOT}" and term and translation:
                mine = [vocabulary[k][t] for t in words(term.strip().lower(), k) if t in vocabulary[k]]
                theirs = [index[t] for t in words(translation.strip(), PIVOT) if t in index]
                if mine and theirs:
                    x.append(vectors[k][mine].mean(0))
                    y.append(vectors[PIVOT][theirs].mean(0))
                    w.append(6.0)
        if len(x) >= 5:
            scale = np.array(w, np.float32)[:, None]
            vectors[k] = vectors[k] @ procrustes(np.stack(x) * scale, np.stack(y) * scale)
    return Space({k: (vocabulary[k], np.round(127 * vectors[k]).astype(np.int8), weights[k], sizes.get(k, 0)) for k in vectors})


def _fit_core(sizes: dict[str, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """:func:`fit_vectors` of one language, whose cells are at most ``CORE_SHARE`` ** -2."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        size = sizes[cells["lang"].iloc[0]]
        counts = np.zeros((size, size), np.float32)
        counts[cells["i"], cells["j"]] = cells["n"]
        inner, outer = fit_vectors(counts)
        return pd.DataFrame({"lang": cells["lang"].iloc[0], "i": np.arange(size, dtype=np.int32), "inner": [x.tobytes() for x in inner], "outer": [x.tobytes() for x in outer], "n": counts.sum(0).astype(float)})

    return run


def _fold(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """:func:`fold_vectors` of words with their counts, a few hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, contexts, counts = (c.to_pylist() for c in batch.columns)
            out: dict[int, bytes] = {}
            for k in sorted(set(langs)):
                outer, frequency = shared.value[k]
                mine = [r for r, lang in enumerate(langs) if lang == k]
                for first in range(0, len(mine), 256):
                    some = mine[first : first + 256]
                    cells = np.zeros((len(some), len(outer)), np.float32)
                    for row, r in enumerate(some):
                        cells[row, contexts[r]] = counts[r]
                    out.update((r, v.tobytes()) for r, v in zip(some, fold_vectors(cells, outer, frequency)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32()), pa.array([out[r] for r in range(len(langs))], pa.binary())], names=["lang", "i", "inner"])

    return run


def seed_pairs(counts: DataFrame, core: DataFrame) -> DataFrame:
    """(lang, a, b, ratio): words and pivot words that choose each other by
    log-likelihood ratio, in segments of one sentence on either side."""
    seeds = counts.filter("what = 'seed' AND n >= 2").select("lang", "a", "b", "n")
    of = lambda what, key, name: counts.filter(F.col("what") == what).select("lang", F.col("a").alias(key), F.col("n").alias(name))
    own = core.select("lang", F.col("b").alias("a"))
    pivot = core.filter(F.col("lang") == PIVOT).select("b")
    sides = counts.filter("what = 'sides'").select("lang", F.col("n").alias("total"))
    # Frequent words and languages are few enough to be broadcast.
    kept = seeds.join(F.broadcast(own), ["lang", "a"], "left_semi").join(F.broadcast(pivot), "b", "left_semi").join(F.broadcast(sides), "lang")
    kept = kept.join(of("mine", "a", "mine"), ["lang", "a"]).join(of("theirs", "b", "theirs"), ["lang", "b"])
    scored = kept.select("lang", "a", "b", log_likelihood(F.col("n"), F.col("mine"), F.col("theirs"), F.col("total")).alias("ratio")).filter(F.col("ratio") >= SEED_SURE)
    by_a, by_b = Window.partitionBy("lang", "a"), Window.partitionBy("lang", "b")
    best = scored.withColumn("_a", F.max("ratio").over(by_a)).withColumn("_b", F.max("ratio").over(by_b))
    return best.filter((F.col("ratio") >= 0.999 * F.col("_a")) & (F.col("ratio") >= 0.5 * F.col("_b"))).select("lang", "a", "b", "ratio").orderBy("lang", "a", "b")


def log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """:func:`sentences.dunning` as a column."""
    both, first, second, total = (c.cast("double") for c in (both, first, second, total))
    fit = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    rest, others = F.greatest(second - both, F.lit(0.0)), F.greatest(total - first, F.lit(1e-9))
    p, p1, p2 = second / total, both / first, rest / others
    ratio = 2 * (fit(both, first, p1) + fit(rest, others, p2) - fit(both, first, p) - fit(rest, others, p))
    return F.when(p1 >= p, ratio).otherwise(-ratio)


def align(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(seg_id, orig_start, trans_start, orig_end, trans_end) of sentence pairs in
    paragraphs. Glossary and space are small and bounded (see ``WORD_SHARE``)."""
    context = segments.sparkSession.sparkContext
    model = context.broadcast(sentences.learn(segments.filter("kind = 'paragraph'"), ("original", "translated")))
    pairs = materialize(cut_pairs(sentences.latest(segments, ("paragraph",), ("original", "translated")), model))
    space = context.broadcast(learn(pairs, glossary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for seg_id, a, b, tongues in _pairs_of(batch):
                texts = [s for _, s in a], [s for _, s in b]
                for i, j in pair_sentences(*texts, tongues, space.value):
                    if not same_language(texts[0][i], texts[1][j], tongues):
                        rows.append((seg_id, a[i][0], b[j][0], a[i][0] + len(a[i][1]), b[j][0] + len(b[j][1])))
            columns = list(zip(*rows)) or [[] for _ in range(5)]
            types = (pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["seg_id", "orig_start", "trans_start", "orig_end", "trans_end"])

    return pairs.mapInArrow(run, "seg_id bigint, orig_start int, trans_start int, orig_end int, trans_end int")


def same_language(a: str, b: str, tongues: tuple[str, str]) -> bool:
    """Whether two sentences are in one language, though their sides aren't."""
    kinds = []
    for text, side in ((a, tongues[0]), (b, tongues[1])):
        plain = langid.plain_language(text)
        kinds.append(plain or side)
    return kinds[0] == kinds[1]
