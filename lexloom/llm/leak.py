"""Evaluation texts leaking into training text.

Texts are folded to lower-case letters and digits, so case, marks and spacing don't
count. A window is sized by its item: the widest of a ladder of widths that stays
within half of the shortest passage that counts. Windows start at anchors, which the
letters themselves define (the least hash of every so many neighbouring positions),
so a passage has the same anchors in item and document, however its words are
spaced, joined or broken. A random walk embeds each window (at every step it emits
the current letter, and a random bit of step and letter decides whether it moves
on), which turns edits into differing steps. Repeated samples of steps are the keys
of a locality-sensitive hash; documents look their keys up in the items' table.

Every candidate is verified exactly: around the places that share a key, the best
local alignment of the item's letters with the document's, at one for a letter that
agrees and minus one for an edit, gives the longest running passage in common; a pair
counts where that passage makes up the wanted share of the item.

The items are held-out material of any number: they are taken in blocks of bounded
size (``BLOCK_LETTERS``), each block's table is broadcast, and every block is set
against all documents. Documents are not shuffled, and no step depends on other
documents. An anchor of wider windows is one of narrower windows too, so one walk
gives the keys of all widths.

Defined results: null and blank texts and items match nothing; an item too short for
a window is sought whole, from the start of a word to the end of one; repeated items
and documents give repeated pairs only as often as they have ids; other columns are
dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths of windows, and the least item that has one.
WIDTHS = (8, 16, 32, 64, 128, 256)
LEAST_ITEM = 20
WALKS, SAMPLES = 2, 3
#: Steps that make a key, in narrow and in wide scripts.
BITS, WIDE_BITS = 10, 7
#: The share of an item that a passage must hold: "about two fifths".
SHARE = 0.33
#: Letters of the items in one broadcast table, about; more items make more tables.
BLOCK_LETTERS = 2_000_000
#: Characters of text scanned at once; bounds a worker's memory, not the text.
CHUNK = 1_000_000
#: Letters whose hash makes an anchor.
GRAM = 4
_SEED = 20_240_501
_END = 1

_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower-case letters and digits as they are, 0 for everything else."""
    global _folded
    if _folded is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000 and ((ch := chr(c)).isalnum() or 0x0E31 <= c <= 0x0E4E):
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0xFF10:0xFF1A] = np.arange(48, 58)
        table[_END] = _END
        _folded = table
    return _folded


def _wide(letters: np.ndarray) -> np.ndarray:
    return ((letters >= 0x2E80) & (letters < 0xAC00)) | ((letters >= 0x0E00) & (letters < 0x0E80))


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters, and where words start among them."""
    letters = _fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    kept = letters != 0
    before = np.concatenate(([False], (kept & (letters != _END))[:-1]))
    wide = _wide(letters)
    start = kept & (~before | wide | np.concatenate(([False], wide[:-1])))
    return letters[kept], np.flatnonzero(start[kept])


def width_of(letters: int, share: float = SHARE) -> int:
    """The width of an item's windows: half of the shortest passage that counts, at most."""
    return max([w for w in WIDTHS if w <= letters * share / 2 * 1.2] or WIDTHS[:1])


def _grams(letters: np.ndarray) -> np.ndarray:
    """A hash of the letters from each place on."""
    out = np.zeros(len(letters), np.uint32)
    for i in range(GRAM):
        out[: len(letters) - i] += (letters[i:] + np.uint32(11)) * np.uint32(0x9E3779B1 + 2 * 0x3C6EF372 * i & 0xFFFFFFFF)
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x85EBCA6B)
    return out ^ out >> np.uint32(13)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """The places with the least hash of each ``width / 2`` neighbours."""
    span = max(2, width // 2)
    if len(grams) < span:
        return np.zeros(0, np.intp)
    ranked = grams.astype(np.uint64) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        ranked = np.minimum(ranked[:-reach], ranked[reach:])
        reach *= 2
    return np.unique((ranked & np.uint64(0xFFFFFFFF)).astype(np.intp))


class Walks:
    """Random walks and the steps sampled from each; the same in every process."""

    def __init__(self) -> None:
        rng = np.random.default_rng(_SEED)
        steps = 2 * WIDTHS[-1]
        self.moves = rng.integers(0, 2, (WALKS, steps, 4096), np.uint8)
        self.mix = rng.integers(1, 1 << 62, steps, np.uint64) | np.uint64(1)
        self.samples = {(wide, w): [[np.sort(rng.choice(int(1.7 * w), bits, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)] for wide, bits in ((False, BITS), (True, WIDE_BITS)) for w in WIDTHS}

    def keys(self, letters: np.ndarray, starts: dict[int, np.ndarray], wide: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """(width, number of the table, keys) of the windows from ``starts`` of each
        width, which all end inside ``letters``; the starts of a width are among those
        of the width before."""
        # A walk may leave its window, and the letters: past their end all are alike.
        padded = np.concatenate((letters, np.full(2 * max(starts, default=0), 2, np.uint32)))
        low, values = (padded & 4095).astype(np.intp), padded.astype(np.uint64) + np.uint64(7)
        for walk in range(WALKS):
            step, at, here = 0, None, np.zeros(0, np.intp)
            sums: dict[int, list[np.ndarray]] = {w: [np.zeros(len(s), np.uint64) for _ in range(SAMPLES)] for w, s in starts.items()}
            wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for w in starts:
                for n, steps in enumerate(self.samples[wide, w][walk]):
                    for s in steps.tolist():
                        wanted[s].append((w, n))
            for width in sorted(starts):
                # Only the wider windows walk on.
                at = starts[width].copy() if at is None else at[np.searchsorted(here, starts[width])]
                here = starts[width]
                among = {w: np.searchsorted(here, starts[w]) for w in starts if w > width}
                last = int(1.7 * width)
                while step < last:
                    for w, n in wanted.get(step, ()):
                        if w >= width:
                            got = values[at] if w == width else values[at[among[w]]]
                            total = sums[w][n]
                            total += got * self.mix[step]
                            total ^= total >> np.uint64(29)
                    at += self.moves[walk, step][low[at]]
                    step += 1
                for n in range(SAMPLES):
                    yield width, walk * SAMPLES + n, sums[width][n]


_walks: Walks | None = None


def walks() -> Walks:
    global _walks
    if _walks is None:
        _walks = Walks()
    return _walks


def starts_of(letters: np.ndarray, widths: set[int], wide: bool) -> dict[int, np.ndarray]:
    """The starts of the windows of each width, in one kind of script."""
    if not widths or not len(letters):
        return {}
    grams, kind = _grams(letters), _wide(letters)
    out = {}
    for w in sorted(widths):
        found = anchors(grams, w)
        found = found[(kind[found] == wide) & (found + w <= len(letters))]
        out[w] = found if w == min(widths) else np.intersect1d(found, out[prior], assume_unique=True)
        prior = w
    return {w: s for w, s in out.items()}


def _whole(letters: np.ndarray, starts: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, keys) of the strings of each size that begin at ``starts``."""
    mix = walks().mix
    at, keys = starts, np.zeros(len(starts), np.uint64)
    for step in range(max(sizes, default=0)):
        inside = at + step < len(letters)
        at, keys = at[inside], keys[inside]
        keys += (letters[at + step].astype(np.uint64) + np.uint64(7)) * mix[step]
        keys ^= keys >> np.uint64(29)
        if step + 1 in sizes:
            yield step + 1, at, keys.copy()


class Items:
    """A block of items: their letters and their tables of keys."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE):
        self.share = share
        self.ids, self.letters, self.words = [], [], []
        found: dict[tuple, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        self.widths: dict[bool, set[int]] = {False: set(), True: set()}
        for item_id, text in items:
            letters, starts = fold(text or "")
            if not len(letters):
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.letters.append(letters)
            short = len(letters) < LEAST_ITEM
            self.words.append(words_of(text) if short else None)
            if short:
                for size, at, keys in _whole(letters, starts[:1], {len(letters)}):
                    found["whole", size].append((keys, number, at))
                continue
            width, wide = width_of(len(letters), share), bool(2 * _wide(letters).sum() > len(letters))
            mine = starts_of(letters, {width}, wide)
            self.widths[wide].add(width)
            for w, table, keys in walks().keys(letters, mine, wide):
                found[wide, w, table].append((keys, number, mine[w]))
        self.tables = {}
        for place, parts in found.items():
            keys = np.concatenate([k for k, _, _ in parts])
            numbers = np.concatenate([np.full(len(k), n, np.int32) for k, n, _ in parts])
            at = np.concatenate([a for _, _, a in parts]).astype(np.int32)
            order = np.argsort(keys, kind="stable")
            self.tables[place] = keys[order], numbers[order], at[order]

    def candidates(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``letters``, number of the item, place in the item) of shared keys."""
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for wide in (False, True):
            mine = starts_of(letters, self.widths[wide], wide)
            for w, table, keys in walks().keys(letters, mine, wide) if mine else ():
                self._look_up((wide, w, table), keys, mine[w], hits)
        # Items too short for a window are sought whole.
        for size, mine, keys in _whole(letters, starts, {place[1] for place in self.tables if place[0] == "whole"}):
            self._look_up(("whole", size), keys, mine, hits)
        if not hits:
            return (np.zeros(0, np.intp),) * 3
        return tuple(np.concatenate(column) for column in zip(*hits))

    def _look_up(self, place: tuple, keys: np.ndarray, at: np.ndarray, hits: list) -> None:
        if place not in self.tables:
            return
        known, numbers, item_at = self.tables[place]
        low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
        some = np.flatnonzero(high > low)
        if not len(some):
            return
        many = high[some] - low[some]
        first = np.repeat(low[some] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        hits.append((np.repeat(at[some], many), numbers[first].astype(np.intp), item_at[first].astype(np.intp)))

    def find(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(index of the text, number of the item, share held) of the pairs that count."""
        letters, starts = fold("\x01".join(t.replace("\x01", " ") for t in texts) + "\x01")
        ends = np.flatnonzero(letters == _END)
        begins = np.concatenate(([0], ends[:-1] + 1))
        at, number, item_at = self.candidates(letters, starts[letters[starts] != _END])
        if not len(at):
            return []
        owner = np.searchsorted(ends, at)
        order = np.lexsort((at, number, owner))
        best: dict[tuple[int, int], float] = {}
        rows = np.stack((owner, number, at, item_at), 1)[order]
        size = np.array([len(x) for x in self.letters])[rows[:, 1]]
        # Where the item would lie in the document, with room for letters put in.
        low = np.maximum(begins[rows[:, 0]], rows[:, 2] - rows[:, 3] - rows[:, 3] // 4 - 16)
        high = np.minimum(ends[rows[:, 0]], rows[:, 2] + (size - rows[:, 3]) + (size - rows[:, 3]) // 4 + 16)
        i = 0
        while i < len(rows):
            j, start, stop = i + 1, int(low[i]), int(high[i])
            while j < len(rows) and rows[j, 0] == rows[i, 0] and rows[j, 1] == rows[i, 1] and low[j] <= stop:
                start, stop, j = min(start, int(low[j])), max(stop, int(high[j])), j + 1
            pair = int(rows[i, 0]), int(rows[i, 1])
            part = self.verify(pair[1], letters[start:stop], texts[pair[0]])
            best[pair] = max(part, best.get(pair, 0.0))
            i = j
        return [(*pair, part) for pair, part in sorted(best.items()) if part >= self.share]

    def verify(self, number: int, letters: np.ndarray, text: str) -> float:
        if (words := self.words[number]) is not None:
            # A short item must stand as whole words.
            there = words_of(text)
            return float(any(there[i : i + len(words)] == words for i in range(len(there) - len(words) + 1)))
        return shared_part(self.letters[number], letters)


_PIECE = re.compile(r"[぀-ヿ㐀-鿿]|[฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")


def words_of(text: str) -> list[str]:
    """Words; single letters in wide scripts."""
    return _PIECE.findall((text or "").lower())


def _best_end(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score and end (in item, in text) of the best local alignment; a letter that
    agrees gives one, an edit costs one."""
    ramp = np.arange(len(text) + 1, dtype=np.int32)
    row, best = np.zeros(len(text) + 1, np.int32), (0, 0, 0)
    new = np.empty_like(row)
    same = {int(c): np.where(text == c, 1, -1).astype(np.int32) for c in np.unique(item)}
    for i, letter in enumerate(item.tolist()):
        np.subtract(row, 1, out=new)
        np.maximum(new[1:], row[:-1] + same[letter], out=new[1:])
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, out=new)
        new -= ramp
        at = int(new.argmax())
        if (top := int(new[at])) > best[0]:
            best = top, i + 1, at
        row, new = new, row
    return best


def shared_part(item: np.ndarray, text: np.ndarray) -> float:
    """The share of the item's letters that its longest running passage in the text
    holds."""
    if not len(item) or not len(text):
        return 0.0
    score, end, text_end = _best_end(item, text)
    if not score:
        return 0.0
    _, length, _ = _best_end(item[:end][::-1], text[:text_end][::-1])
    return length / len(item)


def _scan(documents: DataFrame, rows: list[tuple[int, str]], share: float, id_col: str, text_col: str) -> DataFrame:
    table = documents.sparkSession.sparkContext.broadcast(Items(rows, share))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple] = []
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                out += [(keys[first + index], known.ids[number], part) for index, number, part in known.find(texts[first:last])]
                first = last
            columns = list(zip(*out)) or [[], [], []]
            types = (batch.column(0).type, pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[id_col, "item_id", "shared"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, item_id bigint, shared double")


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(id_col, item_id, shared): documents that hold at least ``share`` of an item
    in one running passage, and the share they hold."""
    known = items.select("item_id", "item_text").distinct()
    letters = known.agg(F.sum(F.length("item_text") + 64)).first()[0] or 0
    blocks = -(-letters // block_letters) or 1
    block = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks))
    parts = []
    for n in range(blocks):
        # One block of items at a time is on the driver.
        rows = [(r[0], r[1]) for r in known.filter(block == n).orderBy("item_id", "item_text").collect()]
        parts.append(_scan(documents, rows, share, id_col, text_col))
    return reduce(DataFrame.unionByName, parts)
