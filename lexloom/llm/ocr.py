"""Noise in text from scanned pages: found by line, and repaired.

The cluster counts words, pairs of words, pairs of Han letters and the documents at
whose page tops a text stands. Words that the corpus has often make the vocabulary, a
trie; a Levenshtein automaton of each suspicious word is intersected with it, which
retrieves every word within two edits (one in short words). Each candidate has a
weight by what turns it into the word at hand: known misreadings count in full, any
other letter in a letter's place by how many different words of the corpus show it.
Candidates are ranked by how often they follow the word before, then by weight and
frequency; a word is a misreading when weight times frequency exceeds its own
frequency many times. A word with a digit or mark inside that has no candidate is
spelled: misreadings are undone, and the form counts whose letter triples the
vocabulary has. Han letters are compared with all letters that stand between the same
neighbours. Page numbers, running headers (also misread ones, by edit distance) and
words broken at line ends come from the layout of the document.

Repairing removes page furniture, puts broken words together, corrects misread
ones, and joins the lines of each paragraph.

Defined results: null and blank contents have no noise; a document with several
versions counts by its newest; documents that show no trace of pages are left as
they are; code and tables are never touched; one line may have two kinds of noise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

#: Statistics are kept from this count and share of their kind on, so at most
#: 1 / share of a kind are broadcast. What was not kept counts as ``UNKEPT`` of the least,
#: so that whatever was kept may be the reading of what was not, at every size.
LEAST_COUNT, LEAST_SHARE, UNKEPT = 4, 1e-6, 0.03
#: A page-top text is known from this many documents and share of the scanned ones on.
TOP_COUNT, TOP_SHARE = 2, 0.004
#: A reading so many times as frequent as the word at hand is the true one.
TIMES = 30
#: Weight of a letter in another's place that no other word shows, and the number of
#: different words that halve what is missing to a weight of one.
STRANGE, SHOWN = 0.2, 4
#: Misreadings of printed letters, true first (fixed values).
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("s", "5"), ("i", "!"), ("o", "0"), ("l", "1"), ("h", "b"), ("g", "9"), ("b", "6"),
    ("n", "ri"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("w", "vv"), ("i", "1"), ("l", "!"), ("z", "2"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"),
)

_ROMAN = r"[ivxlc]{1,7}"
_PAGE = re.compile(rf"^\f?\s*(?:[-–—]\s?\d{{1,4}}\s?[-–—]|\[\d{{1,4}}\]|第\s?\d{{1,4}}\s?[页頁]|(?:p|pp|S|стр|с)\.\s?\d{{1,4}}|(?:Page|page|Seite|Página|página)\s\d{{1,4}}(?:\s(?:of|von|sur|de|/)\s\d{{1,4}})?|\d{{1,4}}(?:\s?/\s?\d{{1,4}})?|{_ROMAN})\s*$")
_NUMBERED = re.compile(rf"^\f?\s*(?:(?:\d{{1,4}}|{_ROMAN})\s{{2,}}(?P<a>\S.*?)|(?P<b>\S.*?)\s{{2,}}(?:\d{{1,4}}|{_ROMAN}))\s*$")
_TABLE = re.compile(r"^\s*(?:\||\d+(?:\s{2,}\d+)+\s*$|<table)")
_HEADING = re.compile(r"^\s*(?:#|\d{1,2}\.? +\S.{0,40}$)")
_SKIP = re.compile(r"^\s*(?:!\[|\*\*|\[\d+\]|[-*] )")
_BROKEN = re.compile(r"[^\W\d_][-­‐‑¬]$")
_TOKEN = re.compile(r"[^\s\"“”„«»‹›()\[\]（）「」,;:，。；：、？！?]+")
_LATIN = re.compile(r"^[^\W\d_぀-鿿]+$")
_HAN = re.compile(r"[一-鿿]+")
_PLAIN = re.compile(r"[\d\W_]+")


class Line:
    """One line and its part in the page: body, blank, page, header, table, code, heading."""

    __slots__ = ("broken", "part", "text")

    def __init__(self, text: str):
        self.text = text[:-1] if text.endswith("\r") else text
        self.part, self.broken = "body", False


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits turn one text into the other."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _plain(text: str) -> str:
    return _PLAIN.sub(" ", text).strip().lower()


def _alike(a: str, b: str) -> bool:
    return bool(a and b) and near(a, b, max(1, min(4, len(a) // 6)))


def _begins(plain: str, known: dict[str, int]) -> bool:
    """Whether a text is one of the known ones, or one and a name."""
    # Two edits leave one of two triples of letters as it was.
    heads = plain[:3], plain[3:6]
    return any((k[:3] == heads[0] or k[3:6] == heads[1]) and 5 <= len(k) and len(plain) <= len(k) + (14 if " " in k or not k.isascii() else 1) and near(plain[: len(k)], k, 2 if len(k) > 8 else 1) for k in known)


def read_lines(content: str) -> list[Line]:
    """Lines with code, tables, headings and blanks told apart."""
    lines = [Line(t) for t in content.split("\n")]
    fenced = False
    for line in lines:
        bare = line.text.strip()
        if bare.startswith("```"):
            fenced, line.part = not fenced, "code"
        elif fenced:
            line.part = "code"
        elif not bare:
            line.part = "blank"
        elif _TABLE.match(line.text):
            line.part = "table"
        elif _HEADING.match(line.text) and not _PAGE.match(line.text) and not _NUMBERED.match(line.text):
            line.part = "heading"
        elif _SKIP.match(line.text) and not _PAGE.match(line.text):
            line.part = "other"
    return lines


def page_tops(lines: list[Line]) -> Iterator[tuple[int, str]]:
    """(index, text without number) of lines that may be running headers: numbered
    ones, and the first after a page number or form feed."""
    after = False
    for i, line in enumerate(lines):
        if line.part == "blank":
            after = after or "\f" in line.text
            continue
        if line.part in ("code", "table", "heading"):
            after = False
            continue
        numbered = _NUMBERED.match(line.text)
        if numbered and re.search(r"[^\W\d_]{2}", numbered["a"] or numbered["b"]):
            yield i, numbered["a"] or numbered["b"]
            after = False
        elif _PAGE.match(line.text):
            after = True
        elif after or line.text.startswith("\f"):
            yield i, line.text.strip()
            after = False


def mark_furniture(lines: list[Line], known: dict[str, int]) -> None:
    """Set the parts "page" and "header". ``known``: texts that stand at page tops
    throughout the corpus."""
    first = next((i for i, line in enumerate(lines) if line.part not in ("blank", "code")), 0)
    title = _plain(lines[first].text.lstrip("#")) if lines else ""
    for i, line in enumerate(lines):
        if line.part == "body" and _PAGE.match(line.text) and i != first:
            line.part = "page"
    tops = {i: text for i, text in page_tops(lines) if i != first}
    plains = {i: _plain(t.split(" | ")[0] if " | " in t else t) for i, t in tops.items()}
    # Short lines that come again are headers too where no number shows it.
    short = {i: _plain(line.text) for i, line in enumerate(lines) if i != first and line.part == "body" and len(line.text) <= 90 and not re.search(r"[.!?。！？,，;；:：][\"”»」）)]*\s*$", line.text) and not line.text.lstrip().startswith("#")}
    often = Counter(p for p in short.values() if len(p) >= 4)
    for i, line in enumerate(lines):
        if i == first or line.part not in ("body", "other"):
            continue
        bare = line.text.strip().lstrip("\f")
        piped = " | " in bare and not bare.startswith("|")
        if i in tops:
            plain = plains[i]
            ended = bool(re.search(r"[.!?。！？][\"”»」）)]*$", bare)) and not re.search(r"et al\.?$|Vol\.\s?\S{1,5}$", bare)
            if _NUMBERED.match(line.text) and not ended and len(bare) <= 110:
                line.part = "header"
            elif len(plain) >= 4 and not re.search(r"[。！？]", bare) and (_alike(plain, title) or any(_alike(plain, p) for j, p in plains.items() if j != i) or _begins(plain, known)):
                line.part = "header"
            elif not ended and piped:
                line.part = "header"
            elif len(bare) <= 30 and bare[:1].isupper() and re.match(r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9'-]{3,20}(?:[ .]\S{1,3} \S{1,3}\.?)?$", bare):
                line.part = "header"
        elif len(bare) <= 70 and bare[:1].upper() == bare[:1] and not bare.startswith("#") and _begins(_plain(bare), known) and not re.search(r"[.!?。！？][\"”»」）)]*$", bare):
            line.part = "header"
        elif piped and len(bare) <= 90 and (_plain(bare.split(" | ")[0]) in known or bare.upper() == bare or often[short.get(i, "")] > 1):
            line.part = "header"
        elif i in short and line.part == "body" and len(short[i]) >= 6 and (_alike(short[i], title) or short[i] in known or any(_alike(short[i], p) for j, p in plains.items() if lines[j].part == "header")):
            line.part = "header"


def mark_broken(lines: list[Line]) -> list[tuple[int, int]]:
    """(line, next body line) of words broken at a line's end."""
    out = []
    body = [i for i, line in enumerate(lines) if line.part in ("body", "other")]
    for i, j in zip(body, body[1:]):
        text = lines[i].text.rstrip()
        if _BROKEN.search(text):
            after = lines[j].text.strip().lstrip("\f")
            between = {lines[k].part for k in range(i + 1, j)}
            label = bool(re.search(r"[A-Z]{4,}-$", text)) and after[:1].isdigit() and not between
            if label or after[:1].isalpha() and "heading" not in between and not ("blank" in between and not between & {"page", "header"} and after[:1].isupper()):
                lines[i].broken = True
                out.append((i, j))
    return out


def is_scanned(lines: list[Line]) -> bool:
    """Page furniture, broken words, or lines wrapped at one width."""
    if any(line.part in ("page", "header") or line.broken for line in lines):
        return True
    sizes = [len(line.text) for line in lines if line.part == "body"]
    return len(sizes) >= 8 and max(sizes) <= 110 and median(sizes) >= 0.75 * max(sizes)


class Trie:
    """A vocabulary, read from both ends; :meth:`within` intersects it with a Levenshtein
    automaton."""

    def __init__(self, words: Iterator[str], counts: dict[str, int] | None = None):
        self._ends: tuple[dict, dict] = {}, {}
        for word in words:
            n = counts[word] if counts else 0
            for node, letters in zip(self._ends, (word, word[::-1])):
                for ch in letters:
                    node = node.setdefault(ch, {0: 0})
                    # The greatest count of the words below.
                    node[0] = max(node[0], n)
                node[""] = word

    def within(self, word: str, most: int, least: float = 0) -> list[str]:
        """All words at most ``most`` (two or fewer) edits away that count at least
        ``least``. Either the first half of ``word`` has fewer edits than all of it, or
        the second half has none, so one search from each end finds them all, and
        neither branches much before the middle."""
        half = len(word) // 2
        found = set(self._search(0, word, most, least, [half if d == most > 0 else 0 for d in range(most + 1)]))
        if most:
            found.update(self._search(1, word[::-1], most, least, [len(word) - half if d else 0 for d in range(most + 1)]))
        return list(found)

    def _search(self, end: int, word: str, most: int, least: float, free: list[int]) -> Iterator[str]:
        """A state of the automaton is one set of positions in ``word`` (bits) for each
        number of edits made so far; ``free`` has the first position for each number."""
        whole = (1 << (len(word) + 1)) - 1
        allowed = [whole & ~((1 << f) - 1) for f in free]
        final = 1 << len(word)
        at: dict[str, int] = {}
        for j, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << (j + 1)
        stack = [(self._ends[end], tuple(((1 << (d + 1)) - 1) & allowed[d] for d in range(most + 1)))]
        while stack:
            node, state = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if any(s & final for s in state):
                        yield child
                    continue
                if ch == 0 or child[0] < least:
                    continue
                reads = at.get(ch, 0)
                low = alive = (state[0] << 1) & reads
                moved = [low]
                for d in range(1, most + 1):
                    # A letter read, put in, put in another's place, or left out.
                    low = (((state[d] << 1) & reads) | state[d - 1] | (state[d - 1] << 1) | (low << 1)) & allowed[d]
                    moved.append(low)
                    alive |= low
                if alive:
                    stack.append((child, tuple(moved)))


def explained(true: str, seen: str, most: int = 2) -> int | None:
    """Where the first of at most ``most`` misreadings that turn ``true`` into
    ``seen`` stands in ``seen``; None if they don't."""

    def walk(i: int, j: int, left: int, first: int) -> int | None:
        while i < len(true) and j < len(seen) and true[i] == seen[j]:
            hit = next_step(i, j, left, first)
            if hit is not None:
                return hit
            i, j = i + 1, j + 1
        if i == len(true) and j == len(seen):
            return first if first >= 0 else None
        return next_step(i, j, left, first)

    def next_step(i: int, j: int, left: int, first: int) -> int | None:
        if left:
            for good, bad in CONFUSIONS:
                if true.startswith(good, i) and seen.startswith(bad, j):
                    hit = walk(i + len(good), j + len(bad), left - 1, first if first >= 0 else j)
                    if hit is not None:
                        return hit
        return None

    return walk(0, 0, most, -1)


def changed(true: str, seen: str) -> int | None:
    """The place of the one letter in which two words of a length differ, but for case."""
    if len(true) != len(seen):
        return None
    places = [i for i, (x, y) in enumerate(zip(true, seen)) if x != y]
    return places[0] if len(places) == 1 and true.lower() != seen.lower() else None


class Statistics:
    """Counts of the corpus, and readings derived from them. ``least`` has the count from
    which each kind was kept, ``weights`` what is known of letters in other letters' places."""

    def __init__(self, counts: dict[str, dict[str, int]], least: dict[str, float] | None = None, weights: dict[tuple[str, str], float] | None = None):
        self.words, self.pairs, self.han, self.tops = (counts.get(k, {}) for k in ("word", "pair", "han", "top"))
        self.least, self.weights = least or {}, weights or {}
        self._fresh()

    def _fresh(self) -> None:
        self._trie: Trie | None = None
        self._triples: set[str] | None = None
        self._readings: dict[str, list[tuple[str, float, int]]] = {}
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._letters: dict[str, str | None] = {}
        self._most = max(self.words.values(), default=0)

    def __getstate__(self) -> dict:
        return {"words": self.words, "pairs": self.pairs, "han": self.han, "tops": self.tops, "least": self.least, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def trusted(self, word: str) -> float:
        """The count from which a word may be what ``word`` should be."""
        return TIMES * max(self.words.get(word, 0), self._unkept("word"))

    def _unkept(self, kind: str) -> float:
        """What an entry counts that is known only to be rarer than those kept."""
        return max(0.2, UNKEPT * self.least.get(kind, LEAST_COUNT))

    def _common(self, word: str) -> bool:
        """Whether a word is more than a name."""
        return self.words.get(word.lower(), 0) >= 2 * self.words.get(word.capitalize(), 0)

    def candidates(self, word: str) -> Iterator[tuple[str, float, int]]:
        """(word of the vocabulary, weight, place of the first change) of every word
        that an edit or two turn into ``word``; weight 0 where nothing speaks for it."""
        if self._trie is None:
            self._trie = Trie(iter(self.words), self.words)
        least = self.trusted(word)
        if least > self._most:
            return
        for form in {word, word.lower()}:
            for c in self._trie.within(form, 2 if len(form) >= 5 else 1, least):
                if c.lower() == form.lower():
                    continue
                if (at := explained(c, form)) is not None:
                    yield c, 1.0, at
                elif len(word) >= 5 and word.islower() and (at := changed(c, form)) is not None and self._common(c):
                    yield c, self.weights.get((c[at].lower(), form[at].lower()), STRANGE), at
                else:
                    yield c, 0.0, 0

    def readings(self, word: str) -> list[tuple[str, float, int]]:
        """Words that ``word`` may be a misreading of, likeliest first, with weight and
        place of the first change."""
        if (known := self._readings.get(word)) is None:
            if len(self._readings) > 200_000:
                self._readings = {}
            least = self.trusted(word)
            found = {c: (weight, at) for c, weight, at in self.candidates(word) if weight * self.words[c] >= least}
            known = sorted(((c, *x) for c, x in found.items()), key=lambda x: (-x[1] * self.words[x[0]], x[0]))
            self._readings[word] = known
        return known

    def best(self, word: str, before: str) -> tuple[str, int] | None:
        """The likeliest reading after the word before, and the place of its first change."""
        found = self.readings(word)
        if not found:
            return None
        # What misreadings explain goes before other letters in letters' places.
        c, _, at = max(found, key=lambda x: (x[1] >= 1, self.pairs.get(f"{before} {x[0]}", 0), x[1] * self.words[x[0]]))
        return c, at

    def spelled(self, word: str) -> tuple[str, int] | None:
        """A word with digits or marks inside with its misreadings undone, where all its
        letter triples stand in the vocabulary; and the place of the first of them."""
        strange = [i for i, ch in enumerate(word) if not ch.isalpha()] if not word.isalpha() else []
        if not 1 <= len(strange) <= 2 or len(word) < 4:
            return None
        if self._triples is None:
            self._triples = {f" {w.lower()} "[i : i + 3] for w in self.words for i in range(len(w))}
        forms = [word]
        for i in strange:
            forms = [f[:i] + good + f[i + 1 :] for f in forms for good, bad in CONFUSIONS if bad == word[i] and len(good) == 1]
        known = [f for f in forms if all(f" {f.lower()} "[i : i + 3] in self._triples for i in range(len(f)))]
        return (known[0], strange[0]) if known else None

    def misread_han(self, left: str, letter: str, right: str) -> str | None:
        """The letter that fits far better between its neighbours, if there is one."""
        here = left + letter + right
        if here in self._letters:
            return self._letters[here]
        rare = 1.5 * self._unkept("han")
        mine_left, mine_right = max(rare, self.han.get(left + letter, 0)), max(rare, self.han.get(letter + right, 0))
        if not self._left:
            for pair, n in self.han.items():
                self._left.setdefault(pair[0], []).append((pair[1], n))
        best, score = None, 0
        for other, n in self._left.get(left, ()):
            m = self.han.get(other + right, 0)
            if n >= TIMES * mine_left and m >= TIMES * mine_right and min(n, m) > score:
                best, score = other, min(n, m)
        if len(self._letters) > 500_000:
            self._letters = {}
        self._letters[here] = best
        return best


def body_tokens(lines: list[Line], joins: dict[int, int]) -> Iterator[tuple[int, int | None, str, int]]:
    """(line, second line or None, token, length of its part on the first line) of the body."""
    taken: set[int] = set()
    for i, line in enumerate(lines):
        if line.part not in ("body", "other"):
            continue
        found = [m.group().strip("'’.") for m in _TOKEN.finditer(line.text)]
        found = found[1:] if i in taken else found
        if i in joins and found:
            tail = found.pop().rstrip("-­‐‑¬")
            rest = _TOKEN.search(lines[joins[i]].text)
            head = rest.group().strip("'’.") if rest else ""
            taken.add(joins[i])
            for token in found:
                yield i, None, token, len(token)
            yield i, joins[i], tail + head, len(tail)
        else:
            for token in found:
                yield i, None, token, len(token)


def han_runs(lines: list[Line]) -> Iterator[tuple[str, list[int]]]:
    """Han letters that follow each other in the body, across line ends, with their lines."""
    letters: list[str] = []
    places: list[int] = []
    for i, line in enumerate(lines):
        if line.part in ("page", "header", "table", "blank"):
            continue
        if line.part in ("code", "heading"):
            letters.append(" ")
            places.append(i)
            continue
        text = line.text.strip().lstrip("\f　")
        letters += text
        places += [i] * len(text)
    joined = "".join(letters)
    for m in _HAN.finditer(joined):
        if len(m.group()) >= 2:
            yield m.group(), places[m.start() : m.end()]


def count_document(content: str, counts: Counter) -> None:
    lines = read_lines(content)
    tops = {_plain(text.split(" | ")[0] if " | " in text else text) for _, text in page_tops(lines)}
    counts.update(("top", plain) for plain in tops if 4 <= len(plain) <= 60)
    mark_furniture(lines, {})
    joins = dict(mark_broken(lines))
    counts["scanned", ""] += is_scanned(lines)
    before = ""
    for _, _, token, _ in body_tokens(lines, joins):
        token = token.rstrip("!")
        if _LATIN.match(token):
            counts["word", token] += 1
            low = token.lower()
            if low != token:
                counts["word", low] += 1
            if before:
                counts["pair", f"{before} {token}"] += 1
            before = token
        else:
            before = ""
    if not re.search(r"[぀-ヿ]", content):
        for run, _ in han_runs(lines):
            for pair in zip(run, run[1:]):
                counts["han", "".join(pair)] += 1


def learn(contents: DataFrame, content_col: str = "content") -> Statistics:
    """Counts over all documents, summed by the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    count_document(text, counts)
            if len(counts) > 300_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    summed = materialize(contents.select(content_col).mapInArrow(run, "what string, key string, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n")))
    totals = {r.what: r.n for r in summed.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    least = {k: max(LEAST_COUNT, LEAST_SHARE * n) for k, n in totals.items()} | {"top": max(TOP_COUNT, TOP_SHARE * totals.get("scanned", 0))}
    if not totals:
        return Statistics({})
    bound = F.create_map(*[F.lit(v) for k, n in least.items() for v in (k, float(n))])[F.col("what")]
    out: dict[str, dict[str, int]] = {}
    for r in summed.filter((F.col("n") >= bound) & (F.col("what") != "scanned")).collect():
        out.setdefault(r.what, {})[r.key] = r.n
    known = Statistics(out, least)
    known.weights = weigh(summed.filter("what = 'word'"), known)
    return known


def weigh(words: DataFrame, known: Statistics) -> dict[tuple[str, str], float]:
    """The weight of each letter in another's place, by the number of different words
    (key) of the corpus that it may explain. There are at most as many as pairs of letters."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word.islower():
                    shown = {(c[at], word[at]) for c, weight, at in shared.value.candidates(word) if weight == STRANGE}
                    counts.update(shown if len(shown) == 1 else ())
        keys = list(zip(*counts)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["good", "bad", "n"])

    # Distinct words only: few bytes, much work.
    pairs = words.select("key").repartition(words.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "good string, bad string, n bigint")
    shown = pairs.groupBy("good", "bad").agg(F.sum("n").alias("n")).filter("n > 1").collect()
    return {(r.good, r.bad): 1 - (1 - STRANGE) * 0.5 ** ((r.n - 1) / SHOWN) for r in shown}


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(zip(*counts)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["what", "key", "n"])


def _suspicious(token: str, words: dict[str, int]) -> bool:
    """Whether a token may be a misread word at all."""
    bare = token.strip("-")
    if len(bare) < 3 or not re.search(r"[^\W\d_]", bare) or re.match(r"^[A-Z]{4,}-\d*$", bare):
        return False
    if _LATIN.match(bare):
        return True
    return bool(re.match(r"^[^\W_!|]*[!|]?[^\W_!|]*$", bare)) and not re.match(r"^\d+[^\W\d_]{0,2}$", bare)


def misread(lines: list[Line], joins: dict[int, int], known: Statistics, foreign: bool) -> Iterator[tuple[int, str, str]]:
    """(line, word as it stands, true word)."""
    before = ""
    for i, j, token, size in body_tokens(lines, joins):
        seen = token.rstrip("!") if token.count("!") == 1 and token.endswith("!") else token
        if _suspicious(seen, known.words):
            if (found := known.best(seen, before) or known.spelled(seen)) is not None:
                true, at = found
                yield (i if j is None or at < size else j), seen, true
                before = true
                continue
        before = seen
    if not foreign:
        for run, places in han_runs(lines):
            for k in range(1, len(run) - 1):
                if (true := known.misread_han(run[k - 1], run[k], run[k + 1])) is not None:
                    yield places[k], run[k], true


def examine(content: str, known: Statistics) -> tuple[list[Line], dict[int, int], list[tuple[int, str, str]]]:
    lines = read_lines(content)
    mark_furniture(lines, known.tops)
    joins = dict(mark_broken(lines))
    if not is_scanned(lines):
        return lines, {}, []
    return lines, joins, list(misread(lines, joins, known, bool(re.search(r"[぀-ヿ]", content))))


def noise_of(content: str | None, known: Statistics) -> list[tuple[int, str]]:
    """(line number from 1, kind of noise), sorted."""
    if not content or not content.strip():
        return []
    lines, joins, wrong = examine(content, known)
    out = {(i + 1, "hyphen") for i in joins} | {(i + 1, "ocr") for i, _, _ in wrong}
    out |= {(i + 1, "page_number" if line.part == "page" else "header") for i, line in enumerate(lines) if line.part in ("page", "header")}
    return sorted(out)


def repair(content: str | None, known: Statistics) -> str | None:
    """Continuous paragraphs without page furniture, broken or misread words."""
    if not content or not content.strip():
        return content
    lines, joins, wrong = examine(content, known)
    if not is_scanned(lines):
        return content
    fixes: dict[int, list[tuple[str, str]]] = {}
    for i, seen, true in wrong:
        fixes.setdefault(i, []).append((seen, true))
    wide = len(re.findall(r"[一-鿿]", content)) > 0.3 * len(content)
    out: list[str] = []
    held, apart, last = "", False, ""

    def flush() -> None:
        nonlocal held
        if held.strip():
            out.append(held.replace("\x00", "").strip())
        held = ""

    for i, line in enumerate(lines):
        if line.part == "blank" or line.part in ("page", "header"):
            following = next((x.part for x in lines[i + 1 :] if x.part != "blank"), "")
            broken = line.part != "blank" or following in ("page", "header") or last in ("page", "header")
            # A page break parts no paragraph; a blank line of its own does.
            apart = apart or not broken or bool(held) and broken and bool(re.search(r"[.!?。！？][\"”»」）)]*$", held.rstrip()) and line.part == "blank" and not wide)
            last = line.part if line.part != "blank" else last
            continue
        last = line.part
        if line.part != "body":
            flush()
            if out and i and lines[i - 1].part == line.part != "heading":
                out[-1] += "\n" + line.text
            else:
                out.append(line.text)
            apart = False
            continue
        text = line.text.lstrip("\f")
        indented = bool(re.match(r"[　]|  ", text))
        if held and not held.endswith("\x00") and (apart or indented):
            flush()
        apart = False
        text = text.lstrip("　 \t") if wide else text.strip()
        for seen, true in fixes.get(i, ()):
            text = text.replace(seen, true, 1)
        if held.endswith("\x00"):
            held = held[:-1] + text
        else:
            held += ("" if wide or not held else " ") + text
        if i in joins:
            held = (held.rstrip() if re.search(r"[A-Z]{4,}-\s*$", held) else re.sub(r"[-­‐‑¬]\s*$", "", held)) + "\x00"
    flush()
    return "\n\n".join(out)


def newest(parsed: DataFrame) -> DataFrame:
    """(doc_id, content): the version parsed last."""
    return parsed.groupBy("doc_id").agg(F.max(F.struct("parsed_at", "content")).alias("_n")).select("doc_id", F.col("_n.content").alias("content"))


def find_noise(contents: DataFrame, known: Statistics) -> DataFrame:
    """(doc_id, line_no, noise). The statistics are bounded by ``LEAST_SHARE``."""
    shared = contents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *row) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in noise_of(t, shared.value)]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["doc_id", "line_no", "noise"])

    return contents.select("doc_id", "content").mapInArrow(run, "doc_id bigint, line_no int, noise string")


def repair_all(contents: DataFrame, known: Statistics) -> DataFrame:
    """(doc_id, content) with every content repaired."""
    shared = contents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([repair(t, shared.value) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "content"])

    return contents.select("doc_id", "content").mapInArrow(run, "doc_id bigint, content string")
