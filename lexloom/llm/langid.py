"""Language of texts and of blocks within them, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product
of its letters' vectors, permuted by their place; letters of scripts without word
spaces also count alone and by their script. A text's profile is the sum of its
grams' vectors, each times the root of its count, and so is a language's prototype, over sampled texts whose
language is plain from script or function words. Texts are compared with the
prototypes by cosine. As that is linear in the grams, a worker keeps each
gram's products with the prototypes and sums those; the length of a profile is
taken from its gram counts, since the vectors of different grams are
orthogonal but for chance.

Defined results: null, blank and letterless texts have no language (null code,
confidence 0); ties go to the language listed first; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import residue

LANGUAGES = ("en", "zh", "ja", "de", "fr", "es", "ru", "th")
DIMENSIONS = 2048
#: Texts the prototypes are built from: drawn in all, and kept for one language.
SAMPLE_ROWS, SAMPLE_OF_ONE = 4_000, 300
#: Grams a worker remembers; past it the memory starts afresh.
REMEMBERED = 400_000
#: Characters judged at once; bounds a worker's memory, not the text.
CHUNK = 1_500_000

#: Frequent short words that tell languages of one script apart.
FUNCTION_WORDS = {
    "en": "the of and to was were for in that with is than from by at this which are be as it about not on should their",
    "de": "der die das und den von für wurde auf ein mit dem ist nicht im wir zu eine sich des zum sollten auch aus als bei nach über kein sind haben wenn dieser zwischen nur usw",
    "fr": "le la les des et une du pour dans est nous sur qui par au un ne pas plus cette nous aux avec entre sont ce il",
    "es": "el la los las se en una para del que con por no su más un al como es sobre entre desde hasta deberían lo",
}
#: Letters that one of those languages has alone.
OWN_LETTERS = {"en": "", "de": "äöüß", "fr": "çœèêàùëîâô", "es": "ñ¿¡óíúª"}
#: Words and letters that every prototype of another script starts with.
SCRIPT_WORDS = {
    "zh": "的 了 在 是 我们 这 中 和 有 不 为 以 研究 方法 结果 数据",
    "ja": "の は を に が と た で する した これ それ である について 研究の方法 結果 データ",
    "ru": "и в не на что с по для из от как это мы при работы данных методы результаты",
    "th": "ที่ และ ใน ของ เป็น การ มี ไม่ ได้ เรา จาก ข้อมูล วิธีการ ผล บทนำ",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("th", re.compile(r"[฀-๿]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[㐀-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")))


def plain_language(text: str) -> str | None:
    """The language that script or function words make plain; None where they don't."""
    letters = sum(map(len, _WORD.findall(text)))
    if not letters:
        return None
    shares = {k: len(p.findall(text)) / letters for k, p in _SCRIPTS}
    if shares["th"] > 0.3:
        return "th"
    if shares["ja"] > 0.12:
        return "ja"
    if shares["zh"] > 0.4 and shares["ja"] < 0.02:
        return "zh"
    if shares["ru"] > 0.4:
        return "ru"
    if max(shares.values()) > 0.1:
        return None
    words = Counter(_WORD.findall(text.lower()))
    hits = sorted(((sum(words[w] for w in ws), k) for k, ws in _WORDS.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= 3 and hits[0][0] >= 1.5 * hits[1][0] else None


_SPACE, _END = 32, 1
_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower-case letters and combining marks as they are, everything else as a space."""
    global _folded
    if _folded is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000:
                ch = chr(c)
                if ch.isalpha() or 0x0E31 <= c <= 0x0E4E:
                    low = ch.lower()
                    table[c] = ord(low) if len(low) == 1 else c
        table[_END] = _END
        _folded = table
    return _folded


#: Stand-ins for the scripts without word spaces: Thai, kana, Han.
_WIDE = ((0xE00, 0xE7F), (0x3040, 0x30FF), (0x3400, 0x9FFF))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of the texts, and the index of the text of each: trigrams,
    and for wide scripts single letters (two spaces of nought before them) and the
    script (two and its number)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = "".join("\x01 " + t.replace("\x01", " ") + " " for t in texts)
    letters = _fold_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    letters = letters[np.concatenate(([True], (letters[1:] != _SPACE) | (letters[:-1] != _SPACE)))].astype(np.uint64)
    owner = np.cumsum(letters == _END) - 1
    keys = letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:]
    fine = (owner[:-2] == owner[2:]) & (letters[:-2] != _END)
    all_keys, owners = [keys[fine]], [owner[:-2][fine]]
    for number, (low, high) in enumerate(_WIDE, 2):
        inside = (letters >= low) & (letters <= high)
        if inside.any():
            all_keys += [letters[inside], np.full(int(inside.sum()), number, np.uint64)]
            owners += [owner[inside]] * 2
    return np.concatenate(all_keys), np.concatenate(owners)


class Profiles:
    """Prototypes, and cosines of texts with them."""

    def __init__(self, prototypes: np.ndarray):
        self.prototypes = prototypes.astype(np.float32)
        self._letters: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._products = np.zeros((1024, len(prototypes)), np.float32)

    def _letter(self, c: int) -> np.ndarray:
        if (v := self._letters.get(c)) is None:
            v = self._letters[c] = (np.random.default_rng(c).integers(0, 2, self.prototypes.shape[1], np.int8) * 2 - 1).astype(np.int8)
        return v

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each gram: its letters permuted and bound."""
        mask = np.uint64((1 << 21) - 1)
        places = [(keys >> np.uint64(s)) & mask for s in (42, 21, 0)]
        out = np.ones((len(keys), self.prototypes.shape[1]), np.int8)
        for shift, letters in zip((2, 1, 0), places):
            kinds, at = np.unique(letters, return_inverse=True)
            out *= np.stack([np.roll(self._letter(int(c)), shift) for c in kinds])[at]
        return out

    def products(self, keys: np.ndarray) -> np.ndarray:
        row = self._row
        fresh = [k for k in keys.tolist() if k not in row]
        if len(row) + len(fresh) > REMEMBERED:
            row = self._row = {}
            fresh = keys.tolist()
        for i in range(0, len(fresh), 2048):
            part = fresh[i : i + 2048]
            made = self.vectors(np.array(part, np.uint64)).astype(np.float32) @ self.prototypes.T
            first = len(row)
            while first + len(part) > len(self._products):
                self._products = np.concatenate((self._products, np.zeros_like(self._products)))
            self._products[first : first + len(part)] = made
            row.update(zip(part, range(first, first + len(part))))
        return self._products[[row[k] for k in keys.tolist()]]

    def cosines(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each language; 0 without letters."""
        out = np.zeros((len(texts), len(self.prototypes)), np.float32)
        keys, owner = grams_of(texts)
        if not len(keys):
            return out
        kinds, at = np.unique(keys, return_inverse=True)
        pairs, counts = np.unique(owner * np.int64(len(kinds)) + at, return_counts=True)
        owners, grams = np.divmod(pairs, len(kinds))
        products = self.products(kinds)[grams] * np.sqrt(counts)[:, None]
        heads = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1))
        length = np.sqrt(self.prototypes.shape[1] * np.add.reduceat(counts.astype(np.float64), heads))
        out[owners[heads]] = np.add.reduceat(products, heads) / length[:, None]
        return out


def build_prototypes(texts: dict[str, list[str]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector for each language, bundled from its texts' grams."""
    maker = Profiles(np.zeros((1, dimensions)))
    out = np.zeros((len(LANGUAGES), dimensions))
    for i, language in enumerate(LANGUAGES):
        seed = FUNCTION_WORDS.get(language) or SCRIPT_WORDS[language]
        keys, _ = grams_of([seed, *texts.get(language, [])])
        kinds, counts = np.unique(keys, return_counts=True)
        for j in range(0, len(kinds), 2048):
            out[i] += np.sqrt(counts[j : j + 2048]) @ maker.vectors(kinds[j : j + 2048]).astype(np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, of_one: int = SAMPLE_OF_ONE) -> np.ndarray:
    """Prototypes from a bounded sample of ``df``, drawn and ordered by a hash of the
    text, so that they don't depend on how the rows lie."""
    texts = df.select(F.col(text_col).alias("text")).filter(F.length(F.trim("text")) > 0)
    rows = max(1, texts.count())
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample_rows / rows) * (1 << 30))
    by: dict[str, list[str]] = {}
    for text, _ in sorted(texts.filter(drawn).select("text", F.xxhash64("text")).collect(), key=lambda r: (r[1], r[0])):
        if (language := plain_language(text)) and len(kept := by.setdefault(language, [])) < of_one:
            kept.append(text)
    return build_prototypes(by)


_profiles: dict[int, Profiles] = {}


def worker_profiles(prototypes: np.ndarray) -> Profiles:
    """One set of profiles per worker process, which serves many tasks."""
    key = hash(prototypes[:, :64].tobytes())
    if key not in _profiles:
        _profiles.clear()
        _profiles[key] = Profiles(prototypes)
    return _profiles[key]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            size += len(texts[last])
            last += 1
        yield first, last
        first = last


def judge(cosines: np.ndarray) -> tuple[str | None, float]:
    """The language and a confidence from 0 to 1: the lead over the second."""
    order = np.argsort(-cosines, kind="stable")
    best, second = float(cosines[order[0]]), float(cosines[order[1]])
    if best <= 0.02:
        return None, 0.0
    return LANGUAGES[order[0]], min(1.0, (best - max(second, 0.0)) / best)


def identify(df: DataFrame, prototypes: np.ndarray, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(*keep, text_col, lang_code, confidence) of every row. The prototypes' size
    is fixed (languages times dimensions). ``ValueError`` where a kept column has the
    name of an output."""
    if clash := {"lang_code", "confidence", text_col} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)} first")
    model = df.sparkSession.sparkContext.broadcast(prototypes)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keep, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = worker_profiles(model.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            judged = [judge(row) for a, b in _chunks(texts) for row in profiles.cosines(texts[a:b])]
            columns = [*batch.columns, pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, text_col, "lang_code", "confidence"])

    return df.select(*keep, text_col).mapInArrow(run, f"{fields}, lang_code string, confidence double")


#: Names of the languages in the spellings that catalogues use.
SPELLINGS = {
    "en": "en eng english 英文 英语 英語 anglais englisch inglés английский อังกฤษ ภาษาอังกฤษ",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 中国語 mandarin chinois chinesisch chino китайский จีน ภาษาจีน",
    "ja": "ja jpn jp japanese 日文 日语 日語 日本語 japonais japanisch japonés японский ญี่ปุ่น ภาษาญี่ปุ่น",
    "de": "de deu ger german deutsch 德文 德语 德語 ドイツ語 allemand alemán немецкий เยอรมัน ภาษาเยอรมัน",
    "fr": "fr fra fre french français francais 法文 法语 法語 フランス語 französisch francés французский ฝรั่งเศส ภาษาฝรั่งเศส",
    "es": "es spa spanish español espanol 西班牙文 西班牙语 西班牙語 スペイン語 espagnol spanisch испанский สเปน ภาษาสเปน",
    "ru": "ru rus russian русский 俄文 俄语 俄語 ロシア語 russe russisch ruso รัสเซีย ภาษารัสเซีย",
    "th": "th tha thai ไทย ภาษาไทย 泰文 泰语 泰語 タイ語 thaï thailändisch tailandés тайский",
}
#: Right for every language but English and Chinese.
OTHER = ("其他", "other", "others", "其它")


def declared_code(language: Column) -> Column:
    """The code of a declared language; "other"; null where none is declared."""
    bare = F.lower(F.regexp_replace(language, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    main = F.regexp_replace(bare, r"^([a-z]{2,3})[-_].*$", "$1")
    code = F.when(bare.isin(*OTHER), "other")
    for k, names in SPELLINGS.items():
        code = code.when(main.isin(*names.split()), k)
    return code


_BLANK = re.compile(r"(?:\r?\n[^\S\n]*)+\r?\n")
_NOT_PROSE = re.compile(r"^\s*(?:#|```|~~~|\||!\[|\*\*(?:Figure|图|圖|図)|<table|\[\d+\]|[-*+] |\$\$)")
_MARKED = re.compile(r"^\s*(?:```|~~~|\||<table|\[\d+\])")
_END_MARK = re.compile(r"[.!?。！？][\"”»’」』)）\]]*\s*$|[。！？]")
_GAP = re.compile(r"\s")


def blocks(content: str) -> list[str]:
    """What blank lines part; the n-th is block n + 1."""
    return [b for b in _BLANK.split(content.strip("\r\n")) if b.strip()]


def is_prose(block: str) -> bool:
    """Sentences, not a heading, table, code, caption, list of references or contents."""
    if _NOT_PROSE.match(block):
        return False
    letters = sum(map(len, _WORD.findall(block)))
    wide = len(re.findall(r"[぀-ヿ㐀-鿿]", block))
    thai = len(re.findall(r"[฀-๿]", block))
    if letters < (10 if wide + thai > 0.3 * letters else 30) or letters < 0.4 * len(block.strip()):
        return False
    if "...." in block or "…" * 3 in block:
        return False
    if thai > 0.3 * letters:
        return True
    if letters < 150 and not _END_MARK.search(block):
        return False
    return wide > 0.3 * letters or max(map(len, _GAP.split(block))) <= 60


def foreign_blocks(contents: DataFrame, prototypes: np.ndarray, id_col: str = "doc_id", content_col: str = "content", sure: float = 0.2) -> DataFrame:
    """(id_col, block_no, lang_code, confidence) of every prose block in another
    language than the rest of its content."""
    model = contents.sparkSession.sparkContext.broadcast(prototypes)
    id_type = contents.schema[id_col].dataType.simpleString()

    def size(part: str, language: str | None) -> float:
        """Letters of running text; those of denser scripts say more."""
        return 0.0 if _MARKED.match(part) else sum(map(len, _WORD.findall(part))) * (2.5 if language in ("zh", "ja") else 1.0)

    def of_one(parts: list[str], cosines: np.ndarray) -> Iterator[tuple[int, str, float]]:
        judged = [judge(row) for row in cosines]
        weight = Counter()
        for part, (language, _) in zip(parts, judged):
            weight[language] += size(part, language)
        del weight[None]
        for i, (part, (language, confidence)) in enumerate(zip(parts, judged)):
            if language is None or confidence < sure or not is_prose(part):
                continue
            rest = weight.copy()
            rest[language] -= size(part, language)
            main = max(rest, key=lambda k: (rest[k], -LANGUAGES.index(k)))
            if rest[main] > 0 and main != language:
                yield i + 1, language, confidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = worker_profiles(model.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for a, b in _chunks(texts):
                cut = [blocks(t) for t in texts[a:b]]
                cosines = profiles.cosines([p for parts in cut for p in parts])
                at = 0
                for key, parts in zip(keys[a:b], cut):
                    rows += [(key, *row) for row in of_one(parts, cosines[at : at + len(parts)])]
                    at += len(parts)
            columns = list(zip(*rows)) or [[], [], [], []]
            types = (batch.column(0).type, pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[id_col, "block_no", "lang_code", "confidence"])

    return contents.select(id_col, content_col).mapInArrow(run, f"`{id_col}` {id_type}, block_no int, lang_code string, confidence double")


def wrong_labels(documents: DataFrame, prototypes: np.ndarray, residues: dict, sure: float = 0.05) -> DataFrame:
    """(doc_id, lang_code, confidence) where the declared language is missing or wrong.
    ``residues`` is the residue model; a text of nothing but residue has no language."""
    judged = identify(documents.withColumn("_declared", declared_code(F.col("language"))), prototypes, ("doc_id", "_declared"))
    fits = (F.col("_declared") == F.col("lang_code")) | ((F.col("_declared") == "other") & ~F.col("lang_code").isin("en", "zh"))
    wrong = judged.filter(F.col("lang_code").isNotNull() & (F.col("confidence") >= sure) & ~F.coalesce(fits, F.lit(False)))
    model = documents.sparkSession.sparkContext.broadcast(residue.Scorer(residues))

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [not model.value.decide(t)[1] for t in batch.column(1).to_pylist()]
            yield batch.select([0, 2, 3]).filter(pa.array(kept, pa.bool_()))

    return wrong.select("doc_id", "text", "lang_code", "confidence").mapInArrow(ordinary, "doc_id bigint, lang_code string, confidence double")
