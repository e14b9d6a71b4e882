"""Template residue and error-page text in records.

A naive Bayes model with a class for each kind of residue and one for ordinary
text is learnt from positive and unlabelled records: trusted records (short, no
ordinary prose, with a sure sign of one kind) give the kinds their first counts,
an unlabelled sample gives the background, and expectation-maximization moves
unlabelled passages between them. Every passage of every record is then scored,
and a record gets the kind that its decided passages speak for most, and each other
kind that one of them is decided for and shows a sure sign of.

Signs that a passage shares with ordinary text but never with trusted records
count strongly against it, so a text that quotes a message or writes about slots
stays ordinary.

Defined results: null, empty and blank texts have no residue; several kinds in a
record give a row each; repeated records give repeated rows; without trusted
records nothing is found; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("placeholder", "filler", "error_page", "script_notice")
#: Bounds of the sample the model is fitted on, in distinct texts: records in all, trusted records for each kind.
SAMPLE_ROWS, TRUSTED_ROWS = 4_000, 3_000
#: A trusted record is at most this long.
TRUSTED_CHARS = 600
#: A feature of this share of the sampled records belongs to ordinary text.
COMMON = 0.004
ROUNDS = 6
PRIOR, UNSEEN, SMOOTH = 1e-3, 1e-4, 0.5

_SLOT = (
    r"\{\{[^{}]*\}\}|\$\{[^{}]*\}|\{%[^%]*%\}|<<[^<>]*>>|<[A-Za-z][\w. -]*>|\[\[[^\[\]]*\]\]|@@[^@]+@@|__[^_\s][^\s]*?__|%[A-Za-z][\w. ]*%|#[A-Za-z][\w. ]*#"
    r"|\[[^\[\]]*(?:TBD|TODO|HERE|INSERT)[^\[\]]*\]|\(your [^()]*here\)|【[^【】]*】"
)
_ERROR_SIGNS = (
    r"\b[45]\d\d\b.{0,40}(?:error|not found|forbidden|unauthorized|unavailable|timeout|gateway|request)|error\W{0,2}[45]\d\d|not found|forbidden|access denied|session (?:has )?(?:ended|expired)"
    r"|has expired|could not be (?:delivered|loaded|displayed)|unavailable|maintenance|not a robot|too many requests|time[- ]?out|traceback|exception|sign in again|moved or withdrawn"
    r"|页面不存在|已被移走|已失效|重新登录|无法响应|稍后刷新|拦截|验证后继续|错误编号|エラー|見つかりません|混み合って|ошибка|не найдена|недоступ|сеанс завер|войдите снова|попробуйте позже|fehler [45]|nicht gefunden|nicht erreichbar"
    r"|sitzung|introuvable|accès refusé|ne répond pas|réessayez|erreur [45]|session a expiré|indisponible|página no|no responde|más tarde|no encontrada|no disponible|sesión ha|ไม่พบหน้า|ข้อผิดพลาด|หมดอายุ|ไม่สามารถใช้งาน"
)
_SCRIPT_SIGNS = r"java\W?script|noscript|\bscripts?\b|scripting|脚本|スクリプト|сценари|скрипт|skripte?\b|สคริปต์|จาวาสคริปต์"
_FILLER_SIGNS = r"lorem|ipsum|dummy|sample text|filler text|text to come|text goes|goes in this box|placeholder text|占位|示例文字|样例|样例段落|正文正文|待补充|ダミー|サンプル|blindtext|mustertext|faux texte|texto de relleno|текст-рыба|рыба-текст|ข้อความตัวอย่าง|asdf|qwer|blah|foo bar|x{3,}"

_SURE = {"placeholder": re.compile(_SLOT), "filler": re.compile(f"(?i){_FILLER_SIGNS}"), "error_page": re.compile(f"(?i){_ERROR_SIGNS}"), "script_notice": re.compile(f"(?i){_SCRIPT_SIGNS}")}

_SENTENCE = re.compile(r"\r?\n|(?<=[.!?])\s+|(?<=[。！？])(?![”’」』）])")
_CLAUSE = re.compile(r"[,;]\s+|[，；]")
_SIGIL = re.compile(r"[{}<>\[\]@%#_$【】]|\(your ")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]+|[฀-๿]+|[^\W\d_぀-ヿ㐀-鿿฀-๿]+|(?<!\d)[45]\d\d(?!\d)|\d+|__+|[^\w\s.,;:!?，。；：、！？'\"“”‘’«»„()（）-]+")
_PAIRED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")


def passages(text: str) -> list[str]:
    """Sentences and lines; those with slot characters also at commas."""
    out = []
    for sentence in _SENTENCE.split(text):
        if sentence and not sentence.isspace():
            out += [c for c in _CLAUSE.split(sentence) if c and not c.isspace()] if _SIGIL.search(sentence) else [sentence]
    return out


def features(passage: str) -> set[str]:
    out = set()
    for token in _TOKEN.findall(passage.lower()):
        if _PAIRED.match(token):
            out.update(map("".join, zip(token, token[1:])) if len(token) > 1 else (token,))
        elif token.isdigit():
            out.add(f"{token[0]}xx" if len(token) == 3 and token[0] in "45" else "0")
        else:
            out.add(token)
    return out


def trusted_kind(text: Column) -> Column:
    """The kind that a short record surely is, by its signs; null for none."""
    left = F.length(F.regexp_replace(text, _SLOT, ""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    varied = F.size(F.array_distinct(words)) / F.size(words)
    kind = (
        F.when(text.rlike(_SLOT) & (left < 0.45 * F.length(text)), "placeholder")
        .when(text.rlike(f"(?i){_SCRIPT_SIGNS}"), "script_notice")
        .when(text.rlike(f"(?i){_ERROR_SIGNS}"), "error_page")
        .when(text.rlike(f"(?i){_FILLER_SIGNS}") | ((F.size(words) >= 16) & (varied <= 0.55)), "filler")
    )
    return F.when(F.length(text) <= TRUSTED_CHARS, kind)


def _log_ratios(kinds: dict[str, Counter], back: Counter) -> dict[str, tuple[float, ...]]:
    totals = {k: sum(c.values()) for k, c in kinds.items()}
    base = sum(back.values())
    size = len(set(back).union(*kinds.values()))
    out = {}
    for f in set(back).union(*kinds.values()):
        under = math.log((back[f] + SMOOTH) / (base + SMOOTH * size))
        out[f] = tuple(math.log((kinds[k][f] + UNSEEN) / (totals[k] + UNSEEN * size)) - under if totals[k] else -9.0 for k in KINDS)
    return out


def _posterior(found: set[str], weights: dict[str, tuple[float, ...]]) -> tuple[float, ...] | None:
    known = [w for f in found if (w := weights.get(f))]
    if not known:
        return None
    odds = [math.log(PRIOR) + sum(w[i] for w in known) for i in range(len(KINDS))]
    top = max(0.0, *odds)
    parts = [math.exp(o - top) for o in odds]
    whole = math.exp(-top) + sum(parts)
    return tuple(p / whole for p in parts)


def fit(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, trusted_rows: int = TRUSTED_ROWS) -> dict[str, tuple[float, ...]]:
    """Log ratios of each feature, kinds against background.

    Both bounds are on what the model is fitted on; a hash of the text draws the
    rows, so every run draws the same. Trusted records are sought among all, and
    every record is scored afterwards.
    """
    texts = df.select(F.col(text_col).alias("text")).filter(F.length(F.trim("text")) > 0)
    # A hash draws all copies of a text or none: the share is one of distinct texts, and each counts once.
    different = max(1, texts.select(F.approx_count_distinct("text", 0.01)).first()[0])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample_rows / different) * (1 << 30))
    signed_at_all = F.col("text").rlike(f"{_SLOT}|(?i:{_SCRIPT_SIGNS}|{_ERROR_SIGNS}|{_FILLER_SIGNS})")
    drawn_rows = sorted(texts.filter(drawn).distinct().select("text", signed_at_all.alias("signed")).collect(), key=lambda r: r.text)
    sample = [r.text for r in drawn_rows]
    short = texts.filter(F.length("text") <= TRUSTED_CHARS).withColumn("kind", trusted_kind(F.col("text"))).filter("kind IS NOT NULL")
    # Each kind has room of its own: a frequent one crowds out no other.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("text"), "text"))
    signed = short.distinct().withColumn("_place", place).filter(F.col("_place") <= trusted_rows).select("text", "kind").collect()

    common, cut = Counter(), [[features(p) for p in passages(t)] for t in sample]
    # Ordinary text is what stands in records without any sign: residue may be frequent.
    plain = [record for record, row in zip(cut, drawn_rows) if record and not row.signed]
    for record in plain:
        common.update(set().union(*record))
    often = max(5.0, COMMON * len(plain))

    def prose(found: set[str]) -> bool:
        # Pairs of letters vary more than words do.
        seen = sorted(common[f] for f in found)
        rare = len(seen) // (2 if any(map(_PAIRED.match, found)) else 8)
        return len(seen) >= 4 and seen[rare] >= often

    trusted: dict[str, Counter] = {k: Counter() for k in KINDS}
    for text, kind in signed:
        record = [features(p) for p in passages(text)]
        if not any(map(prose, record)):
            for found in record:
                trusted[kind].update(found)
    # A record with a sign and no prose is residue as a whole, and no background.
    back = Counter()
    for record, row in zip(cut, drawn_rows):
        if not row.signed or any(map(prose, record)):
            for found in record:
                back.update(found)
    if not any(trusted.values()):
        return {}
    # The same passages come again in every round: count each set of features once.
    pooled = Counter(frozenset(found) for record in cut for found in record if found)
    weights = _log_ratios(trusted, back)
    for _ in range(ROUNDS):
        kinds, rest = {k: Counter(c) for k, c in trusted.items()}, Counter()
        for found, n in pooled.items():
            p = _posterior(found, weights)
            best = max(p) if p else 0.0
            if best > 0.5:
                kind = kinds[KINDS[p.index(best)]]
                for f in found:
                    kind[f] += best * n
            for f in found:
                rest[f] += (1 - sum(p) if p else 1.0) * n
        weights = _log_ratios(kinds, rest)
    # What only ever met the background once or twice says nothing.
    return {f: w for f, w in weights.items() if max(w) > 0 or rest[f] >= 3}


class Scorer:
    """Decides records by the weights of a model."""

    def __init__(self, weights: dict[str, tuple[float, ...]], cut: float = 0.9):
        self.weights, self.cut = weights, cut
        self._most = {f: max(w) for f, w in weights.items()}

    def posterior(self, found: set[str]) -> tuple[float, ...] | None:
        """As :func:`_posterior`, but None also where no kind can come near one half:
        no kind's odds exceed the sum of every feature's best weight."""
        most = self._most
        if math.log(PRIOR) + sum([most[f] for f in found if f in most]) < -2.1:
            return None
        return _posterior(found, self.weights)

    def decide(self, text: str) -> tuple[set[str], bool]:
        """The kinds of a record, and whether nothing but residue stands in it."""
        shown: dict[str, list[str]] = defaultdict(list)
        total, ordinary = [0.0] * len(KINDS), False
        for passage in passages(text):
            found = features(passage)
            p = self.posterior(found) if found else None
            if p and max(p) >= self.cut:
                shown[KINDS[p.index(max(p))]].append(passage)
                for f in found:
                    for i, w in enumerate(self.weights.get(f, ())):
                        total[i] += w
            elif len(found) >= 4 and (p is None or sum(p) < 0.5):
                ordinary = True
        # What surrounds a message (menus, rights) goes with messages of other kinds, too:
        # beside the likeliest kind, another one must show a sure sign of its own.
        first = max(shown, key=lambda k: total[KINDS.index(k)], default=None)
        kinds = {k for k, ps in shown.items() if k == first or any(_SURE[k].search(p) for p in ps)}
        return kinds, bool(kinds) and not ordinary


def score_records(df: DataFrame, weights: dict[str, tuple[float, ...]], id_col: str = "doc_id", text_col: str = "text", cut: float = 0.9) -> DataFrame:
    """(id_col, residue, whole) for every kind of residue a record holds.

    ``weights`` come from a bounded sample, so their size is bounded too."""
    model = df.sparkSession.sparkContext.broadcast(Scorer(weights, cut))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kinds, whole = model.value.decide(text)
                for kind in sorted(kinds):
                    rows["key"].append(key)
                    rows["kind"].append(kind)
                    rows["whole"].append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(rows["key"], batch.column(0).type), pa.array(rows["kind"], pa.string()), pa.array(rows["whole"], pa.bool_())], names=[id_col, "residue", "whole"])

    kept = df.select(id_col, text_col).filter(F.length(F.trim(F.col(text_col))) > 0)
    return kept.mapInArrow(run, f"`{id_col}` {id_type}, residue string, whole boolean")


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_records(df, fit(df, text_col), id_col, text_col)
