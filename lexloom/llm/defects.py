"""Broken prompt and response pairs: each defective pair with its type of defect.

Noisy labelling functions look at a pair: letters, marks at the end, languages of
both sides, copied stretches, numbers and names carried over, lengths against what
the corpus has, wordings of refusal, and how many different prompts got the same
response. For every defect a label model (one latent class per pair, functions
independent given it) is fitted by expectation-maximization to the counts of their
vote patterns, which the cluster aggregates; it gives every pattern a posterior. No
defect's votes look at another defect's, so a pair gets each defect whose posterior
passes the defect's cutoff. Cutoffs are validated: the pairs are parted in two halves
by their ids, a model is fitted to each half, and a half's cutoff is the one with the
best F1 of its model on the other half, whose own model says how likely each pattern
there is the defect.

Texts are shuffled once, to find the row of each segment that was loaded last. What
needs other pairs (stock responses, headings) is found on hashes and joined by segment.

Defined results: a null response is empty; a null prompt gives only what the
response alone shows; repeated rows of a segment count once, the row loaded last;
kinds other than those asked for have no defects; empty input gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import langid, sentences
from lexloom.session import materialize

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
KINDS = ("paragraph", "heading", "image_caption")
#: A response is a stock phrase if so many different prompts got it, and most of the
#: prompts that got it differ: the prompts of a phrase that is translated again and again
#: are few (one in each language), however large the corpus.
STOCK = 3
#: The share of pairs that a defect is first taken to have.
PRIOR = 0.02

_LETTER = re.compile(r"[^\W_]")
_REFUSAL = re.compile(
    r"(?i)\b(?:sorry|apolog|unfortunately)\w*\b.{0,60}\b(?:not|n't|cannot|declin|outside|unable)|\b(?:can(?:no|')t|cannot|unable to|not able to|won't be|will not be|refuse to)\b.{0,40}\b(?:help|translat|assist|provid|render|process|comply|request)"
    r"|\b(?:request|passage|content|text|output|reply|response|translation)\b.{0,40}\b(?:declined|refused|withheld|filtered|blocked|removed|falls outside)|content filter|\bas an? (?:automated|ai|language)\b|safety (?:filter|polic)|human translator"
    r"|无法.{0,6}(?:翻译|处理|提供|协助|完成)|不能.{0,8}(?:提供|处理|翻译|协助)|不予(?:翻译|处理|提供)|(?:拒绝|过滤).{0,12}|超出了?.{0,6}(?:范围|协助)|自动助手|人工译者|未生成译文|使用规定|安全策略"
)
_APOLOGY = re.compile(r"(?i)^[（(\[]?(?:i'm sorry|sorry|apolog|unfortunately|as an|after checking|request declined|抱歉|对不起|很遗憾，(?!关于)|经检查|作为|不予|此内容|该请求|这段|根据使用|内容已)")
_INTRO = re.compile(r"^\s*(?:翻译结果|译文|翻译|翻譯|translation|translated text|here is the translation)\s*[:：]\s*", re.I)
_END_MARK = re.compile(r"(?:[.!?。！？｡]|…|\.\.\.)[\s\"”“»›’'」』）)\]】]*$")
_CARRIED = re.compile(r"[A-Za-z]{4,}-?\d+|\d+(?:[.,\u00a0\u2009\u202f]\d+)*|[A-Z][a-z]{4,}")
_NOT_WORD = re.compile(r"[\W_]+")


def squeeze(text: str) -> str:
    return _NOT_WORD.sub("", _INTRO.sub("", text)).lower()


def copied(original: str, translated: str) -> tuple[float, float]:
    """Shares of the response's and of the prompt's letter runs found in the other."""
    a, b = squeeze(original), squeeze(translated)
    if not a or not b:
        return 0.0, 0.0
    if a == b:
        return 1.0, 1.0
    n = 3 if min(len(a), len(b)) >= 12 else 2
    x, y = Counter(a[i : i + n] for i in range(len(a) - n + 1)), Counter(b[i : i + n] for i in range(len(b) - n + 1))
    both = sum((x & y).values())
    return both / max(1, sum(y.values())), both / max(1, sum(x.values()))


def carried(text: str) -> set[str]:
    """Numbers (digits only), names and labels, which a translation keeps."""
    return {re.sub(r"[^\dA-Za-z]", "", w).lower() for w in _CARRIED.findall(text)}


class Languages:
    """Which language a text is in, within the languages at hand."""

    def __init__(self, prototypes: np.ndarray):
        self._profiles = langid.worker_profiles(prototypes)

    def cosines(self, texts: list[str]) -> np.ndarray:
        return self._profiles.cosines(texts)


def likeliest(text: str, cosines: np.ndarray) -> tuple[str | None, float]:
    """Language and lead; script settles what it can."""
    letters = len(_LETTER.findall(text))
    for code, pattern in langid._SCRIPTS:
        n = len(pattern.findall(text))
        if code == "ja" and n >= 2 and n > 0.08 * letters:
            return "ja", 1.0
        if code in ("th", "ru") and 3 * n > letters:
            return code, 1.0
        if code == "zh" and n >= 0.25 * letters:
            return "zh", 1.0
    latin = [i for i, k in enumerate(langid.LANGUAGES) if k in ("en", "de", "fr", "es")]
    order = sorted(latin, key=lambda i: -cosines[i])
    best, second = float(cosines[order[0]]), float(cosines[order[1]])
    return (langid.LANGUAGES[order[0]], (best - second) / best) if best > 0.02 else (None, 0.0)


#: The functions' names by defect, in the order :func:`votes` gives them.
FUNCTIONS = {
    "empty": ("no_letter", "no_word", "tiny"),
    "refusal": ("wording", "opening", "stock", "nothing_kept", "no_copy", "prompt_plain"),
    "copy": ("same_letters", "source_language", "most_of_it"),
    "wrong_language": ("third_language", "not_target", "not_copied", "kept"),
    "truncated": ("no_end_mark", "open_end", "short"),
}


def votes(kind: str, original: str | None, translated: str | None, target: str, languages: tuple[tuple[str | None, float], tuple[str | None, float]], ratio: float) -> dict[str, tuple[int, ...]]:
    """A vote of every function: 1 for the defect, 0 against it, -1 to abstain. The
    vote on stock, which needs other pairs, is left to :func:`label_pairs`."""
    original, translated = original or "", translated or ""
    if not _LETTER.search(translated):
        return {d: ((1, int(not re.search(r"\w", translated)), int(len(translated.strip()) <= 4)) if d == "empty" else (0,) * len(FUNCTIONS[d])) for d in DEFECTS}
    (source, source_lead), (given, given_lead) = languages
    wording, opening = bool(_REFUSAL.search(translated)), bool(_APOLOGY.search(translated.strip()))
    kept_o, kept_t = carried(original), carried(translated)
    kept = len(kept_o & kept_t) / len(kept_o) if kept_o else -1.0
    in_response, in_prompt = copied(original, translated)
    exact = squeeze(original) == squeeze(translated)
    long = kind == "paragraph"
    same = given == source and given is not None
    copy_like = exact or (in_response >= 0.75 and in_prompt >= 0.5 if long else min(in_response, in_prompt) >= 0.8)
    # Some headings are the same in both languages.
    shared = kind == "heading" and given == target
    third = given is not None and given not in (target, source) and (given_lead >= 0.12 or long)
    ended = bool(_END_MARK.search(translated.strip()))
    last = translated.rstrip()[-1:]
    open_end = not ended and (last.isalnum() or last in ",，、;；:：-–—([（【「“" or len(sentences._depths(translated)) * 2 != sum(c in '"“”«»「」（）()[]' for c in translated))
    return {
        "empty": (0, 0, int(len(translated.strip()) <= 1)),
        "refusal": (int(wording), int(opening), 0, -1 if kept < 0 else int(kept == 0), 0 if copy_like else -1, 0 if _REFUSAL.search(original) else -1),
        "copy": (int(copy_like and not shared), int(same and (exact or given != target)), int(in_prompt >= 0.5 and not shared)),
        "wrong_language": (int(third), int(given not in (target, source, None)), int(in_response < 0.6) if third else -1, int(kept > 0) if third and kept >= 0 else -1),
        "truncated": (-1 if given == "th" else int(long and not ended), int(long and open_end), -1 if ratio <= 0 else int(long and ratio < 0.75)),
    }


class LabelModel:
    """One latent class per pair; functions vote independently given it."""

    def __init__(self, patterns: dict[tuple[int, ...], int], prior: float, rounds: int = 60):
        self._at = {p: i for i, p in enumerate(patterns)}
        seen = np.array(list(patterns), int)
        count = np.array(list(patterns.values()), float)
        functions = seen.shape[1]
        # Right more often than not: the start that keeps the classes from swapping.
        right = np.full((functions, 2), 0.95)
        first = prior
        for _ in range(rounds):
            log = np.log([1 - first, first])[None, :].repeat(len(seen), 0)
            for f in range(functions):
                for y in (0, 1):
                    agree = seen[:, f] == y
                    log[:, y] += np.where(seen[:, f] < 0, 0.0, np.log(np.where(agree, right[f, y], 1 - right[f, y])))
            self._posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
            weight = np.stack((1 - self._posterior, self._posterior)) * count
            first = min(0.5, max(1e-6, weight[1].sum() / count.sum()))
            for f in range(functions):
                for y in (0, 1):
                    voted = seen[:, f] >= 0
                    agree = weight[y][voted & (seen[:, f] == y)].sum()
                    right[f, y] = min(0.999, max(0.55, (agree + 2 * 0.95) / (weight[y][voted].sum() + 2)))
        self.accuracy, self.prior = right, first

    def posterior(self, pattern: tuple[int, ...]) -> float:
        i = self._at.get(pattern)
        return 0.0 if i is None else float(self._posterior[i])


def validated_cutoff(halves: tuple[dict[tuple[int, ...], int], dict[tuple[int, ...], int]], prior: float) -> float:
    """The mean over both halves of the cutoff with the best F1 of one half's model on
    the other half's patterns, at least one half; 0.5 where a half has no patterns."""
    if not all(halves):
        return 0.5
    models = [LabelModel(counts, prior) for counts in halves]
    found = []
    for mine, other, held_out in ((models[0], models[1], halves[1]), (models[1], models[0], halves[0])):
        told = sorted(((mine.posterior(p), other.posterior(p), n) for p, n in held_out.items()), reverse=True)
        p, true, n = (np.array(x, float) for x in zip(*told))
        f1 = 2 * np.cumsum(true * n) / np.maximum(1e-12, np.cumsum(n) + (true * n).sum())
        # Between the last pattern that is taken and the first that isn't.
        last = int(f1.argmax())
        below = p[p < p[last]]
        found.append(max(0.5, float(p[last] + (below[0] if len(below) else 0.0)) / 2))
    return sum(found) / 2


def heading_languages(pairs: DataFrame) -> DataFrame:
    """(_heading_key, _heading): headings that stand in several documents, nearly all of
    one Latin-script language, and that language. A document's language is told by
    the function words of its prompts; sums are partial before the shuffle."""
    words = F.split(F.lower("original"), r"[^\p{L}]+")
    hits = [F.sum(F.size(F.filter(words, lambda w: w.isin(*langid.FUNCTION_WORDS[k].split()))) / F.size(words)).alias(k) for k in langid.FUNCTION_WORDS]
    best = F.greatest(*(F.col(k) for k in langid.FUNCTION_WORDS))
    by_doc = pairs.filter("kind = 'paragraph'").groupBy("doc_id").agg(*hits).filter(best > 0)
    language = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in langid.FUNCTION_WORDS))
    latin = pairs.filter("kind = 'heading'").select("doc_id", folded("original").alias("_t")).filter(F.col("_t").rlike(r"^\p{IsLatin}+$"))
    headings = latin.select("doc_id", F.xxhash64("_t").alias("_heading_key")).distinct()
    counted = headings.join(by_doc.select("doc_id", language.alias("_l")), "doc_id").groupBy("_heading_key", "_l").agg(F.count("*").alias("_n"))
    top = counted.groupBy("_heading_key").agg(F.max_by("_l", F.struct("_n", "_l")).alias("_heading"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return top.filter((F.col("_all") >= STOCK) & (F.col("_most") >= 0.8 * F.col("_all"))).select("_heading_key", "_heading")


def folded(column: str) -> Column:
    """Letters only, lower case, for finding texts that say the same."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\d\s\p{P}\p{S}\p{Z}]+", ""))


def stock_responses(keyed: DataFrame) -> DataFrame:
    """(_key, _stock): stock phrases among the responses (hashes of their letters), with
    the number of different prompts (hashes) each got. Equal prompts, as in works that
    occur again, count once; counts are partial before each shuffle."""
    by_prompt = keyed.filter("kind <> 'heading'").groupBy("_key", "_prompt").agg(F.count("*").alias("_n"))
    counted = by_prompt.groupBy("_key").agg(F.count("*").alias("_stock"), F.sum("_n").alias("_rows"))
    return counted.filter((F.col("_stock") >= STOCK) & (2 * F.col("_stock") > F.col("_rows"))).select("_key", "_stock")


def with_ratio(pairs: DataFrame) -> DataFrame:
    """Pairs with ``ratio``: the length of response over prompt, divided by the middle
    ratio of its script and target; there are few of those, so they are broadcast."""
    wide = (F.length(F.regexp_replace("original", r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "")) > 0.25 * F.length("original")).cast("int")
    sized = pairs.select("*", wide.alias("_wide"), F.when((F.length("original") > 0) & (F.length("translated") > 0), F.length("translated") / F.length("original")).alias("_r"))
    middle = sized.filter("_r IS NOT NULL").groupBy("target_lang", "_wide").agg(F.percentile_approx("_r", 0.5, 1000).alias("_m"))
    return sized.join(F.broadcast(middle), ["target_lang", "_wide"], "left").withColumn("ratio", F.col("_r") / F.col("_m")).drop("_r", "_m", "_wide")


def label_pairs(segments: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """(seg_id, defect, posterior): every defect that passes its cutoff."""
    pairs = materialize(sentences.latest(segments, KINDS, ("doc_id", "kind", "original", "translated", "target_lang")))
    spark = segments.sparkSession
    # Numbers from here on. Texts without letters have nothing to look up: no key.
    keyed = pairs.select("seg_id", "kind", F.when(folded("translated") != "", F.xxhash64(folded("translated"))).alias("_key"), F.xxhash64(folded("original")).alias("_prompt"))
    named = keyed.filter("_key IS NOT NULL")
    stock = named.filter("kind <> 'heading'").join(stock_responses(named), "_key").select("seg_id", F.lit(True).alias("_stock"))
    headed = named.filter("kind = 'heading'").join(heading_languages(pairs).withColumnRenamed("_heading_key", "_key"), "_key").select("seg_id", "_heading")
    model = spark.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongues = Languages(model.value)
        for batch in batches:
            ids, kinds, originals, responses, targets, ratios, headings = (c.to_pylist() for c in batch.columns)
            sides = [[langid_text(k, t) for k, t in zip(kinds, side)] for side in (originals, responses)]
            cosines = [tongues.cosines(side) for side in sides]
            rows = []
            for i, seg_id in enumerate(ids):
                languages = [likeliest(sides[s][i], cosines[s][i]) for s in (0, 1)]
                if headings[i]:
                    languages[1] = headings[i], 1.0
                cast = votes(kinds[i], originals[i], responses[i], targets[i] or "", languages, ratios[i] or 0.0)
                rows.append([seg_id, *("".join("n01"[v + 1] for v in cast[d]) for d in DEFECTS)])
            columns = list(zip(*rows)) or [[] for _ in range(1 + len(DEFECTS))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["seg_id", *DEFECTS])

    # Only headings, which are short, are joined with what other pairs say before they vote.
    ready = with_ratio(pairs)
    heads = ready.filter("kind = 'heading'").join(headed, "seg_id", "left")
    inputs = ready.filter("kind <> 'heading'").withColumn("_heading", F.lit(None).cast("string")).unionByName(heads)
    voted = inputs.select("seg_id", "kind", "original", "translated", "target_lang", "ratio", "_heading").mapInArrow(run, "seg_id bigint, " + ", ".join(f"`{d}` string" for d in DEFECTS))
    at = FUNCTIONS["refusal"].index("stock")
    stocked = F.when(F.col("_stock"), F.concat(F.col("refusal").substr(1, at), F.lit("1"), F.col("refusal").substr(at + 2, 100))).otherwise(F.col("refusal"))
    voted = materialize(voted.join(stock, "seg_id", "left").withColumn("refusal", stocked).drop("_stock"))
    long = voted.select("seg_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("x")).select("seg_id", "x.defect", "x.pattern")
    # At most 3 ** functions patterns a defect and half.
    counted = long.groupBy("defect", "pattern", (F.pmod(F.xxhash64("seg_id"), F.lit(2))).alias("half")).count().collect()
    posteriors = []
    for defect in DEFECTS:
        halves: tuple[dict, dict] = ({}, {})
        for r in counted:
            if r["defect"] == defect:
                halves[r["half"]][tuple("n01".index(c) - 1 for c in r["pattern"])] = r["count"]
        counts = {p: halves[0].get(p, 0) + halves[1].get(p, 0) for p in {**halves[0], **halves[1]}}
        if not counts:
            continue
        fitted, cutoff = LabelModel(counts, PRIOR), validated_cutoff(halves, PRIOR)
        for pattern in counts:
            if (p := fitted.posterior(pattern)) >= cutoff and any(v == 1 for v in pattern):
                posteriors.append((defect, "".join("n01"[v + 1] for v in pattern), p))
    kept = spark.createDataFrame(posteriors, "defect string, pattern string, posterior double")
    return long.join(F.broadcast(kept), ["defect", "pattern"]).select("seg_id", "defect", "posterior")


def langid_text(kind: str, text: str | None) -> str:
    """What of a text tells its language: captions without their bold label."""
    text = _INTRO.sub("", text or "")
    return re.sub(r"^\s*\*\*[^*]*\*\*", "", text) if kind == "image_caption" else text


def main_defect(labelled: DataFrame) -> DataFrame:
    """(seg_id, defect): of several defects the one listed first, which explains the
    others (a copy that breaks off is a copy)."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return labelled.groupBy("seg_id").agg(F.min_by("defect", rank).alias("defect"))
