"""Calls to a model behind a transport that the caller gives.

Prompts are columns, so they can be looked at without a model. A transport is a
function from a list of requests to a list of replies or errors; retries stay inside
the partition, and rows that need no model never reach it.

Defined results: pure images pass through; after three replies that ask instead of
answering, the original stands; an error that a retry can't mend is in ``error``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

Transport = Callable[[str, str], str]
ATTEMPTS = 3


class CallError(Exception):
    """A call that failed; ``retryable`` where it may succeed later."""

    def __init__(self, category: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.category, self.message, self.retryable = category, message, retryable


def error_code(status: Column) -> Column:
    """What a status says: the kind of trouble a reader can act on."""
    kinds = {400: "too_long_or_malformed", 401: "bad_key", 403: "no_access_or_balance", 404: "wrong_address_or_model", 429: "too_frequent"}
    out = F.lit(None).cast("string")
    for code, kind in kinds.items():
        out = F.when(status == code, kind).otherwise(out)
    return F.coalesce(out, F.when(status >= 500, "server_trouble").otherwise("unknown"))


def translation_prompts(segments: DataFrame, direction: str = "en_to_zh") -> DataFrame:
    """Segments with ``prompt``, and ``passthrough`` where no model is needed."""
    target = "English" if direction == "zh_to_en" else "Chinese"
    c = F.col("content")
    task = (
        F.when(F.col("kind") == "heading", F.lit(f"Give the {target} title of this section heading, nothing else.\n\n"))
        .when(F.col("kind") == "reference", F.lit(f"Translate only the title in this reference into {target}; keep names, journal, year, pages and numbers.\n\n"))
        .when((F.col("kind") == "image_caption") | T.is_caption(c), F.when(c.contains("!["), F.lit("Keep the image syntax; translate only the other words.\n\n")).otherwise(F.lit("")))
        .otherwise(F.lit(""))
    )
    through = (F.col("kind") == "image_caption") & T.is_pure_image(c)
    return segments.withColumn("passthrough", through).withColumn("prompt", F.when(~through, F.concat(F.lit("Answer with the translation alone.\n\n"), task, c)))


def field_prompts(plan: DataFrame) -> DataFrame:
    """A plan's fields with the question for each: label, what it holds, form of the answer."""
    asked = F.when(F.col("ftype") == "table", "a markdown table").when(F.col("ftype") == "list[string]", "an array, an item an element").when(F.col("ftype") == "enum", F.concat(F.lit("one of "), F.array_join("choices", "、"))).when(F.col("ftype") == "integer", "a whole number").otherwise("a short passage")
    prompt = F.concat(F.lit("Field: "), F.col("label"), F.lit("\nHolds: "), F.col("description"), F.lit("\nAnswer: "), asked, F.lit("\nCite paragraphs as [段落 N]; answer 引用缺失 where none supports it.\nReply with one JSON object: {\"zh\": ..., \"en\": ..., \"table\": ...}"))
    return plan.withColumn("prompt", prompt)


#: What to look at closely in each kind of study.
CHECKS = {
    "paradigm-experimental-baseline": "fair baselines, complete metrics, ablations that explain each part",
    "paradigm-rct": "randomisation and blinding, sample size, registered outcomes, harms",
    "paradigm-empirical-stat": "identification, endogeneity, robustness, causal claims",
    "paradigm-theoretical": "definitions, consistent reasoning, answers to objections",
    "paradigm-case-study": "choice of cases, several sources of evidence, fitting analysis",
    "paradigm-systematic-review": "reproducible search, criteria, quality tools, heterogeneity and bias",
    "paradigm-computational-sim": "verification apart from validation, convergence, uncertainty",
    "paradigm-design-science": "aims that match the design, fitting evaluation, contribution to theory",
}


def system_prompts(recognised: DataFrame) -> DataFrame:
    """(doc_id, system): the standing instruction for a document's fields."""
    checks = F.create_map(*[F.lit(v) for kv in CHECKS.items() for v in kv])[F.col("best.id")]
    text = F.concat(F.lit("Take this paper apart field by field. Kind of study: "), F.col("best.name"), F.lit(" ("), F.col("cross_type"), F.lit("). Cite paragraphs; invent nothing. Look closely at: "), F.coalesce(checks, F.lit("-")))
    return recognised.select("doc_id", text.alias("system"))


def ask_field(transport: Transport, system: str, prompt: str, cited: Callable[[str], bool]) -> str:
    """A field's answer: one retry where that may help, and one more request where the
    answer cites nothing; if that fails, the first answer stands."""
    try:
        answer = transport(system, prompt)
    except CallError as e:
        if not e.retryable:
            raise
        answer = transport(system, prompt)
    if not cited(answer):
        try:
            answer = transport(system, prompt + "\n\nYour last answer cites no paragraph. Cite as [段落 N], or answer 引用缺失.")
        except CallError:
            pass
    return answer


def ask(transport: Transport, system: str, prompt: str, original: str, is_meta: Callable[[str], bool], wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, error) after at most three attempts."""
    last = "no reply"
    for attempt in range(ATTEMPTS):
        try:
            reply = transport(system, prompt)
        except CallError as e:
            if not e.retryable:
                return None, f"{e.category}: {e.message}"
            last = f"{e.category}: {e.message}"
            if attempt + 1 < ATTEMPTS:
                wait(2.0**attempt)
            continue
        if not is_meta(reply):
            return reply, None
        if attempt + 1 == ATTEMPTS:
            return original, None
        prompt = "Your last reply was no translation. Answer with the translation alone.\n\n" + prompt
    return None, last


def translate(prompted: DataFrame, transport: Transport, system: str = "", at_once: int = 3, cancelled: Callable[[], bool] = lambda: False, paused: Callable[[], bool] = lambda: False) -> DataFrame:
    """(doc_id, seg_index, translated, error) of prompted segments. A task has ``at_once``
    calls under way at most. No call begins while ``paused``, none after ``cancelled``, and
    none after an error that every later call of the task would meet too; segments that
    were not asked for have the error "cancelled" and can be resumed."""
    markers = tuple(T.META_REPLIES)
    ready = prompted.filter("passthrough").select("doc_id", "seg_index", F.col("content").alias("translated"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended = threading.Event()

        def one(prompt: str, content: str) -> tuple[str | None, str | None]:
            while paused() and not cancelled():
                time.sleep(0.05)
            if ended.is_set() or cancelled():
                return None, "cancelled"
            reply, error = ask(transport, system, prompt, content, lambda r: any(m in r for m in markers))
            if error and (error.startswith("config:") or any(sign in error for sign in T.CREDENTIAL_SIGNS)):
                ended.set()
            return reply, error

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                replies = list(pool.map(one, batch["prompt"], batch["content"]))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "seg_index": batch["seg_index"], "translated": [r for r, _ in replies], "error": [e for _, e in replies]})

    asked = prompted.filter("NOT passthrough").select("doc_id", "seg_index", "content", "prompt").mapInPandas(run, "doc_id bigint, seg_index int, translated string, error string")
    return ready.withColumn("seg_index", F.col("seg_index").cast("int")).unionByName(asked)


#: Images of a document that are described, and the bytes of the largest (fixed values).
DESCRIBED, DESCRIBED_BYTES = 12, 12_000_000


def describe_images(images: DataFrame, transport: Callable[[str, bytes], str], prompt: str = "Describe this figure of a paper: what it shows, its axes and its main finding.") -> DataFrame:
    """(doc_id, path, note, error) of the first images (doc_id, ord, path, content) of each
    document; one that is too large is not asked about."""
    first = images.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "path"))).filter(F.col("_n") <= DESCRIBED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told: list[tuple[str | None, str | None]] = []
            for content in batch["content"]:
                if content is None or len(content) > DESCRIBED_BYTES:
                    told.append((None, "config: missing or too large"))
                    continue
                try:
                    told.append((transport(prompt, bytes(content)), None))
                except CallError as e:
                    told.append((None, f"{e.category}: {e.message}"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "path": batch["path"], "note": [n for n, _ in told], "error": [e for _, e in told]})

    return first.select("doc_id", "path", "content").mapInPandas(run, "doc_id bigint, path string, note string, error string")
