"""Splitting oversized items at natural boundaries.

Recursive bisection: a span that is still too long is cut at the strongest
boundary near its midpoint (blank line, line, sentence, clause, space, any
character), and both halves are treated the same until each fits in the limit
minus the overlap; then every piece but the first is extended to the left by the
overlap. Of the boundaries near a midpoint only those count where neither the cut nor
the place an overlap before it parts a visible character, if there are any. The pieces of an item are made in one Python worker from that item
alone, and only oversized items leave the JVM.

Defined results: null gives no piece, an item within the limit (empty ones too)
gives one piece; no piece exceeds the limit; neighbouring pieces share exactly the
overlap, or all of the first one where it is shorter; text without any boundary is
cut between characters, not inside a combined character or "\\r\\n" where a cut within
reach avoids it; repeated
rows give repeated pieces; other columns are passed on.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries by strength; each match ends where a piece may begin.
BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]*\n\s*(?=\S)")),
    (4, re.compile(r"\n+")),
    (3, re.compile(r"[。！？!?…]+[”’」』）)\"'\]]*\s*|(?<=[^\W\d])\.[”’\"')\]]*\s+")),
    (2, re.compile(r"[;:,；：，、]\s*")),
    (1, re.compile(r"\s+")),
)
#: The part of a span, about its midpoint, where a cut may fall.
NEAR = 0.5


_GLUED = regex.compile(r"[\p{M}\u200d\ufe0f\U0001f3fb-\U0001f3ff]|(?<=\u200d).|(?<=\r)\n", regex.S)


def _glued(text: str) -> np.ndarray:
    """At which places a cut would part one visible character."""
    out = np.zeros(len(text) + 1, bool)
    out[np.fromiter((m.start() for m in _GLUED.finditer(text)), np.int64)] = True
    return out


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces begin, 0 first, before overlaps."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    room = limit - overlap
    if len(text) <= limit:
        return [0]
    strength = np.zeros(len(text) + 1, np.int8)
    for level, pattern in BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        strength[ends] = np.maximum(strength[ends], level)
    glued = _glued(text)
    # A piece begins an overlap before its cut.
    early = np.concatenate((np.zeros(min(overlap, len(glued)), bool), glued[: max(0, len(glued) - overlap)]))
    unclean = glued | early
    starts, spans = [0], [(0, len(text))]
    while spans:
        low, high = spans.pop()
        # The first piece has no overlap to its left.
        if high - low <= (limit if low == 0 else room):
            continue
        half, reach = (low + high) / 2, max(1, int((high - low) * NEAR / 2))
        first, last = max(low + 1, int(half) - reach), min(high - 1, int(half) + reach)
        near = np.where(unclean[first : last + 1], -1, strength[first : last + 1])
        if near.max() < 0:
            near = np.where(glued[first : last + 1], -1, strength[first : last + 1])
        at = first + np.flatnonzero(near == near.max())
        cut = int(at[np.abs(at - half).argmin()])
        starts.append(cut)
        spans += [(low, cut), (cut, high)]
    return sorted(starts)


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece, overlaps attached."""
    starts = cut_points(text, limit, overlap)
    return [(max(0, s - overlap), e) for s, e in zip(starts, [*starts[1:], len(text)])]


def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start_pos": s, "end_pos": e} for s, e in pieces_of(t, int(n), int(o))] for t, n, o in zip(text, limit, overlap)])


def split_items(df: DataFrame, text_col: str, limit: Column, overlap: Column, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, piece_no from 0, start_pos, end_pos, piece, n_pieces) of every item.
    ``ValueError`` where a kept column has the name of an output."""
    if clash := {"piece_no", "start_pos", "end_pos", "piece", "n_pieces"} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)} first")
    text, cut = F.col(text_col), F.pandas_udf(_pieces, "array<struct<start_pos:int,end_pos:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start_pos"), F.length(text).alias("end_pos")))
    held = df.select(*keep, text.alias("_text"), cut(F.when(F.length(text) > limit, text), limit, overlap).alias("_cut"), whole.alias("_whole"))
    pieces = held.filter(F.col("_text").isNotNull()).withColumn("_all", F.coalesce("_cut", "_whole"))
    rows = pieces.select(*keep, "_text", F.size("_all").alias("n_pieces"), F.posexplode("_all").alias("piece_no", "_p"))
    start, end = F.col("_p.start_pos"), F.col("_p.end_pos")
    return rows.select(*keep, "piece_no", start.alias("start_pos"), end.alias("end_pos"), F.substring("_text", start + 1, end - start).alias("piece"), "n_pieces")


def split_corpus(parsed_docs: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(field, doc_id, seg_index, piece_no, start_pos, end_pos, piece, n_pieces) of the
    newest content of every document and of every segment. ``limits`` is the small
    fixed table of limits (one row a field), joined by its field."""
    newest = parsed_docs.groupBy("doc_id").agg(F.max(F.struct("parsed_at", "content")).alias("_newest"))
    contents = newest.select(F.lit("parsed_docs.content").alias("field"), "doc_id", F.lit(-1).alias("seg_index"), F.col("_newest.content").alias("content"))
    once = segments.dropDuplicates(["doc_id", "seg_index", "content"])
    items = contents.unionByName(once.select(F.lit("segments.content").alias("field"), "doc_id", "seg_index", "content"))
    bounded = limits.groupBy("field").agg(F.max("max_chars").alias("_limit"), F.max("overlap_chars").alias("_overlap"))
    return split_items(items.join(F.broadcast(bounded), "field"), "content", F.col("_limit"), F.col("_overlap"), ("field", "doc_id", "seg_index"))
