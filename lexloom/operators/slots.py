"""Task slots: one task of a document runs, and one waits.

The state machine is one function; a stream drives it by key with state that
survives restarts (:mod:`lexloom.streaming.slots`), and :func:`replay` folds a
finished log by document.

Commands, in order of time: start (kind), finish, fail, cancel (kind). A start while
nothing runs runs; the kind that runs or waits already is refused; a second kind
waits; a third is refused. When the running task ends, the waiting one runs.
Cancelling takes the waiting task out, or ends the running one.

Defined results: commands that match nothing are ignored; equal times are ordered by
kind of command and task id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

EVENTS = "doc_id string, ord int, task string, kind string, event string"
Slot = tuple[str, str] | None


def step(running: Slot, waiting: Slot, command: str, task: str, kind: str) -> tuple[Slot, Slot, list[tuple[str, str, str]]]:
    """(running, waiting, events) after a command; a slot is (task, kind)."""
    if command == "start":
        if running is None:
            return (task, kind), waiting, [(task, kind, "running")]
        if kind in (running[1], waiting[1] if waiting else None) or waiting is not None:
            return running, waiting, [(task, kind, "refused")]
        return running, (task, kind), [(task, kind, "queued")]
    if command == "cancel" and waiting and waiting[0] == task:
        return running, None, [(task, kind, "cancelled")]
    if running and running[0] == task and command in ("finish", "fail", "cancel"):
        ended = {"finish": "done", "fail": "failed", "cancel": "cancelled"}[command]
        out = [(task, kind, ended)]
        if waiting:
            out.append((*waiting, "running"))
        return waiting, None, out
    return running, waiting, []


def commands_of(tasks: DataFrame) -> DataFrame:
    """(doc_id, at, rank, command, task, kind): a log of tasks as commands."""
    from lexloom.operators.catalog import latest_tasks

    once = latest_tasks(tasks).filter("doc_id IS NOT NULL")
    began, ended = T.parse_mixed_ts(F.col("created_at")), T.parse_mixed_ts(F.col("updated_at"))
    starts = once.filter(began.isNotNull()).select("doc_id", began.alias("at"), F.lit(1).alias("rank"), F.lit("start").alias("command"), F.col("id").alias("task"), F.col("type").alias("kind"))
    end = F.when(F.col("status") == "done", "finish").when(F.coalesce(F.col("stage") == "已取消", F.lit(False)), "cancel").otherwise("fail")
    ends = once.filter(F.col("status").isin("done", "failed") & ended.isNotNull()).select("doc_id", ended.alias("at"), F.lit(0).alias("rank"), end.alias("command"), F.col("id").alias("task"), F.col("type").alias("kind"))
    return starts.unionByName(ends)


def fold(rows: list[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    running = waiting = None
    for command, task, kind in rows:
        running, waiting, events = step(running, waiting, command, task, kind)
        yield from events


def replay(commands: DataFrame) -> DataFrame:
    """(doc_id, ord, task, kind, event): what happens to each document's tasks. A
    document has tens of commands at most, so gathering one is safe."""

    ordered = F.array_sort(F.collect_list(F.struct("at", "rank", "task", "command", "kind")))
    logs = commands.groupBy("doc_id").agg(ordered.alias("log")).select("doc_id", F.transform("log", lambda c: F.array(c["command"], c["task"], c["kind"])).alias("log"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, i, *e) for doc, log in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, e in enumerate(fold([tuple(c) for c in log]))]
            columns = list(zip(*rows)) or [[] for _ in range(5)]
            types = (pa.string(), pa.int32(), *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "ord", "task", "kind", "event"])

    return logs.mapInArrow(run, EVENTS)
