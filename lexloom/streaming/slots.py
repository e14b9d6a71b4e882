"""The slot machine of tasks over a stream of commands, one state per document.

State is two slots, kept by Spark's state store, so a restarted query goes on where
it stopped. Commands of one batch are ordered by time, then by what they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.slots import step

EVENTS = "doc_id string, task string, kind string, event string"
STATE = "running_task string, running_kind string, waiting_task string, waiting_kind string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else (None, None, None, None)
    running = (held[0], held[1]) if held[0] is not None else None
    waiting = (held[2], held[3]) if held[2] is not None else None
    rows = pd.concat(list(batches)).sort_values(["at", "rank", "task"])
    out: list[tuple] = []
    for command, task, kind in zip(rows["command"], rows["task"], rows["kind"]):
        running, waiting, events = step(running, waiting, command, task, kind)
        out += [(key[0], *e) for e in events]
    state.update((*(running or (None, None)), *(waiting or (None, None))))
    yield pd.DataFrame(out, columns=["doc_id", "task", "kind", "event"])


def stream_slots(commands: DataFrame) -> DataFrame:
    """Events of a stream of commands (doc_id, at, rank, command, task, kind)."""
    keyed = commands.select("doc_id", "at", "rank", "command", "task", "kind").groupBy("doc_id")
    return keyed.applyInPandasWithState(_advance, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
