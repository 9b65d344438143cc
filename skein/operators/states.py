"""State machines over ordered events: every event with the state before and after it, and whether it was allowed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.session import ship

#: (state, event) to the next state; what isn't listed is refused and changes nothing.
Transitions = dict[tuple[str, str], str]


def walked(events: DataFrame, key: str, order: list[str], event: str, transitions: Transitions, start: str) -> DataFrame:
    """``events`` with before, after and allowed, by key in the order.

    A key's events come to one task sorted, spilled to disk where they are many, and stream through it
    with nothing kept but the state.
    """
    ship(events.sparkSession)
    names = [key, *order, event]
    rows = events.select(*names).repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        now, state = None, start
        for batch in batches:
            before, after, allowed = [], [], []
            for k, e in zip(batch.column(0).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True):
                if k != now:
                    now, state = k, start
                nxt = transitions.get((state, e))
                before.append(state)
                allowed.append(nxt is not None)
                state = state if nxt is None else nxt
                after.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(allowed)], [*names, "before", "after", "allowed"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{types}, before string, after string, allowed boolean")
