"""Stateful stream operators.

They take summaries of micro-batches (see ``summaries``), not single records:
however hot a key is, a batch brings it a bounded number of rows. They can start from
the typed states of a snapshot, such as a pin, as their initial state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYED_OUTPUT = "user_id bigint, event_count bigint, running_average double"
BUFFER_OUTPUT = "subtask bigint, n_buffered bigint"

# A call to the state store takes a worker as long as so many map entries read at once.
ENTRIES_A_CALL = 16


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """Rows by batch and number; those without a number first."""
    return sorted(rows, key=lambda r: (r["batch_id"], -1 if r["seq"] is None else r["seq"]))


class KeyedStateProcessor(StatefulProcessor):
    """Three values, a list and a map per key: count, average, last category,
    recent values, count per category."""

    def __init__(self, alpha: float, recent_size: int):
        self.keep = 1.0 - alpha
        self.recent_size = recent_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("event_count", "value bigint")
        self.last = handle.getValueState("last_category", "value string")
        self.average = handle.getValueState("running_average", "value double")
        self.recent = handle.getListState("recent_values", "value string")
        self.categories = handle.getMapState("category_counts", "category string", "n bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """A row of typed states of this processor, as ``jobs.initial_states`` gives it."""
        self.count.update((initialState["event_count"],))
        self.last.update((initialState["last_category"],))
        self.average.update((initialState["running_average"],))
        self.recent.put([(text,) for text in initialState["recent_values"] or []])
        # Maps come as pairs.
        for name, n in dict(initialState["category_counts"] or ()).items():
            self.categories.updateValue((name,), (n,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.count.get()
        # A new key has nothing stored, so nothing of it is looked up.
        new = stored is None
        count = 0 if new else stored[0]
        average = None if new else self.average.get()[0]
        last, added, counted = None, [], Counter()
        for row in sorted(rows, key=lambda r: r["batch_id"]):
            if row["kind"] == "step":
                started = row["first_value"] if average is None else average
                average = self.keep ** row["n"] * started + row["added"]
                count += row["n"]
            elif row["kind"] == "recent":
                last = row["category"]
                added += [(text,) for text in row["texts"]]
            else:
                counted.update(dict(zip(row["texts"], row["counts"])))
        self.count.update((count,))
        self.average.update((average,))
        self.last.update((last,))

        added = added[-self.recent_size :]
        held = [] if new or len(added) == self.recent_size else [tuple(r) for r in self.recent.get()]
        self.recent.put((held + added)[-self.recent_size :])
        before = self._counts_before(counted, 0 if new else stored[0])
        for name, n in counted.items():
            self.categories.updateValue((name,), (before.get(name, 0) + n,))
        yield Row(user_id=key[0], event_count=count, running_average=average)

    def _counts_before(self, names: Collection, count: int) -> dict:
        """Stored counts of the categories ``names``, maybe of more, after ``count`` records."""
        if not count:
            return {}
        # There are no more categories than records: a short map is read by one call.
        if count <= ENTRIES_A_CALL * len(names):
            return {name: n for (name,), (n,) in self.categories.iterator()}
        found = {name: self.categories.getValue((name,)) for name in names}
        return {name: value[0] for name, value in found.items() if value}

    def close(self) -> None:
        pass


class RecentBufferProcessor(StatefulProcessor):
    """The newest ``size`` entries of a key as list state."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("partitioned_records", "value string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.buffer.put([(text,) for text in initialState["partitioned_records"] or []])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added = [(row["entry"],) for row in _in_order(rows)][-self.size :]
        held = [] if len(added) == self.size else [tuple(r) for r in self.buffer.get()]
        kept = (held + added)[-self.size :]
        self.buffer.put(kept)
        yield Row(subtask=key[0], n_buffered=len(kept))

    def close(self) -> None:
        pass
