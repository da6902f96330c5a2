"""Stateful processors over ordered events, for batches and for streams.

The state machines are small classes that take one event at a time; ``fold`` runs them over a batch that Spark has
partitioned by key and sorted by order (state passes from row to row, nothing is gathered), and ``stream`` over a Structured
Streaming source with the state kept by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed times in seconds and counts of the detectors.
WALK_WINDOW, WALK_COUNT, READ_WINDOW, READ_COUNT = 2.0, 4, 30.0, 3


def _common(a: list[str], b: list[str]) -> list[str]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


class WalkDetector:
    """Several directories missed within a short time: their common ancestor, and a fresh start."""

    def __init__(self, count: int = WALK_COUNT, window: float = WALK_WINDOW):
        self.count, self.window, self.recent = count, window, []

    def see(self, event: dict) -> tuple | None:
        at, parts = event["at"], event["path"].split("/") if event["path"] else []
        self.recent = [(p, t) for p, t in self.recent if at - t < self.window] + [(parts, at)]
        if len(self.recent) < self.count:
            return None
        root = self.recent[0][0]
        for p, _ in self.recent[1:]:
            root = _common(root, p)
        self.recent = []
        return (at, "/".join(root))


class ReadDetector:
    """Several distinct files of one directory read without a long pause: the directory, once."""

    def __init__(self, count: int = READ_COUNT, window: float = READ_WINDOW):
        self.count, self.window, self.dirs = max(2, count), window, {}

    def see(self, event: dict) -> tuple | None:
        at, (directory, _, name) = event["at"], event["path"].rpartition("/")
        self.dirs = {d: s for d, s in self.dirs.items() if at - s[1] < self.window}
        names, _, fired = self.dirs.get(directory, ((), at, False))
        names = names if name in names or fired else (*names, name)
        fire = not fired and len(names) >= self.count
        self.dirs[directory] = (names, at, fired or fire)
        return (at, directory) if fire else None


class Budget:
    """Admits reads of blobs until the budget is spent: each blob is charged once, a refusal charges nothing."""

    def __init__(self, limit: int):
        self.limit, self.charged, self.seen = limit, 0, set()

    def see(self, event: dict) -> tuple:
        key, size = event["oid"], event["size"]
        if key in self.seen:
            return (event["seq"], "refetch", self.charged)
        if self.charged + size > self.limit:
            return (event["seq"], "refused", self.charged)
        self.seen.add(key)
        self.charged += size
        return (event["seq"], "admitted", self.charged)


class RefState:
    """The last oid of a ref; reports what each observation changed, a change of the same oids only once."""

    def __init__(self):
        self.oid, self.told = None, set()

    def see(self, event: dict) -> tuple | None:
        old, new = self.oid, event["new_oid"]
        self.oid = new
        if old == new or (old, new) in self.told:
            return None
        self.told.add((old, new))
        return (event["seq"], "Created" if old is None else "Deleted" if new is None else "Updated", old, new)


class Verdicts:
    """Visibility verdicts that are good for some seconds (a denial for less) and for one generation of the refs."""

    def __init__(self, allowed: float = 10.0, denied: float = 2.0, most: int = 4096):
        self.allowed, self.denied, self.most, self.known = allowed, denied, most, {}

    def see(self, event: dict) -> tuple:
        k = event["commit"]
        got = self.known.get(k)
        if got and got[2] == event["generation"] and event["at"] - got[1] < (self.allowed if got[0] else self.denied):
            return (event["seq"], "cached", got[0])
        if len(self.known) >= self.most:
            self.known = {}
        self.known[k] = (event["visible"], event["at"], event["generation"])
        return (event["seq"], "computed", event["visible"])


def fold(events: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """What the state machine of each key says, in order: ``schema`` is the key's column and then the answer's columns.

    Events are dealt by key and sorted; a task keeps the state of the key at hand only.
    """
    rows = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row[key] != current:
                    current, state = row[key], make()
                answer = state.see(row)
                if answer is not None:
                    out.append((current, *answer))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)], names=labels)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    kinds, labels = list(arrow.types), list(arrow.names)
    return rows.mapInArrow(run, schema)


def stream(events: DataFrame, key: str, order: str, make: Callable, schema: str) -> DataFrame:
    """The same over a streaming source: state is kept by Spark for each key; events of a batch are taken in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(group, frames, state: GroupState):
        import pandas as pd

        machine = pickle.loads(state.get[0]) if state.exists else make()
        out = []
        rows = sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r[order])
        for r in rows:
            r = {k: None if isinstance(v, float) and v != v else v for k, v in r.items()}
            answer = machine.see(r)
            if answer is not None:
                out.append((group[0], *answer))
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=labels)

    from pyspark.sql import types as T

    labels = T._parse_datatype_string(schema).names
    return events.groupBy(key).applyInPandasWithState(run, schema, "machine binary", "append", GroupStateTimeout.NoTimeout)
