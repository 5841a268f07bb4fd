"""Keyed folds in time order on streams whose rows come out of order.

A row waits in state until the watermark has passed it, as only then no earlier row can come any more. So a fold sees each key's rows in
the order that a batch job sorts them into, whatever files they came in. Rows that are behind the watermark when they come are not folded:
they leave at once, marked as late. Keys are dealt into parcels, and the state is a parcel's: a call of the state store costs about as
much as folding a hundred rows, and a key has few rows in a batch. A timer of event time wakes the parcel. State is kept by the
RocksDB provider and ends by timers, as Spark grants a time to live in processing time only."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Parcels that keys are dealt into; a task holds one parcel's waiting rows at a time.
PARCELS = 1024


def packed(table: pd.DataFrame) -> tuple[bytes]:
    rows = pa.RecordBatch.from_pandas(table, preserve_index=False)
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        return (sink.getvalue().to_pybytes(),)


def unpacked(state: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(state[0]).read_pandas()


class Ordered(StatefulProcessor):
    """Folds (micros, tie) of each key in order. Subclasses give `state` (the columns of what they hold of a key, a list of rows), `columns` (of
    what they return, before the column late), and `fold` and `ended`, which see one key at a time."""

    state: list[str] = []
    columns: list[str] = []

    def __init__(self, key: str, tie: str):
        self.key, self.tie = key, tie

    def fold(self, rows: list[tuple[int, Any]], held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """From rows in time order and the state: what to return, and the new state."""
        raise NotImplementedError

    def ended(self, held: list[tuple], micros: int) -> tuple[list[tuple], list[tuple], int | None]:
        """When time has come to micros: what to return, the state that is left, and when to look again."""
        raise NotImplementedError

    def late(self, rows: list[tuple[int, Any]]) -> list[tuple]:
        return [(tie, *[None] * (len(self.columns) - 1)) for _, tie in rows]

    def init(self, handle) -> None:
        self.handle = handle
        # tables of (key, micros, tie), one of each batch; a table of (key, state); and the time of the parcel's only timer
        self.waiting = handle.getListState("waiting", "packed binary")
        self.held = handle.getValueState("held", "packed binary")
        self.timer = handle.getValueState("timer", "millis bigint")

    def close(self) -> None:
        pass

    def wake(self, millis: int) -> None:
        """Sets the timer, if none is set for an earlier time."""
        if before := self.timer.get():
            if before[0] <= millis:
                return
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(millis)
        self.timer.update((millis,))

    def table(self, keys: list, rows: list[tuple], late: bool) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=self.columns, dtype=object)
            out.insert(0, self.key, keys)
            yield out.assign(late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        # the last three columns, whatever Spark calls them
        new = pd.concat([part.iloc[:, -3:].set_axis(["key", "tie", "micros"], axis=1) for part in rows], ignore_index=True)
        late = new["micros"] // 1000 < mark
        behind, ahead = new[late], new[~late]
        if len(ahead):
            self.waiting.appendValue(packed(ahead))
            self.wake(int(ahead["micros"].min()) // 1000 + 1)
        yield from self.table(behind["key"].tolist(), self.late(list(zip(behind["micros"].tolist(), behind["tie"].tolist(), strict=True))), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [unpacked(part) for part in self.waiting.get()]
        rows = pd.concat(waiting, ignore_index=True) if waiting else pd.DataFrame({"key": [], "tie": [], "micros": []})
        now = rows["micros"] // 1000 < mark
        due, left = rows[now].sort_values(["key", "micros", "tie"]), rows[~now]
        if len(left) < len(rows):
            if len(left):
                self.waiting.put([packed(left)])
            else:
                self.waiting.clear()

        held: dict[Any, list[tuple]] = {}
        if state := self.held.get():
            table = unpacked(state)
            for k, *values in zip(*(table[c].tolist() for c in ["key", *self.state]), strict=True):
                held.setdefault(k, []).append(tuple(values))
        ready: dict[Any, list[tuple[int, Any]]] = {}
        for k, micros, tie in zip(*(due[c].tolist() for c in ("key", "micros", "tie")), strict=True):
            ready.setdefault(k, []).append((micros, tie))

        keys, out, kept, again = [], [], [], [int(left["micros"].min())] if len(left) else []
        for k in held.keys() | ready.keys():
            mine, own = self.fold(ready[k], held.get(k, [])) if k in ready else ([], held[k])
            more, own, later = self.ended(own, mark * 1000)
            keys += [k] * (len(mine) + len(more))
            out += mine
            out += more
            kept += [(k, *h) for h in own]
            again += [later] if later is not None else []
        if kept:
            self.held.update(packed(pd.DataFrame(kept, columns=["key", *self.state])))
        elif state:
            self.held.clear()
        self.timer.clear()
        if again:
            self.wake(max(min(again) // 1000 + 1, mark + 1))
        yield from self.table(keys, out, False)


def in_order(rows: DataFrame, key: str, ts: str, late: str, processor: Ordered, schema: str) -> DataFrame:
    """schema: of the processor's columns. Rows whose key is null take no part: they only move time forward. Neither do rows without a time."""
    kind = rows.schema[key].dataType.simpleString()
    # one condition that needs the time: as two, that on the key would be pushed below the watermark
    timed = rows.withWatermark(ts, late).where(F.when(F.col(ts).isNull(), False).otherwise(F.col(key).isNotNull()))
    parcel = F.pmod(F.xxhash64(key), F.lit(PARCELS)).cast("int").alias("_parcel")
    dealt = timed.select(parcel, key, processor.tie, F.unix_micros(ts).alias("_micros"))
    return dealt.groupBy("_parcel").transformWithStateInPandas(processor, f"{key} {kind}, {schema}, late boolean", "append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, in at most three partitions a core: each has a store that every batch opens,
    commits and uploads, and a task holds one parcel at a time, however many its partition has."""
    partitions = "spark.sql.shuffle.partitions"
    before = {name: spark.conf.get(name) for name in ("spark.sql.streaming.stateStore.providerClass", partitions)}
    for name, value in zip(before, (PROVIDER, min(int(before[partitions]), 3 * spark.sparkContext.defaultParallelism)), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def to_files(out: DataFrame, path: str, state: str) -> StreamingQuery:
    """Starts a query that writes each row once, those that came late to the folder late=true of path, the others to late=false."""
    with rocksdb(out.sparkSession):
        return out.writeStream.format("parquet").partitionBy("late").outputMode("append").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
