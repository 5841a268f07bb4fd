"""Request admission, session expiry and counts on streams. Folds are those of the batch forms over rows in time order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusops.operators.limits import LIMITS, Gate
from corpusops.streaming.ordered import Ordered, in_order


class Admission(Ordered):
    """State: the times that the longest window admits."""

    state = ["micros"]

    def __init__(self, key: str, tie: str, limits):
        super().__init__(key, tie)
        self.limits, self.columns = limits, [tie, "allowed", "reason"]
        self.keep = max(seconds for _, seconds, _ in limits) * 1_000_000

    def fold(self, rows: list[tuple[int, Any]], held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        gate = Gate(self.limits, [[m for (m,) in held]] * len(self.limits))
        reasons = [gate.admit(m) for m, _ in rows]
        longest = max(zip((s for _, s, _ in self.limits), gate.windows, strict=True), key=lambda x: x[0])[1]
        return [(tie, reason is None, reason) for (_, tie), reason in zip(rows, reasons, strict=True)], [(m,) for m in longest]

    def ended(self, held: list[tuple], micros: int) -> tuple[list[tuple], list[tuple], int | None]:
        held = [h for h in held if h[0] > micros - self.keep]
        return [], held, held[-1][0] + self.keep if held else None


def stream_admit(requests: DataFrame, key: str, ts: str, tie: str, limits=LIMITS, late: str = "1 hour") -> DataFrame:
    """(key, tie, allowed, reason, late). A request is decided once the watermark, `late` behind the newest time seen, has passed it, so files
    may be that much out of order. A request that comes later still has no decision and leaves no trace. A
    key's state goes when its longest window has passed without a request."""
    kind = requests.schema[tie].dataType.simpleString()
    return in_order(requests, key, ts, late, Admission(key, tie, limits), f"{tie} {kind}, allowed boolean, reason string")


class Sessions(Ordered):
    """State: first and last write of the session, and the number of writes."""

    state = ["first", "last", "n"]

    def __init__(self, key: str, tie: str, ttl: int):
        super().__init__(key, tie)
        self.ttl, self.columns = ttl * 1_000_000, ["first", "last", "n"]

    def fold(self, rows: list[tuple[int, Any]], held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        out = []
        for micros, _ in rows:
            if held and micros - held[0][1] > self.ttl:
                out, held = out + held, []
            held = [(held[0][0], micros, held[0][2] + 1)] if held else [(micros, micros, 1)]
        return out, held

    def ended(self, held: list[tuple], micros: int) -> tuple[list[tuple], list[tuple], int | None]:
        if held and micros - held[0][1] > self.ttl:
            return held, [], None
        return [], held, held[0][1] + self.ttl if held else None

    def late(self, rows: list[tuple[int, Any]]) -> list[tuple]:
        return [(micros, micros, 1) for micros, _ in rows]


def stream_sessions(writes: DataFrame, key: str, ts: str, tie: str, ttl: int, late: str = "1 hour") -> DataFrame:
    """(key, first, last, n, late): the sessions that have expired, each `ttl` seconds after its last write; a write renews
    its session. Times are in microseconds. A late write is returned by itself and renews nothing."""
    return in_order(writes, key, ts, late, Sessions(key, tie, ttl), "first bigint, last bigint, n bigint")


def stream_counts(requests: DataFrame, ts: str, by: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests per window and group; rows later than the watermark are left out by Spark."""
    timed = requests.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", every).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out so far because they were later than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
