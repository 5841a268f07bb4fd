"""Request admission by key over sliding windows, and spend by day.

Whether a request is let in depends on the ones let in before it, so a key's requests are folded in time order.
Keys spread over tasks; a key with more requests than one task should hold is folded in pieces of time, its
state, the admitted times of the longest window, being carried along by the grouped iterator."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusops.sources.files import stored

#: Name and length in seconds of each window, and how many requests it admits.
LIMITS = (("minute", 60, 10), ("hour", 3600, 100), ("day", 86_400, 500))


class Gate:
    """The windows of one key. A request at t counts the admitted ones after t - length."""

    def __init__(self, limits=LIMITS, admitted: list[list[int]] | None = None):
        self.limits = limits
        self.windows = [deque(x) for x in admitted] if admitted else [deque() for _ in limits]

    def admit(self, micros: int, shut: str | None = None) -> str | None:
        """None if let in, else the first window that is full or, if none is, `shut`; rejected requests leave no trace."""
        for (_, seconds, _), held in zip(self.limits, self.windows, strict=True):
            while held and held[0] <= micros - seconds * 1_000_000:
                held.popleft()
        for (name, _, most), held in zip(self.limits, self.windows, strict=True):
            if len(held) >= most:
                return name
        if shut is None:
            self.take(micros)
        return shut

    def take(self, micros: int) -> None:
        for held in self.windows:
            held.append(micros)


def admit(requests: DataFrame, key: str, ts: str, tie: str, limits=LIMITS) -> DataFrame:
    """Adds allowed and reason. Rows are dealt by key and sorted by time inside the partitions; each partition is
    then read as a stream of Arrow batches, so not even a hot key's rows are ever held at once."""
    schema = requests.schema
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gate = None, Gate(limits)
        for rows in batches:
            reasons = []
            for k, micros in zip(rows[key].tolist(), rows["_micros"].tolist(), strict=True):
                if k != at:
                    at, gate = k, Gate(limits)
                reasons.append(gate.admit(micros))
            yield rows.drop(columns="_micros").assign(allowed=[r is None for r in reasons], reason=pd.Series(reasons, index=rows.index, dtype=object))

    dealt = requests.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_micros", tie)
    return dealt.mapInPandas(run, f"{named}, allowed boolean, reason string")


def offered_load(requests: DataFrame, key: str, ts: str, limits=LIMITS) -> DataFrame:
    """Adds for each window the number of the key's requests, let in or not, up to and with this one."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = requests
    for name, seconds, _ in limits:
        frame = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
        out = out.withColumn(f"last_{name}", F.count(F.lit(1)).over(frame))
    return out


def budget(admitted: DataFrame, ts: str, tie: str, cost: Column, most: float) -> DataFrame:
    """Adds spent (the day's cost up to and with the request) and within, to requests that `admit` let in. cost: the
    actual cost where it is known, else the estimate. Days are summed minute by minute first, so a busy day is not
    one task's."""
    day, hour = F.to_date(ts).alias("day"), F.hour(ts).alias("hour")
    rows = admitted.select("*", day, hour, F.minute(ts).alias("minute"), cost.alias("_cost"))
    minutes = rows.groupBy("day", "hour", "minute").agg(F.sum("_cost").alias("_sum"))
    before = minutes.select("day", "hour", "minute", F.coalesce(F.sum("_sum").over(Window.partitionBy("day").orderBy("hour", "minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    own = rows.withColumn("_own", F.sum("_cost").over(Window.partitionBy("day", "hour", "minute").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)))
    out = own.join(before, ["day", "hour", "minute"]).withColumn("spent", F.round(F.col("_before") + F.col("_own"), 6))
    return out.withColumn("within", F.col("spent") <= most).drop("hour", "minute", "_cost", "_before", "_own")


def coupled(requests: DataFrame, key: str, ts: str, tie: str, cost: Column, most: float, limits=LIMITS) -> DataFrame:
    """Adds allowed and reason as one gate would decide that sees all requests in the order of (ts, tie): a request that
    no window of its key stops is let in unless the day has spent `most` before, and is then refused for "budget"; refused ones leave
    no trace in any window. cost is not negative, so that a day's budget shuts at one request for all later ones.

    Where each day shuts is found by rounds. A round folds the keys with the shuts found so far and finds where the
    requests that it lets in spend the budget. Days up to the first whose shut differs from the one it was folded with are decided
    for good: each day's decisions depend on no later day. That day's shut is right after at most two rounds (the second without a
    shut, if the first one's was too early), so there are at most twice as many rounds as days. Decided days are
    stored and not folded again; of what they let in, only the last window's length goes along. The driver holds a row a day."""
    order = [F.col("_micros"), F.col(tie)]
    rows = stored(requests.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_day", F.floor(F.col("_micros") / 86_400_000_000)).withColumn("_cost", cost).withColumn("_in", F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    keep = max(seconds for _, seconds, _ in limits) * 1_000_000

    def folded(some: DataFrame, shuts: dict[int, tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, gate = None, Gate(limits)
            for part in batches:
                reasons = []
                for k, micros, t, day, let_in in zip(*(part[c].tolist() for c in (key, "_micros", tie, "_day", "_in")), strict=True):
                    if k != at:
                        at, gate = k, Gate(limits)
                    if let_in:
                        gate.take(micros)
                        reasons.append(None)
                    else:
                        reasons.append(gate.admit(micros, "budget" if most <= 0 or day in shuts and (micros, t) > shuts[day] else None))
                yield part.assign(reason=pd.Series(reasons, index=part.index, dtype=object))

        return some.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{schema}, reason string")

    def where_shut(decided: DataFrame) -> dict[int, tuple]:
        """The request of each day with which the budget is spent, minutes summed first."""
        paid = decided.where("reason IS NULL AND NOT _in").withColumn("_minute", F.floor(F.col("_micros") / 60_000_000))
        before = Window.partitionBy("_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
        starts = paid.groupBy("_day", "_minute").agg(F.sum("_cost").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
        crossing = starts.where((F.round("_before", 6) < most) & (F.round(F.col("_before") + F.col("_sum"), 6) >= most)).select("_day", "_minute", "_before")  # a row a day
        upto = Window.partitionBy("_day", "_minute").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        spent = paid.join(F.broadcast(crossing), ["_day", "_minute"]).withColumn("_spent", F.round(F.col("_before") + F.sum("_cost").over(upto), 6))
        return {r["_day"]: (r["at"]["_micros"], r["at"][tie]) for r in spent.where(F.col("_spent") >= most).groupBy("_day").agg(F.min(F.struct(*order)).alias("at")).collect()}

    done, shuts, todo = [], {}, rows
    while True:
        decided = stored(folded(todo, shuts))
        found = where_shut(decided)
        wrong = [d for d in sorted({*shuts, *found}) if shuts.get(d) != found.get(d)]
        own = decided.where("NOT _in")
        if not wrong:
            done.append(own)
            break
        done.append(own.where(F.col("_day") < wrong[0]))
        since = F.lit(wrong[0]) * F.lit(86_400_000_000) - keep
        carried = decided.where((F.col("_day") < wrong[0]) & F.col("reason").isNull() & (F.col("_micros") > since)).withColumn("_in", F.lit(True))
        todo = carried.unionByName(own.where(F.col("_day") >= wrong[0])).select(*rows.columns)
        shuts = {d: at for d, at in found.items() if d >= wrong[0]}
    return reduce(DataFrame.unionByName, done).withColumn("allowed", F.col("reason").isNull()).select(*requests.columns, "allowed", "reason")


def remaining(requests: DataFrame, key: str, ts: str, now: Column, limits=LIMITS) -> DataFrame:
    left = [F.greatest(F.lit(most) - F.count_if((F.col(ts) > now - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col(ts) <= now)), F.lit(0)).alias(f"left_{name}") for name, seconds, most in limits]
    return requests.groupBy(key).agg(*left)


def limiter_stats(requests: DataFrame, key: str, ts: str, day: Column, cost: float, most: float) -> DataFrame:
    today = requests.where(F.to_date(ts) == day)
    n = F.count(F.lit(1))
    return today.agg(n.alias("n_requests"), F.round(n * cost, 6).alias("spent"), F.round(F.lit(most) - n * cost, 6).alias("left"), F.count_distinct(key).alias("n_keys"))


def exempt(requests: DataFrame, allowed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests of allow-listed keys, which pass uncounted, and the others."""
    return requests.join(allowed, key, "left_semi"), requests.join(allowed, key, "left_anti")


def client_key(forwarded: Column, peer: Column) -> Column:
    """Hash of the first forwarded address, else of the peer's."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.substring(F.sha2(F.coalesce(F.nullif(first, F.lit("")), peer), 256), 1, 16)
