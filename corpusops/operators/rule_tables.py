"""Intents by rules that are a table: (intent, place, pattern), thousands of them.

A pattern that can only match where one of some literals stands is tried only on questions that hold one: the literals
of all patterns are looked for at once, by `phrases.occurring`. Patterns without such literals are tried on
every question."""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as K, _parser as P

from pyspark.sql import Column, DataFrame, functions as F

from corpusops.operators.phrases import occurring


def required(pattern: str) -> list[str] | None:
    """Literals in lower case, one of which is in the lower-case form of any text that the pattern matches; None if none are known. The
    longest choice is taken: of parts that all have to match, the one whose shortest literal is longest."""
    try:
        return _best(P.parse(pattern))
    except (re.error, OverflowError, RecursionError):  # not this dialect: the pattern is tried everywhere
        return None


def _best(items) -> list[str] | None:
    choices, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is K.LITERAL and value < 128:
            run += chr(value)
            continue
        if run:
            choices.append([run.lower()])
            run = ""
        inner = None
        if op is K.SUBPATTERN:
            inner = _best(value[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _best(value[2])
        elif op is K.ATOMIC_GROUP:
            inner = _best(value)
        elif op is K.BRANCH:
            arms = [_best(arm) for arm in value[1]]
            inner = sorted({x for arm in arms for x in arm}) if all(arms) else None
        if inner:
            choices.append(inner)
    return max(choices, key=lambda c: min(map(len, c)), default=None)


def intents_by_table(questions: DataFrame, rules: DataFrame, key: Sequence[str], text: str = "text", seed: tuple[str, str, int] | None = None) -> DataFrame:
    """(key, intent, score, confidence) of every question, as `functions.rules.score_intents` gives them for the same rules: a point for
    each pattern that the lower-case text matches, ties to the smaller place, the seed (intent, pattern on the text as
    it is, points) first where it matches. rules: (intent, place, pattern), small enough for the driver, as they are patterns."""
    spark = questions.sparkSession
    table = rules.select("intent", "place", "pattern").collect()
    known = [(i, r.intent, r.place, r.pattern, required(r.pattern)) for i, r in enumerate(table)]
    literal = spark.createDataFrame([(x, i) for i, *_, xs in known for x in xs or ()], "literal string, rule int")
    patterns = spark.createDataFrame([k[:4] for k in known], "rule int, intent string, place int, pattern string")
    rows = questions.select(*key, F.col(text).alias("_text"), F.lower(text).alias("_low"))

    anywhere = [F.struct(F.lit(intent).alias("intent"), F.lit(place).alias("place"), F.col("_low").rlike(p).cast("int").alias("points")) for _, intent, place, p, xs in known if not xs]
    parts = [rows.select(*key, F.inline(F.array(*anywhere))).where("points > 0")] if anywhere else []
    met = occurring(rows, literal, "_low", "literal", [*key, "_low"]).join(F.broadcast(literal), "literal").select(*key, "_low", "rule").distinct()  # a row a literal
    parts.append(met.join(F.broadcast(patterns), "rule").where(F.regexp_like("_low", F.col("pattern"))).select(*key, "intent", "place", F.lit(1).alias("points")))
    if seed:
        place = min((r.place for r in table if r.intent == seed[0]), default=None)
        if place is not None:
            parts.append(rows.where(F.col("_text").rlike(seed[1])).select(*key, F.lit(seed[0]).alias("intent"), F.lit(-1).alias("place"), F.lit(seed[2]).alias("points")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    scored = every.groupBy(*key, "intent").agg(F.sum("points").cast("int").alias("score"), F.min("place").alias("place"))
    best = scored.groupBy(*key).agg(F.max(F.struct("score", (-F.col("place")).alias("first"), "intent")).alias("b"))
    return rows.select(*key).join(best, list(key), "left").select(*key, *_outcome(F.col("b")))


def _outcome(best: Column) -> list[Column]:
    hit = best.isNotNull()
    return [
        F.when(hit, best["intent"]).otherwise("general").alias("intent"),
        F.when(hit, best["score"]).otherwise(0).alias("score"),
        F.when(hit, F.least(F.lit(0.95), F.round(0.6 + 0.15 * best["score"], 6))).otherwise(0.3).alias("confidence"),
    ]
