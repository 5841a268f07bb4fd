"""Which of many terms occur in texts, anywhere and however long both are.

The distinct terms make one Aho-Corasick automaton, built once a worker; every text is read once and gives the terms
in it, so what leaves a task is a row for each (text, term) and no text is cut into pieces. Terms of up to MOST_CHARS
characters, which are counted, go along with the tasks; more are dealt to several automata by hash, each of
which reads the texts, and beyond MOST_PASSES of them texts and terms meet by equi-joins on runs of three characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_CHARS, MOST_PASSES = 2_000_000, 16
#: Terms that are fetched before they are counted.
FIRST = 20_000


class Terms:
    """Terms, and their automaton where it is asked for."""

    def __init__(self, terms: list[str]):
        self.terms = terms

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term in filter(None, self.terms):
            out.add_word(term, term)
        out.make_automaton()
        return out

    def found_in(self, text: str) -> set[str]:
        """An empty term is in every text."""
        found = {term for _, term in self.automaton.iter(text)} if len(self.automaton) else set()
        return found | {""} if "" in self.terms[:1] else found


def scan(texts: DataFrame, terms: list[str], text: str, term: str, keep: list[str]) -> DataFrame:
    """One pass of the texts: keep and each term in them."""
    shared = texts.sparkSession.sparkContext.broadcast(Terms(sorted(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(0)):
                if value.is_valid:
                    mine = shared.value.found_in(value.as_py())
                    at += [i] * len(mine)
                    found += mine
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[1:]], pa.array(found, pa.string())], [*keep, term])

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(F.col(text).alias("_scanned"), *keep).mapInArrow(run, f"{schema}, `{term}` string")


def by_runs(texts: DataFrame, parts: DataFrame, text: str, term: str, keep: list[str]) -> DataFrame:
    """The same by joins: distinct runs of up to three characters of a text, under a hash of it, meet the first ones of the
    terms; texts are fetched once for each pair that met, and looked through."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col(text), i, n))))
    named = texts.select(*{*keep, text}, F.xxhash64(text).alias("_id"))
    cut = named.where(F.col(text).isNotNull()).select("_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), runs))).alias("_run")).distinct()
    met = cut.join(parts.select(term, F.substring(term, 1, 3).alias("_run")).distinct(), "_run").select("_id", term)
    return named.join(met, "_id").where(F.contains(text, term)).select(*keep, term)


def occurring(texts: DataFrame, parts: DataFrame, text: str, term: str = "term", keep: list[str] | None = None) -> DataFrame:
    """(keep, term): for each row of texts the distinct terms that its text contains as they are. Null texts contain none; an
    empty term is in every other text. keep: columns of texts, all by default."""
    keep = keep or texts.columns
    distinct = parts.select(term).where(F.col(term).isNotNull()).distinct()
    some = [r[0] for r in distinct.limit(FIRST).collect()]
    if len(some) < FIRST and sum(map(len, some)) <= MOST_CHARS:
        return scan(texts, some, text, term, keep) if some else texts.where("false").select(*keep, F.lit("").alias(term))
    passes = -(-distinct.agg(F.sum(F.length(term))).first()[0] // MOST_CHARS)
    if passes > MOST_PASSES:
        return by_runs(texts, distinct, text, term, keep)
    mine = lambda p: [r[0] for r in distinct.where(F.pmod(F.xxhash64(term), F.lit(passes)) == p).collect()]
    return reduce(DataFrame.unionByName, [scan(texts, mine(p), text, term, keep) for p in range(max(1, passes))])
