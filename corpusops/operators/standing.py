"""A standing BM25 index: documents are tokenised once, and any number of searches read the index alone.

Documents are dealt to shards of about SHARD. A row of the index is a block, the postings of a term in a shard: for
each document the part of its score that the term gives, without the term's weight, and the greatest of these. Rows lie in folders by hash of the
term, sorted by term, so a search reads the folders and, by the statistics of row groups, the blocks of its terms.

A search adds up the parts of the blocks of its terms, in one job. With `prune` it first adds up, from the greatest parts alone, what a question can
score in each shard at most; the FIRST shards of each question with the highest bounds are scored, and of the others only those whose bound
reaches the k-th best score found there. The blocks of all others are never opened. That pays where documents of a shard
have much in common or a rare term decides; where each shard has a good document for each common term, hardly any block stays closed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from corpusops.operators import scoring as S
from corpusops.operators.lexical import FEW, asked_terms, idf, term_counts
from corpusops.operators.ranking import top_k
from corpusops.sources.files import stored

SHARD, FIRST = 256, 8
#: Documents whose postings in a folder go to one task when an index is built.
DEALT = 250_000


class Index:
    """An index at a path. by: columns whose groups are corpora of their own, each with its own statistics."""

    def __init__(self, spark: SparkSession, path: str, key: str, by: list[str] | None = None):
        self.spark, self.path, self.key, self.by = spark, path, key, by or []
        shape = spark.read.parquet(f"{path}/shape").first()
        self.folders, self.schema = shape["folders"], T.StructType.fromJson(json.loads(shape["schema"]))

    @staticmethod
    def build(corpus: DataFrame, key: str, text: str, path: str, by: list[str] | None = None, folders: int = 32, shard: int = SHARD, k1: float = 1.5, b: float = 0.75) -> Index:
        """Documents without tokens count in the statistics; those whose `by` is null form a group."""
        by = by or []
        posted = stored(term_counts(corpus, key, text, by), "postings")
        # a row a group: documents with tokens have their lengths in the postings, the others only count
        lengths = posted.groupBy(*by).agg(F.sum("tf").alias("tokens"))
        sizes = corpus.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
        stats = _same(sizes, lengths, by).select(*by, "n_docs", (F.coalesce("tokens", F.lit(0)) / F.col("n_docs")).alias("mean_length"))
        stats = stored(stats, "statistics")
        few = stats.limit(FEW + 1).count() <= FEW
        placed = _same(posted, F.broadcast(stats) if few else stats, by)
        shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard))
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
        # a folder's postings are dealt by shard to several tasks; they are sent once
        deal = max(1, -(-(stats.agg(F.sum("n_docs")).first()[0] or 0) // DEALT))
        named = placed.select(*by, "term", F.pmod(F.xxhash64(key), shards).cast("int").alias("shard"), F.struct(F.col(key), part.alias("part")).alias("posting"))
        named = named.withColumns({"folder": F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int"), "_deal": F.col("shard") % deal})
        rows = named.repartition(folders * deal, "folder", "_deal")
        blocks = rows.groupBy("folder", "_deal", *by, "term", "shard").agg(F.collect_list("posting").alias("postings"), F.max("posting.part").alias("most"))
        df = posted.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("_df"))
        weights = stored(_same(df, F.broadcast(stats) if few else stats, by).select(*by, "term", idf(F.col("n_docs"), F.col("_df")).alias("idf")), "weights")
        weighed = _same(blocks, weights, [*by, "term"]).select(*by, "term", "shard", "postings", "most", "idf", "folder")
        weighed.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/blocks")
        corpus.sparkSession.range(1).select(F.lit(folders).alias("folders"), F.lit(weighed.schema.json()).alias("schema")).write.parquet(f"{path}/shape")
        return Index(corpus.sparkSession, path, key, by)

    def blocks(self, asked: DataFrame, *columns: str) -> DataFrame:
        """The blocks of the asked terms: (query_id, by, shard, weight, columns)."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/blocks").select(*dict.fromkeys(["folder", *self.by, "term", "shard", "idf", *columns]))
        own = [c for c in self.by if c in asked.columns]
        met = rows.join(asked.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(self.folders)).cast("int")), ["folder", "term", *own])
        return met.select("query_id", *self.by, "shard", (F.col("qtf") * F.col("idf")).alias("weight"), *columns)

    def terms(self, questions: DataFrame) -> DataFrame:
        """(query_id, by, term) of the asked terms that documents hold."""
        asked = asked_terms(questions, [c for c in self.by if c in questions.columns])
        return self.blocks(asked, "term").select("query_id", *self.by, "term").distinct()

    def search(self, questions: DataFrame, k: int, prune: bool = False) -> DataFrame:
        """(query_id, by, key, score, rank) as `lexical.search` gives them."""
        if prune:
            return self._pruned(questions, k)[0]
        group = ["query_id", *self.by]
        own = [c for c in self.by if c in questions.columns]
        asked = asked_terms(questions, own)
        n = S.passes(asked, 1)
        some = [x for i in range(n) if (x := S.fetched(asked, own, n, i))]
        if n:
            every = reduce(DataFrame.unionByName, [self._best(x, own, questions.schema["query_id"].dataType.simpleString(), k) for x in some]) if some else self._summed(self.blocks(asked, "postings"), group)
        else:
            every = self._summed(self.blocks(asked, "postings"), group)
        return top_k(every, group, [F.desc("score"), F.asc(self.key)], k).select(*group, self.key, "score", "rank")

    def _best(self, asked: S.Asked, own: list[str], query: str, k: int) -> DataFrame:
        """(query_id, by, key, score): the best of each task. Blocks that some question asks for are sent once, to the task of their shard, which
        adds up the scores of a shard's documents at a time."""
        spark, key, places = self.spark, self.key, {t: i for i, t in enumerate(asked.terms.to_pylist())}
        terms = spark.createDataFrame(list(places.items()), "term string, _at int").withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(self.folders)).cast("int"))
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/blocks").join(F.broadcast(terms), ["folder", "term"])
        group = F.xxhash64(*self.by) if self.by else F.lit(0).cast("long")
        rows = rows.select(*self.by, group.alias("_group"), "shard", "_at", "idf", "postings").repartition("_group", "shard").sortWithinPartitions("_group", "shard")
        shared, by = spark.sparkContext.broadcast(asked), self.by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, now, of, kind = None, None, (), pa.int64()
            held: list[pa.RecordBatch] = []

            def add() -> None:
                for rows in held and [pa.Table.from_batches(held).combine_chunks()]:
                    lists = rows["postings"].combine_chunks()
                    n, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
                    part = flat.field("part").to_numpy(zero_copy_only=False) * np.repeat(rows["idf"].to_numpy(), n)
                    keys, doc = np.unique(S.names(flat.field(key)), return_inverse=True)
                    best.add(np.repeat(rows["_at"].to_numpy(), n), doc, part, keys)
                held.clear()

            def done() -> Iterator[pa.RecordBatch]:
                for out in S.found({0: best}, shared.value, kind) if best else []:
                    yield pa.RecordBatch.from_arrays([out["query_id"], *(pa.array([x] * out.num_rows, c) for x, c in zip(of, kinds, strict=True)), out["key"], out["score"]], ["query_id", *by, key, "score"])

            for batch in batches:
                kinds, kind = [batch[c].type for c in by], batch["postings"].type.value_type.field(key).type
                ids, shards = batch["_group"].to_numpy(), batch["shard"].to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(shards) != 0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    if now != (ids[lo], shards[lo]):
                        add()
                        if now is None or now[0] != ids[lo]:
                            yield from done()
                            of = tuple(batch[c][lo].as_py() for c in by)
                            best = S.Best(shared.value, tuple(of[by.index(c)] for c in own), k)
                        now = (ids[lo], shards[lo])
                    held.append(batch.slice(lo, hi - lo))
            add()
            yield from done()

        fields = {f.name: f.dataType.simpleString() for f in self.schema}
        postings = self.schema["postings"].dataType.elementType
        return rows.mapInArrow(run, ", ".join([f"query_id {query}", *(f"`{c}` {fields[c]}" for c in self.by), f"`{key}` {postings[key].dataType.simpleString()}", "score double"]))

    def skipped(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, n_blocks, n_opened): the blocks of each question's terms and how many of them a pruned search opens."""
        _, opened, asked = self._pruned(questions, k)
        every = self.blocks(asked)
        mine = ["query_id", *self.by, "shard"]
        seen = every.join(opened.select(*mine, F.lit(1).alias("_opened")), mine, "left")
        return seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("_opened").alias("n_opened"))

    def _pruned(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        own = [c for c in self.by if c in questions.columns]
        asked = stored(asked_terms(questions, own), "asked")
        few = asked.limit(FEW + 1).count() <= FEW
        near = F.broadcast(asked) if few else asked
        group = ["query_id", *self.by]
        bounds = stored(self.blocks(near, "most").groupBy(*group, "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "bounds")
        placed = bounds.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("bound"), "shard")))
        first = placed.where(F.col("_place") <= FIRST).select(*group, "shard")
        found = stored(self._scored(near, first, group), "found")
        least = top_k(found, group, [F.desc("score"), F.asc(self.key)], k).where(F.col("rank") == k).select(*group, F.col("score").alias("_least"))
        going = placed.where(F.col("_place") > FIRST).join(least, group, "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 2e-6)).select(*group, "shard")
        every = found.unionByName(self._scored(near, going, group))
        best = top_k(every, group, [F.desc("score"), F.asc(self.key)], k)
        return best.select("query_id", *self.by, self.key, "score", "rank"), first.unionByName(going), asked

    def _scored(self, asked: DataFrame, shards: DataFrame, group: list[str]) -> DataFrame:
        return self._summed(self.blocks(asked, "postings").join(shards, [*group, "shard"]), group)

    def _summed(self, blocks: DataFrame, group: list[str]) -> DataFrame:
        each = blocks.select(*group, "weight", F.inline("postings"))
        return each.groupBy(*group, self.key).agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score")).where("score > 0")


def _same(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of other, a row a group, matched null-safely; the only row of other without groups."""
    if not by:
        return rows.join(other, F.lit(True), "left")
    named = other.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on: Column = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(named[f"_of_{c}"])
    return rows.join(named, on, "left").drop(*[f"_of_{c}" for c in by])
