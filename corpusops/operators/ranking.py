"""Ranks, keep-first and fusion: what every retrieval job ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group and their rank. Spark cuts each task's rows to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def keep_first(df: DataFrame, key: list[Column], order: list[Column], drop_empty: bool = False) -> DataFrame:
    """The first row of each key; rows without a key all stay, or go if drop_empty."""
    named = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    empty = F.coalesce(key[-1], F.lit("")) == ""
    return named.where(((F.col("_rn") == 1) & ~empty) if drop_empty else ((F.col("_rn") == 1) | empty)).drop("_rn")


def fuse(ranked: DataFrame, weights: list[float], k: int = 60) -> DataFrame:
    """(query_id, list, key, rank) to (query_id, key, score, first_list, first_rank): the weighted sum of
    1 / (k + rank); weights are by the number of the list. A key that a list repeats adds each time; the first
    place breaks ties."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list") + 1)
    shares = ranked.select("query_id", "key", "list", "rank", (weight / (k + F.col("rank"))).alias("share"))
    fused = shares.groupBy("query_id", "key").agg(F.sum("share").alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.select("query_id", "key", "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float], k: int = 60) -> DataFrame:
    """fuse for lists (query_id, key, rank) that are tables of their own."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", F.lit(i).alias("list"), "key", "rank")
        every = part if every is None else every.unionByName(part)
    return fuse(every, weights, k)


def stable_key(fields: list[str], content: str) -> Column:
    """`field:value` of the first field that isn't empty, else the SHA-1 of the content."""
    named = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}:"), F.col(f).cast("string"))) for f in fields]
    return F.coalesce(*named, F.concat(F.lit("sha1:"), F.sha1(F.coalesce(F.col(content), F.lit("")))))


def merge_sources(found: DataFrame, kinds: list[str], key: str, k: int) -> DataFrame:
    """Adds score, the first of the kinds that a row has, and rank: the k best rows of each question whatever their
    source; nothing is removed as repeated."""
    return top_k(found.withColumn("score", F.coalesce(*kinds)), ["query_id"], [F.desc("score"), F.asc(key)], k)
