"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected on `dims` Gaussian directions. If two vectors are d apart, the squared distance of
their projections over d squared has a chi-square distribution with dims degrees of freedom. The
projections of all vectors are split by a kd-tree whose leaves hold about `leaf` vectors; its planes are
fitted on at most `sample` projections (the rows of smallest id hash), every row is indexed.

A query first searches its own leaf: projections come box by box of a finer kd-tree, nearest box first, and
are verified in the original space until the chi-square test holds: a vector still unseen, projected at
r or more from the query, is nearer than the k-th found at d only with probability below
1 - P(chi2 <= r^2 / d^2), and that is `miss` at most. With the d found there, the query goes on to every
other leaf whose box does not already satisfy the test, and the best k of all leaves are its answer.

Where the k-th distance is close to the mean one, few directions can't tell near from far, and a strict `miss` lets
everything through; the defaults verify a quarter to a third of the vectors of the given tables, at a recall of 0.95 and more (a
test holds both). `miss` is a bound for one vector at the distance of the k-th; nearer ones are missed more rarely.

Of equal vectors only the rows of the k + 1 smallest ids are candidates, as no query can have others among its
k, so a vector that a third of the rows share is no crowd. Work is dealt by (leaf, part of the leaf). A task
holds the vectors of a part, each sent once, and the queries of the leaf stream past them. The planes have at
most a quarter as many leaves as there are sampled rows; beyond `leaf` times that many vectors (17 million by
default) leaves have more parts, and the work of a query grows with the table.

Only vec_id and embedding are read, so other columns may have any names. An empty table gives no rows.

Defined results: null, zero or non-finite vectors, and vectors of null components, take no part, nor
do rows without an id or of another length than the most common one. Repeated vec_ids are separate
candidates, but never their own query's. Ties go to the smaller id. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.llm.common import stored, table


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi2 <= x) for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_limit(miss: float, dims: int) -> float:
    """The x with P(chi2 > x) = miss."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi_square_cdf(mid, dims) > miss else (lo, mid)
    return hi


class Planes:
    """A kd-tree over sampled points: a heap-ordered array of splitting planes of 2 ** depth leaves."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.dims = depth, points.shape[1]
        self.axis, self.at = np.zeros(2**depth, int), np.zeros(2**depth)
        stack = [(1, points)]
        while stack:
            node, rows = stack.pop()
            if node >= 2**depth:
                continue
            if len(rows):
                axis = int(np.argmax(rows.max(0) - rows.min(0)))
                self.axis[node], self.at[node] = axis, np.median(rows[:, axis])
            right = rows[:, self.axis[node]] > self.at[node]
            stack += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - 2**self.depth

    def near(self, point: np.ndarray, within: float) -> list[int]:
        """Leaves whose boxes come closer to the point than `within`."""
        out, stack = [], [(1, np.zeros(self.dims))]
        while stack:
            node, gap = stack.pop()
            if gap @ gap > within * within:
                continue
            if node >= 2**self.depth:
                out.append(node - 2**self.depth)
                continue
            axis, side = self.axis[node], point[self.axis[node]] - self.at[node]
            far = gap.copy()
            far[axis] = max(far[axis], abs(side))
            stack += [(2 * node + (side > 0), gap), (2 * node + (side <= 0), far)]
        return out


class Local:
    """The kd-tree of one part of a leaf: boxes of at most `bucket` projections, visited nearest first."""

    def __init__(self, projected: np.ndarray, bucket: int = 128):
        self.rows, stack, self.lo, self.hi = [], [np.arange(len(projected))], [], []
        while stack:
            rows = stack.pop()
            if len(rows) <= bucket:
                self.rows.append(rows)
                self.lo.append(projected[rows].min(0))
                self.hi.append(projected[rows].max(0))
                continue
            axis = int(np.argmax(np.ptp(projected[rows], axis=0)))
            order = rows[np.argsort(projected[rows, axis], kind="stable")]
            stack += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.points = [projected[rows] for rows in self.rows]

    def boxes(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(squared projected distance, box) in ascending order."""
        gaps = np.maximum(np.maximum(self.lo - query, query - self.hi), 0)
        away = (gaps * gaps).sum(1)
        order = np.argsort(away)
        return zip(away[order].tolist(), order.tolist(), strict=True)


def search(local: Local, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, projected: np.ndarray, own: int, bound: float, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, distances) of the best k of a part, for a query that has k neighbours within `bound`, and how many vectors were
    verified. A box, and a projection in it, is passed over once the chi-square test holds for it at the k-th distance so far."""
    best_ids, best, verified = np.empty(0, np.int64), np.empty(0), 0
    for away, box in local.boxes(projected):
        worst = min(bound, best[-1] if len(best) >= k else math.inf)
        if away > limit * worst * worst:
            break
        gaps = local.points[box] - projected
        rows = local.rows[box][np.einsum("ij,ij->i", gaps, gaps) <= limit * worst * worst]
        rows = rows[ids[rows] != own]
        verified += len(rows)
        gaps = vectors[rows] - query
        found = np.sqrt((gaps * gaps).sum(1))
        near = found <= worst
        if near.any():
            best, best_ids = np.append(best, found[near]), np.append(best_ids, ids[rows[near]])
            order = np.lexsort((best_ids, best))[:k]
            best, best_ids = best[order], best_ids[order]
    return best_ids, best, verified


def directions(width: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, dims: int | None = None, miss: float = 0.12, leaf: int = 1024, sample: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of vectors (vec_id, embedding) to those for which
    is_query holds, by Euclidean distance in double precision. dims: even; three quarters of the vectors' width if not given, 48 at most."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    widths = good.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, count = widths
    dims = dims or max(2, min(48, width * 3 // 8 * 2))
    matrix, limit = directions(width, dims), chi_square_limit(miss, dims)
    good = good.where(F.size("embedding") == width)
    depth = max(0, math.ceil(math.log2(max(1, count / leaf))))
    depth = min(depth, int(math.log2(sample)) - 2)
    # at most `sample` vectors come to the driver
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    planes = Planes(some.flatten().to_numpy().reshape(-1, width) @ matrix, depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(leaf=planes.leaf(np.array(rows["embedding"].tolist()) @ matrix))

    placed = stored(good.mapInPandas(place, "vec_id long, embedding array<double>, leaf long"))
    alike = F.dense_rank().over(Window.partitionBy("leaf", "embedding").orderBy("vec_id"))
    data = stored(placed.withColumn("_alike", alike).where(F.col("_alike") <= k + 1).drop("_alike"))
    parts = data.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("parts"))  # at most 2 ** depth rows
    data = data.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    asked = placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "leaf")

    def past(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The vectors of a part (kind 0) come first and are held, its queries (kind 1) follow."""
        at, held, local = None, [], None
        for batch in batches:
            out = []
            for (leaf_no, part, kind), rows in batch.groupby(["leaf", "part", "kind"], sort=False):
                if (leaf_no, part) != at:
                    at, held, local = (leaf_no, part), [], None
                points = np.array(rows["vector"].tolist())
                if kind == 0:
                    held.append((rows["id"].to_numpy(), points))
                elif held:
                    if local is None:
                        ids, kept = (np.concatenate(x) for x in zip(*held, strict=True))
                        local = Local(kept @ matrix)
                    for own, query, projected, bound in zip(rows["id"].tolist(), points, points @ matrix, rows["bound"].tolist(), strict=True):
                        found, away, _ = search(local, kept, ids, query, projected, own, bound, k, limit)
                        out += zip([own] * len(found), found.tolist(), away.tolist(), strict=True)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def visit(queries: DataFrame) -> DataFrame:
        """queries: query_id, query, bound, leaf; every part of the leaf is visited."""
        to = parts.toDF("to_leaf", "to_parts")
        sides = queries.join(F.broadcast(to), F.col("leaf") == F.col("to_leaf")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_parts") - 1)))
        sides = sides.select("leaf", "part", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("query").alias("vector"), "bound")
        held = data.select("leaf", "part", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0.0).alias("bound"))
        dealt = held.unionByName(sides).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
        return dealt.mapInPandas(past, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(best(visit(asked.withColumn("bound", F.lit(math.inf)))))
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            points = np.array(rows["query"].tolist()).reshape(-1, width) @ matrix
            bound = rows["bound"].astype(float).fillna(math.inf)
            more = [[x for x in planes.near(p, math.sqrt(limit) * b) if x != home] for p, b, home in zip(points, bound, rows["leaf"], strict=True)]
            yield rows.assign(bound=bound, to=more)

    going = asked.join(bounds, "query_id", "left").mapInPandas(onward, "query_id long, query array<double>, leaf long, bound double, to array<long>")
    rest = visit(going.select("query_id", "query", "bound", F.explode("to").alias("leaf")))
    answer = best(first.select("query_id", "vec_id", "score").unionByName(rest))
    return answer.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_stable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
