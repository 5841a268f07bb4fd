"""Exact nearest neighbours with filters, thresholds and score transforms.

Distances are matrix products in numpy on Arrow batches, and what is shuffled of them is k rows per question
and block of the corpus, never a pair of every question with every document. A question table of at most FEW
rows goes to the tasks as it is, and the corpus is not shuffled. A larger one is sent past the parts of
the corpus: each vector of the corpus is sent once, to its part, which a task holds while the questions stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusops.operators.ranking import top_k

#: Questions that are sent along with the tasks.
FEW = 4096
#: Vectors of the corpus that a task holds, and questions that it compares with them at a time.
PART, AT_ONCE = 16_384, 256


def distance_to_score(distance: Column, kind: str = "cosine") -> Column:
    """1 - d, or 1 / (1 + d)."""
    return 1 - distance if kind == "cosine" else 1 / (1 + distance)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without a length stay zero."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


class Block:
    """Vectors of the corpus that questions are compared with. Batches have columns id, vector and same."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, metric: str):
        whole = pa.Table.from_batches(batches).combine_chunks()
        self.ids, self.same = whole["id"].combine_chunks(), whole["same"].combine_chunks()
        self.numbers, self.k, self.metric = self.ids.to_numpy(zero_copy_only=False), k, metric
        vectors = np.concatenate([matrix(c) for c in whole["vector"].chunks])
        self.vectors = unit(vectors) if metric == "cosine" else vectors

    def distances(self, points: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return np.round(1 - unit(points) @ self.vectors.T, 6) + 0.0  # no negative zero
        gaps = ((p - self.vectors) for p in points)
        return np.round([np.einsum("ij,ij->i", g, g) for g in gaps], 6)

    def best(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, distance) of the k nearest to each question."""
        for lo in range(0, asked.num_rows, AT_ONCE):
            some = asked.slice(lo, AT_ONCE)
            away = self.distances(matrix(some["vector"]))
            codes = pa.concat_arrays([some["same"].cast(pa.string()), self.same.cast(pa.string())]).dictionary_encode().indices.to_numpy()
            away[codes[: len(away), None] != codes[None, len(away) :]] = np.inf
            k = min(self.k, away.shape[1])
            rows, cols = np.nonzero((away <= np.partition(away, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(away))
            order = np.lexsort((self.numbers[cols], away[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[place < k], cols[place < k]
            yield pa.RecordBatch.from_arrays([some["id"].take(pa.array(rows)), self.ids.take(pa.array(cols)), pa.array(away[rows, cols])], ["query_id", "vec_id", "distance"])


def knn(questions: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", same: list[str] | None = None, few: int = FEW, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, distance). questions: (query_id, query[, same]); corpus: (vec_id, embedding[,
    same]). Rows of other values in `same` are left out before the search. Distances (cosine, or squared
    Euclidean) are rounded to 6 places, ties go to the smaller vec_id. Null vectors take no part; one of zeros is
    at cosine distance 1 of all."""
    group = (F.to_json(F.struct(*same)) if same else F.lit("")).alias("same")
    asked = questions.where("query IS NOT NULL").select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<double>").alias("vector"), group)
    rows = corpus.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), group)
    first = asked.limit(few + 1).toArrow()  # at most few + 1 questions come to the driver
    schema = "query_id long, vec_id long, distance double"
    if first.num_rows <= few:
        points = first.combine_chunks().to_batches()

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in points if batch.num_rows else []:
                    yield from Block([batch], k, metric).best(some)

        found = rows.mapInArrow(past, schema)
    else:
        found = side_by_side(asked, rows, part).mapInArrow(lambda batches: meet(batches, k, metric), schema)
    return top_k(found, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k)


def side_by_side(asked: DataFrame, rows: DataFrame, part: int) -> DataFrame:
    """(part, kind, id, vector, same): for each part of the corpus its vectors (kind 0), then all questions."""
    parts = max(1, -(-rows.count() // part))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), "id", "vector", "same")
    by = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "id", "vector", "same")
    return held.unionByName(by).repartition("part").sortWithinPartitions("part", "kind")


def meet(batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The vectors of a part are held, its questions stream past them."""
    at, held, block = None, [], None
    for batch in batches:
        part, kind = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if part[lo] != at:
                at, held, block = part[lo], [], None
            if kind[lo] == 0:
                held.append(batch.slice(lo, hi - lo).select(["id", "vector", "same"]))
            elif held:
                block = block or Block(held, k, metric)
                yield from block.best(batch.slice(lo, hi - lo))


def verified(first: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Rows of first (vec_id, name, ...) whose vector's text (vec_id, text) holds the name, in any case."""
    return first.join(texts, "vec_id").where(F.contains(F.lower(text), F.lower(name)))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of each label."""
    flat = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))
