"""Ranked lexical search, a term at a time, with a limit on accumulators.

Documents are cut into blocks where they are read. A block becomes one row of an inverted index over the terms that
some item asks for: per term, the documents that hold it and how often. The index is written once. Document
frequencies, the number of documents and their length are summed from it; a second pass scores the items in every block.

In a block an item takes its terms rarest first and adds what each term gives to the accumulators of the documents
that hold it. Once what the remaining terms can give at most is less than the k-th best partial score, or
than the k-th best score of the task's earlier blocks, a document without an accumulator can't come among the best, not even
by a tie, and no more accumulators are made; those there are updated to the end, so that all scores that
are returned are exact. An item whose terms can't give enough in a block skips it. A task returns k documents an
item, and these meet in two steps, first within groups of tasks.

Items go along with the tasks in parts of at most ITEM_TERMS terms, counted before; with more, parts take turns, each
with its own pass over the documents.

Defined results: texts that are null, empty or without a term hold nothing and count for nothing. One document per row of
the input, repeated rows too; a null doc_id comes after all others of its score. One ranking per row of items, which keeps its item_id,
null or repeated; an item without terms, or whose terms no document holds, gives no rows, and neither does an empty table. Texts of any
length are read whole. Of documents only doc_id and text are read, of items item_id and text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.llm.common import stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_TERMS = 500_000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000
#: Bytes of UTF-8 that terms are made of, in lower case; all others are a space.
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


# --- the index --------------------------------------------------------------------------------------

INDEX = "documents long, terms long, ids array<long>, sizes array<long>, asked array<int>, df array<long>, postings array<int>, tf array<long>"


def block_of(ids: pa.Array, texts: list[str | None], numbers: dict[bytes, int]) -> list:
    """A row of INDEX: documents with a term and their terms; doc_id and terms of each document that holds an asked
    term; the numbers of the asked terms in order, with the documents of each (positions among ids) and its occurrences."""
    sizes, found = [], []
    for text in texts:
        words = terms_of(text) if text else []
        sizes.append(len(words))
        found.append([*filter(None, map(numbers.get, words))])
    held = [k for k, x in enumerate(found) if x]
    flat = np.array([t for k in held for t in found[k]], np.int64)
    doc = np.repeat(np.arange(len(held)), [len(found[k]) for k in held])
    key, tf = np.unique(flat * max(1, len(held)) + doc, return_counts=True)
    term, posting = key // max(1, len(held)), key % max(1, len(held))
    asked, df = np.unique(term, return_counts=True)
    own = ids.take(pa.array(held, pa.int64()))
    return [sum(n > 0 for n in sizes), sum(sizes), own, [sizes[k] for k in held], asked, df, posting, tf]


def slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def index(docs: DataFrame, numbers: dict[bytes, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index of docs, a row a block. numbers: of the asked terms, from 1."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    kinds = [pa.int64(), pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, block_bytes):
                row = block_of(batch.column(0).slice(lo, hi - lo), texts[lo:hi], shared.value)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t.value_type)) for x, t in zip(row[2:], kinds[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), *lists], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


# --- scoring ----------------------------------------------------------------------------------------


class Block(NamedTuple):
    """A row of the index with what every posting adds to the score of its document."""

    ids: np.ndarray
    no_id: np.ndarray
    asked: dict[int, int]  # place of each term in starts and most
    starts: list[int]
    postings: np.ndarray
    gives: np.ndarray
    most: list[int]  # that a posting of the term gives


def weighted(row: dict[str, pa.Array], weight: np.ndarray, documents: int, terms: int) -> Block:
    sizes, asked, df, tf = (row[c].to_numpy().astype(np.int64) for c in ("sizes", "asked", "df", "tf"))
    postings = row["postings"].to_numpy()
    if len(sizes) and 75 * int(sizes.max()) * documents >= 1 << 63:
        m = np.array([25 + 75 * n * documents // terms for n in sizes.tolist()], np.int64)
    else:
        m = 25 + 75 * sizes * documents // max(1, terms)
    gives = np.repeat(weight[asked], df) * (1_000_000_000 * tf // (1000 * tf + 8 * m[postings]))
    starts = np.append(0, np.cumsum(df))
    most = np.maximum.reduceat(gives, starts[:-1]).tolist() if len(asked) else []
    ids = row["ids"]
    return Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), {t: k for k, t in enumerate(asked.tolist())}, starts.tolist(), postings, gives, most)


class Item(NamedTuple):
    key: int
    item_id: int | None
    terms: list[tuple[int, int]]  # number and occurrences, rarest term first


def best_of(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest score first, then smallest doc_id."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], no_id[some], -scores[some]))[:k]]


def accumulate(block: Block, item: Item, k: int, least: int, sums: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, int]:
    """The documents that have an accumulator at the end, their scores in sums, and the number of terms that could
    make accumulators. least: a score that k documents are known to reach. sums and has come zeroed."""
    here = [(block.asked[t], r) for t, r in item.terms if t in block.asked]
    rest = np.append(np.cumsum([block.most[t] * r for t, r in reversed(here)])[::-1], 0).tolist() if here else [0]
    open_, made = rest[0] >= max(1, least), 0
    if not open_:
        return np.zeros(0, np.int64), 0
    for (t, r), left in zip(here, rest[1:], strict=True):
        lo, hi = block.starts[t], block.starts[t + 1]
        docs, gives = block.postings[lo:hi], block.gives[lo:hi]
        if open_:
            made += 1
            has[docs] = True
            sums[docs] += gives * r
            open_ = left >= least and np.count_nonzero(sums > left) < k
        else:
            mine = has[docs]
            sums[docs[mine]] += gives[mine] * r
    return np.flatnonzero(has), made


def search_block(block: Block, items: list[Item], best: dict[int, tuple], k: int) -> None:
    """Brings the best of each item, (scores, no_id, ids), up to date."""
    sums, has = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), bool)
    for item in items:
        known = best.get(item.key)
        docs, _ = accumulate(block, item, k, int(known[0][-1]) if known and len(known[0]) == k else 0, sums, has)
        docs_with = docs[sums[docs] > 0]
        if len(docs_with):
            new = (sums[docs_with], block.no_id[docs_with], block.ids[docs_with])
            both = tuple(map(np.concatenate, zip(known, new, strict=True))) if known else new
            top = best_of(*both, k)
            best[item.key] = tuple(x[top] for x in both)
        sums[docs], has[docs] = 0, False


def scored(blocks: DataFrame, items: list[Item], weight: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(key, item_id, doc_id, score) of the k best documents of each item in each task."""
    shared = blocks.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c)).slice(i, 1).flatten() for c in ("ids", "sizes", "asked", "df", "postings", "tf")}
                search_block(weighted(row, weight, documents, terms), items, best, k)
        ids = {item.key: item.item_id for item in items}
        for key, (scores, no_id, docs) in best.items():
            n = len(scores)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([ids[key]] * n, pa.int64()), pa.array(docs, pa.int64(), mask=no_id), pa.array(scores, pa.int64())], ["key", "item_id", "doc_id", "score"])

    return blocks.select("ids", "sizes", "asked", "df", "postings", "tf").mapInArrow(run, "key long, item_id long, doc_id long, score long")


# --- jobs -------------------------------------------------------------------------------------------


def search_part(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """The rows of a part of the items, each (key, item_id, text); None if no document holds any of their terms."""
    counts = [(r.key, r.item_id, Counter(terms_of(r.text or ""))) for r in asked]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*(c for *_, c in counts))), 1)}
    blocks = stored(index(docs, numbers))
    size = blocks.agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    df = np.zeros(len(numbers) + 1, np.int64)
    for r in blocks.select(F.explode(F.arrays_zip("asked", "df")).alias("p")).groupBy("p.asked").agg(F.sum("p.df").alias("df")).collect():  # a row an asked term
        df[r.asked] = r.df
    if not df.any():
        return None
    weight = np.array([math.floor(1000 * math.log((2 * size.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = [Item(key, item_id, sorted(((numbers[t], r) for t, r in c.items() if df[numbers[t]]), key=lambda x: (df[x[0]], x[0]))) for key, item_id, c in counts]
    found = scored(blocks, [i for i in items if i.terms], weight, size.documents, size.terms, k).withColumn("group", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "group").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("key"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    parts = -(-total // item_terms)
    if parts > 1:
        rows = stored(rows)
    mine = F.pmod(F.xxhash64("key"), F.lit(max(1, parts)))
    found = [search_part(docs, rows.where(mine == p).collect(), k) for p in range(parts)]  # about item_terms terms each
    found = [x for x in found if x is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
