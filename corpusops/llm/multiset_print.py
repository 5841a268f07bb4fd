"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (what line feeds separate, empty ones included). Each paragraph
is hashed to a wide vector: STRONG lanes modulo 2**64 taken from two BLAKE2b digests of the paragraph, and SOFT
lanes modulo 2**16, to which every run of GRAM bytes of the paragraph (the whole paragraph, if shorter) adds
1 or -1 at the lane that its hash names. A fingerprint is the lane by lane sum of its paragraphs' vectors, so the
order of paragraphs does not matter, and `with_edit` inserts or deletes paragraphs without reading the others.
The strong lanes decide equality. The soft lanes of a difference estimate how many runs differ: likeness is
1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0, with a standard error of about sqrt(2 / SOFT) of what differs.

The jobs read a document together with the one that follows in ascending doc_id. Texts are shuffled once, by
ranges of (doc_id, hash of the text) whose ends come from a job on these keys alone, one row a range; the first
document of a range is sent to the range before it as well. Rows of one doc_id are ordered by a hash of
their texts, so they may be dealt to several ranges.

Defined results: a null text is empty; an empty text is one empty paragraph. Null doc_ids come first. One row per
row of the input, repeated rows too; equal rows follow one another. Where there is one row, it follows itself.
A text of one code point has nothing replaced. Texts of any length are read whole. Only doc_id and text
are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.llm.common import range_keys, range_of, range_starts, table

STRONG, SOFT, GRAM = 16, 256, 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]  # odd multipliers


# --- the hash ---------------------------------------------------------------------------------------


class Print:
    """The two lane sums of a multiset of paragraphs."""

    __slots__ = ("strong", "soft")

    def __init__(self, strong: np.ndarray, soft: np.ndarray):
        self.strong, self.soft = strong, soft

    def __add__(self, other: Print) -> Print:
        return Print(self.strong + other.strong, self.soft + other.soft)  # unsigned: modulo 2**64 and 2**16

    def __sub__(self, other: Print) -> Print:
        return Print(self.strong - other.strong, self.soft - other.soft)

    def hex(self) -> str:
        return self.strong.astype("<u8").tobytes().hex() + self.soft.astype("<u2").tobytes().hex()

    @staticmethod
    def from_hex(text: str) -> Print:
        raw = bytes.fromhex(text)
        return Print(np.frombuffer(raw, "<u8", STRONG), np.frombuffer(raw, "<u2", SOFT, 8 * STRONG))


def print_of(paragraphs: Iterable[str]) -> Print:
    """The fingerprint of a multiset of paragraphs."""
    parts = [p.encode() for p in paragraphs]
    firsts = [hashlib.blake2b(p).digest() for p in parts]
    digests = b"".join([x for d in firsts for x in (d, hashlib.blake2b(d).digest())])
    strong = np.frombuffer(digests, "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
    short = [np.frombuffer(d, "<u8", 1) for p, d in zip(parts, firsts, strict=True) if 0 < len(p) < GRAM]
    hashes = [*short, *[gram_hashes(p) for p in parts if len(p) >= GRAM]]
    soft = np.zeros(SOFT, np.int64)
    if hashes:
        h = np.concatenate(hashes)
        signed = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * SOFT)  # lane and, in the lowest bit, sign
        soft = signed[0::2] - signed[1::2]
    return Print(strong, soft.astype(np.uint16))


def gram_hashes(paragraph: bytes) -> np.ndarray:
    """A 64-bit hash of every run of GRAM bytes."""
    h = np.ndarray((len(paragraph) - GRAM + 1,), "<u8", paragraph, 0, (1,)) * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h


def paragraphs(text: str) -> list[str]:
    return text.split("\n")


def with_edit(before: Print, removed: Iterable[str] = (), added: Iterable[str] = ()) -> Print:
    """The fingerprint after some paragraphs are taken out and others put in."""
    removed, added = list(removed), list(added)
    after = before - print_of(removed) if removed else before
    return after + print_of(added) if added else after


def likeness(a: Print, b: Print) -> float:
    """1 for equal fingerprints, about 0 for texts that share nothing."""
    if np.array_equal(a.strong, b.strong) and np.array_equal(a.soft, b.soft):
        return 1.0
    square = lambda lanes: float(np.square(lanes.astype(np.int16).astype(np.float64)).sum())
    both = square(a.soft) + square(b.soft)
    return min(1.0, max(0.0, 1 - square(a.soft - b.soft) / both)) if both else 0.0


def half_replaced(text: str, after: str) -> tuple[str, list[str], list[str]]:
    """The text whose last floor(n / 2) code points give way to the first as many of `after`, and the paragraphs
    that this removes and adds."""
    n = len(text)
    kept, lost, new = text[: n - n // 2], text[n - n // 2 :], after[: n // 2]
    head = kept[kept.rfind("\n") + 1 :]  # the start of the paragraph that the cut is in
    return kept + new, paragraphs(head + lost), paragraphs(head + new)


# --- jobs -------------------------------------------------------------------------------------------


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part int, head boolean, id long, print long, text string), a partition of which holds whole parts in
    ascending order; each part ends with the first row of the next part, marked as head (the last one with the
    first row of all), so that every other row is followed by the row after it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(rows, ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = range_keys(batch.column(0), batch.column(1))
            part = range_of(starts, keys)
            first = np.flatnonzero(starts[part] == keys)
            for at, to, head in ((batch, part, False), (batch.take(pa.array(first)), (part[first] - 1) % len(starts), True)):
                if at.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([head] * at.num_rows), *at.columns], ["part", "head", "id", "print", "text"])

    dealt = rows.mapInArrow(deal, "part int, head boolean, id long, print long, text string")
    return dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "head", "id", "print")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, []  # part, id, text and fingerprint of the row before; rows to return
        for batch in batches:
            for part, head, doc_id, text in zip(*(batch.column(i) for i in (0, 1, 2, 4)), strict=True):
                part, head, doc_id, text = part.as_py(), head.as_py(), doc_id.as_py(), text.as_py()
                if head and (last is None or last[0] != part):
                    continue  # a copy of a head that has met its predecessor
                own = last[3] if last and last[2] == text else print_of(paragraphs(text))
                if last and last[0] == part:
                    _, id_before, before, its = last
                    edited, removed, added = half_replaced(before, text)
                    after = with_edit(its, removed, added)
                    done.append((id_before, len(before), hashlib.sha256(edited.encode()).hexdigest(), its.hex(), after.hex(), likeness(its, after), likeness(its, own)))
                last = None if head else (part, doc_id, text, own)
                if len(done) >= 500:
                    yield as_batch(done)
                    done = []
        if done:
            yield as_batch(done)

    return with_next(docs, ranges).mapInArrow(run, COLUMNS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in COLUMNS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def op11_multiset_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
