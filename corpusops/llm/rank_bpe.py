"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts over LONG characters are cut before they reach the library, only where a match of the pattern
surely ends: before white space that follows another character, as a match has white space at its start
only. Pieces are encoded one by one and their ids joined, so memory is bounded by the piece, and the ids are
those of the whole text. A run of white space of over LONG characters, all but its last character if
another character follows, is one match; it goes to the library as such, since the library's search for a
match gives up in runs of a million.

Defined results: a null text is empty; an empty text has no ids and the digests of nothing. Texts of any
length are encoded whole; one of over LONG characters without white space is one piece. One row per row of
the input, repeated rows too. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.llm.common import table

LONG = 65_536
#: What \s stands for in the pattern.
SPACE = r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SAFE = re.compile(rf"(?<!{SPACE})(?={SPACE})")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """The text in pieces of about `long` characters, cut at safe boundaries, and whether each is one match of
    the pattern; what has no safe boundary stays whole."""
    start = 0
    for run in [*long_run(long).finditer(text), None]:
        end = run.start() if run else len(text)
        while end - start > long and (cut := SAFE.search(text, start + long, end)):
            yield text[start : cut.start()], False
            start = cut.start()
        yield text[start:end], False
        if run:
            start = run.end() - (run.end() < len(text))
            yield text[end:start], True


@functools.lru_cache(maxsize=4)
def long_run(long: int) -> re.Pattern:
    return re.compile(f"(?<!{SPACE}){SPACE}{{{long + 1},}}")


def encode(text: str, enc: tiktoken.Encoding, long: int = LONG) -> list[int]:
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for piece, match in pieces(text, long) for i in (enc._encode_single_piece(piece) if match else enc.encode_ordinary(piece))]


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """The raw bytes: ids may stand for parts of characters."""
    return enc.decode_bytes(ids)


def encoded(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(t or "", enc) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(i, enc) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def encoded_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. Digests are taken where the ids are made, so no ids
    leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", enc)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
