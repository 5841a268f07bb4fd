"""Alignment of two tokenizers by sparse token-byte incidence matrices.

Both tokenizers encode the same bytes, a space and the text. A token-byte matrix has a row per token and a column
per byte of a batch of documents; it is kept in compressed rows (`Csr`), built from the tokens' ends. The product
A.Bt, formed row by row, gives the links between tokens: with all bytes of a token in its row, the tokens
that overlap and by how many bytes (`overlap`); with its last byte alone, those that end together (`ends`). A token-group
matrix has a column per group, what lies between two byte offsets where tokens of both end, and its product
links all tokens of a group (`groups`).

For `link_digests` each document's links are counted by pair of ids where they
are made; the table of documents with their pairs is written once. Two tokens that end together have the shorter
one's bytes at the end of the longer one, so the vocabularies bound the number of pairs (`pair_bound`): up to
BROADCAST_PAIRS the corpus-wide counts are broadcast, otherwise joined by shuffles. They meet the pairs of a document, and a row a
document is summed.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens:
zeros, no links and an empty digest. One row per row of the input, repeated rows too, whose links all count. Texts of any length are
aligned whole. Only doc_id and text are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.llm import rank_bpe
from corpusops.llm.common import stored, table
from corpusops.llm.token_counts import byte_letters
from corpusops.sources.files import spread

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Words that a worker remembers at most; beyond it starts anew.
REMEMBERED = 400_000
BROADCAST_PAIRS = 2_000_000
#: Bytes of text that are aligned at once; a longer text is aligned alone.
BATCH_BYTES = 1_000_000
#: What stands for a space in pieces.
SPACE = "\u2581"


# --- tokenizers -------------------------------------------------------------------------------------


class ByteLevel:
    """Ids of spaces and texts, and the bytes of each id; special strings are plain text.

    The file's merges make ids in ascending order, so an id is its token's rank, and the tiktoken library gives the
    ids that the tokenizers library would; a file for which this doesn't hold is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(set(made)):
            raise ValueError(f"{path}: not a byte-level vocabulary in order of merges")
        byte_of = {x: i for i, x in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(rank_bpe.encode(" " + t, self.encoding), np.int64) for t in texts]


class Pieces:
    """The same of a sentencepiece model, which adds the space itself.

    No piece of it holds a space after another character, so none crosses the place before a run of spaces, and the
    text is encoded in parts that begin there; a model that has such pieces gets whole texts."""

    cut = re.compile("(?<=[^ ])(?= )")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.apart = SPACE in pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The parts of the text, each without the space that the model adds. The space mark is a space to
        the model, so a text that holds it, which can't come back as it is, stays whole."""
        if SPACE in text:
            return [text]
        words = text.split(" ")
        return [p[1:] for p in self.cut.split(" " + text)] if "" in words else words

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.parts(t) for t in texts]
        new = list(set(itertools.chain.from_iterable(split)).difference(self.known))
        self.known.update((w, array.array("I", x).tobytes()) for w, x in zip(new, self.model.encode(new, num_threads=1), strict=True))
        if "" in self.known:  # a space alone: the model adds none to nothing
            self.known[""] = array.array("I", [self.model.piece_to_id(SPACE)]).tobytes()
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32).astype(np.int64) for words in split]
        for word in new:
            if len(word) > 64:  # it hardly returns
                del self.known[word]
        return out


def loaded(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together: one's bytes are the end of the other's."""
    in_a, in_b = Counter(a), Counter(b)
    longer = sum(in_b[t[i:]] for t in a for i in range(len(t)))
    return longer + sum(in_a[t[i:]] for t in b for i in range(1, len(t)))


# --- sparse products --------------------------------------------------------------------------------


class Csr(NamedTuple):
    """A matrix of ones in compressed rows: row i has them in the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        sizes = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.append(0, np.cumsum(sizes)), rows[np.argsort(self.indices, kind="stable")], len(self.indptr) - 1)


def by_bytes(ends: np.ndarray) -> Csr:
    """Token-byte matrix of tokens that follow one another: every byte is in one token's row."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(n), n)


def by_last_byte(ends: np.ndarray) -> Csr:
    """Token-byte matrix with the last byte of each token alone."""
    return Csr(np.arange(len(ends) + 1), ends - 1, int(ends[-1]) if len(ends) else 0)


def by_group(ends: np.ndarray, group_ends: np.ndarray) -> Csr:
    """Token-group matrix."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(group_ends, ends), len(group_ends))


def product(a: Csr, bt: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of A.Bt other than 0. Row i is the sum of the rows of Bt that the columns of
    A's row i name; they are laid end to end and equal columns are added up."""
    of_row, sizes = np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), np.diff(bt.indptr)[a.indices]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.repeat(of_row, sizes) * max(1, bt.columns) + bt.indices[np.repeat(bt.indptr[a.indices], sizes) + inside]
    if np.any(np.diff(key) < 0):
        key = np.sort(key)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // max(1, bt.columns), key[first] % max(1, bt.columns), np.diff(np.append(first, len(key)))


def links(a_ends: np.ndarray, b_ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of linked tokens of A and B, ascending, and their weight: shared bytes for `overlap`, otherwise 1."""
    if kind == "groups":
        both = a_ends[links(a_ends, b_ends, "ends")[0]]
        return product(by_group(a_ends, both), by_group(b_ends, both).transposed())
    incidence = {"overlap": by_bytes, "ends": by_last_byte}[kind]
    return product(incidence(a_ends), incidence(b_ends).transposed())


# --- documents --------------------------------------------------------------------------------------


class Batch(NamedTuple):
    """Tokens of some texts, one text after the other; starts hold where each text's tokens begin, and the end."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


class Flat:
    """The bytes of all ids in one array."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes, self.sizes = np.frombuffer(b"".join(bytes_of), np.uint8), np.array([len(t) for t in bytes_of], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - np.cumsum(sizes, dtype=np.int32) + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.bytes[at].tobytes()


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = loaded(a_path), loaded(b_path)
        self.flat = [Flat(x.bytes_of) for x in (self.a, self.b)]
        self.sizes = [x.sizes.astype(np.int64) for x in self.flat]
        self.n_a, self.n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        # Every token's number with what may follow it in the text form of groups.
        self.forms = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]

    def batch(self, texts: list[str | None]) -> Batch:
        some = [k for k, t in enumerate(texts) if t]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        asked = [texts[k] for k in some]
        given = list(zip(self.a.ids(asked), self.b.ids(asked), strict=True))
        for k, whole, ids in zip(some, self.given_back(asked, given), given, strict=True):
            if whole:
                pairs[k] = ids
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        starts = [np.append(0, np.cumsum([len(p[k]) for p in pairs])).astype(np.int64) for k in (0, 1)]
        return Batch(a, b, *starts, np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))

    def given_back(self, texts: list[str], given: list[tuple[np.ndarray, np.ndarray]]) -> list[bool]:
        """Whether the bytes of both ids of each text, joined, are a space and the text."""
        want = [(" " + t).encode() for t in texts]
        raw = b"".join(want)
        joined = [flat.joined(np.concatenate([ids[k] for ids in given] or [np.zeros(0, np.int64)])) for k, flat in enumerate(self.flat)]
        if len(want) == 1 or all(x == raw for x in joined) and all(int(n[ids[k]].sum()) == len(w) for w, ids in zip(want, given, strict=True) for k, n in enumerate(self.sizes)):
            return [all(x == raw for x in joined)] * len(want)
        return [self.given_back([t], [ids])[0] for t, ids in zip(texts, given, strict=True)]

    def group_texts(self, at: Batch, i: np.ndarray, j: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text, whose groups end with the tokens i of A and j of B."""
        last = np.zeros(len(at.a), bool), np.zeros(len(at.b), bool)
        last[0][i], last[1][j] = True, True
        group = [np.cumsum(x) - x for x in last]  # of each token
        place_a = np.arange(len(at.a)) + np.append(0, j + 1)[group[0]]  # after all of B in earlier groups
        place_b = np.arange(len(at.b)) + (i + 1)[group[1]]  # after all of A up to this group
        form = np.empty(len(at.a) + len(at.b), np.int64)
        form[place_a] = at.a + self.n_a * last[0]
        form[place_b] = 2 * self.n_a + at.b + self.n_b * last[1]
        strings, starts = list(map(self.forms.__getitem__, form.tolist())), (at.a_starts + at.b_starts).tolist()
        return ["".join(strings[lo:hi])[:-1] for lo, hi in zip(starts, starts[1:], strict=False)]

    def rows(self, texts: list[str | None], kind: str) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text. A pair is a * n_b + b."""
        at, n = self.batch(texts), len(texts)
        i, j, _ = links(at.a_ends, at.b_ends, "ends")
        groups = np.searchsorted(i, at.a_starts)  # groups before each text
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in self.group_texts(at, i, j)]
        if kind != "ends":
            i, j, _ = links(at.a_ends, at.b_ends, kind)
        before = np.searchsorted(i, at.a_starts)
        doc = np.repeat(np.arange(n), np.diff(before))
        keys, times = np.unique(doc * (self.n_a * self.n_b) + at.a[i] * self.n_b + at.b[j], return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * (self.n_a * self.n_b)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys % (self.n_a * self.n_b), times.astype(np.int64))]
        return [*(pa.array(np.diff(x), pa.int64()) for x in (at.a_starts, at.b_starts, groups, before)), pa.array(digests, pa.string()), *lists]


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES bytes."""
    sizes = np.cumsum(texts.cast(pa.large_binary()).fill_null(b"").value_lengths().to_numpy()) if hasattr(texts, "value_lengths") else np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.binary())])
    lo = 0
    while lo < len(texts):
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + BATCH_BYTES)))
        yield lo, hi
        lo = hi


def aligned(docs: DataFrame, kind: str = "ends", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<long> (a id * size of B's vocabulary + b id) and times array<long>,
    how many links of the document each pair has. kind: `ends`, `overlap` or `groups`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), *both.rows(part.column(1).to_pylist(), kind)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def link_digests(docs: DataFrame, kind: str = "ends", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    a, b = loaded(a_path), loaded(b_path)
    rows = stored(aligned(docs, kind, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = rows.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")).select(*own, "p.pairs", "p.times")
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("p.pairs").agg(F.sum("p.times").alias("count"))
    to = F.col("pairs") % len(b.bytes_of)
    most = counts.groupBy(to.alias("to")).agg(F.max("count").alias("most"))
    # A row an id of B at most, a row a pair of ids at most.
    known = counts.withColumn("to", to).join(F.broadcast(most) if len(b.bytes_of) <= BROADCAST_PAIRS else most, "to").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    few = kind == "ends" and pair_bound(a.bytes_of, b.bytes_of) <= BROADCAST_PAIRS
    met = each.join(F.broadcast(known) if few else known, "pairs", "left")
    sums = [F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("count")), F.lit(0)).alias("count_sum")]
    return met.groupBy(*own).agg(*sums).drop("row")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_digests(spread(table(spark, sf_dir, "documents")))  # one file may be one task
