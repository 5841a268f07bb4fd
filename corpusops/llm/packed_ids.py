"""Token ids in fixed-width bit-packed files, written and read by Spark.

A file holds consecutive documents in ascending doc_id order as a sequence of blocks. A block is one
line of JSON (`first` and `docs`, the numbers of the first document and of the documents in it, `bits`,
`ids`, and the byte length `bytes` of what follows), then the doc_ids and the numbers of ids as
little-endian 64-bit integers, the ids in `bits` bits each (most significant bit first), and a line
feed. `bits` is the least that holds every id of the vocabulary. `block_offsets` lists the blocks, so any
of them is unpacked alone, by numpy and without a loop over ids.

Files are written by Spark's own writer in the shared folder and read by its binary reader, so any file
system that Spark reaches will do. Documents are dealt to tasks by ranges of (doc_id, hash of the text), so the
rows of one doc_id may be dealt to several, and a task starts a new file after some blocks. The order of files
is that of the numbers in their names.

Defined results: a null text is empty; an empty document holds the end id alone. Texts of any length are
encoded whole. Null doc_ids come first, documents with the same doc_id follow one another by a hash of their
texts. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from corpusops.llm.common import range_keys, range_of, range_starts, shared_dir, stored, table
from corpusops.llm.token_counts import PLAIN, byte_letters

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words that a worker remembers at most, of those after a space, of others, and of parts of words.
REMEMBERED = 500_000
NO_ID = -(2**63)


# --- encoding ---------------------------------------------------------------------------------------


class Odd(Exception):
    """A space stands before white space or at the end of the text."""


class Words(dict):
    """Ids of words, found when first asked for. Of the words in use two generations are remembered, of at
    most half of REMEMBERED each; a word of over 64 characters hardly returns and is not."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.find(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    A text is cut at each single space that a character other than white space follows: a match of the
    byte-level pattern takes such a space only as its first character. The ids of a word, the space before it
    included, are remembered. For a new word of plain characters (see PLAIN) the matches of the pattern are
    found here, and the library's model gives the ids of each match; other words go through the whole
    library, and a text that holds a special string goes to it uncut."""

    cut = re.compile(r" (?=\S)")
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, width: str = "<u4"):
        self.library, self.width = Tokenizer.from_file(path), np.dtype(width)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern, self.letters = regex.compile(public_tokenizers.PATTERN), byte_letters()
        raw = np.arange(self.library.get_vocab_size(), dtype=self.width).tobytes()
        self.bytes_of = [raw[i : i + self.width.itemsize] for i in range(0, len(raw), self.width.itemsize)]
        self.after = Words(self.word_after_space)
        self.first = Words(functools.partial(self.word, ""))
        self.parts = Words(self.part)

    def part(self, part: str) -> bytes:
        """Ids of one match of the pattern."""
        if part.isascii() and part.isalpha():  # these letters stand for themselves
            return self.of_letters(part)
        return self.of_letters("".join(map(self.letters.__getitem__, part.encode())))

    def of_letters(self, letters: str) -> bytes:
        ids = self.bytes_of
        return b"".join([ids[t.id] for t in self.library.model.tokenize(letters)])

    def word_after_space(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.of_letters(self.letters[32] + word)
        if not word or word[0].isspace():
            raise Odd
        return self.word(" ", word)

    def word(self, before: str, word: str) -> bytes:
        """Ids of a word and of what stands before it: a space or, at the start of a text or line, nothing."""
        if PLAIN.search(word):
            return self.array(self.library.encode([before + word], is_pretokenized=True, add_special_tokens=False).ids)
        if word.isalpha():
            return self.part(before + word)
        known = self.after if before else self.first
        body = word.rstrip(self.signs)
        if body.isalpha() and body is not word:  # the signs at the end are one match
            return known[body] + self.parts[word[len(body) :]]
        lines = word.split("\n")
        if len(lines) > 1 and word.split() == lines:  # a line feed between other characters is a match of its own
            return known[lines[0]] + b"".join([self.parts["\n"] + self.first[x] for x in lines[1:]])
        return b"".join(map(self.parts.__getitem__, self.pattern.findall(before + word)))

    def array(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def whole(self, text: str) -> bytes:
        return self.array(self.library.encode(text, add_special_tokens=False).ids)

    def cut_up(self, first: str, *words: str) -> bytes:
        return b"".join((self.first[first], *map(self.after.__getitem__, words)))

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.cut_up(*text.split(" "))
        except Odd:  # such spaces stay with the word before
            return self.cut_up(*self.cut.split(text))

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """The ids of each text, the end id added, as little-endian integers."""
        end = self.array([end_id])
        return [self.ids(t) + end for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str, width: str) -> Encoder:
    return Encoder(path, width)


# --- packing ----------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, most significant bit first, zero bits up to a whole byte at the end."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, count: int, bits: int, start: int = 0) -> np.ndarray:
    """ids start .. start + count of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    lo, hi = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, hi - lo, lo))[start * bits - lo * 8 :][: count * bits]
    return flat.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def block(first: int, doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    body = np.array(doc_ids, "<i8").tobytes() + np.array([len(x) for x in ids], "<i8").tobytes() + pack(np.concatenate(ids), bits)
    head = {"first": first, "docs": len(doc_ids), "bits": bits, "ids": sum(map(len, ids)), "bytes": len(body)}
    return json.dumps(head).encode() + b"\n" + body


def block_offsets(data: bytes) -> list[tuple[int, dict]]:
    """(offset of the body, header) of each block of a file; bodies are skipped by their length."""
    out, at = [], 0
    while at < len(data):
        line = data.index(b"\n", at)
        head = json.loads(data[at:line])
        out.append((line + 1, head))
        at = line + 1 + head["bytes"] + 1
    return out


def read_block(data: bytes, body: int, head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, ids."""
    n = head["docs"]
    doc_ids, sizes = np.frombuffer(data, "<i8", n, body), np.frombuffer(data, "<i8", n, body + 8 * n)
    return doc_ids, sizes, unpack(data[body + 16 * n : body + head["bytes"]], head["ids"], head["bits"])


# --- jobs -------------------------------------------------------------------------------------------


def write_packed(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 0, ranges: int | None = None, block_ids: int = 65_536, file_blocks: int = 256) -> None:
    """Encodes docs and writes the files to path. Texts are encoded where they are read; only packed ids
    are shuffled, once, to the range of their document. A file ends after file_blocks blocks."""
    lib_size = Tokenizer.from_file(vocabulary).get_vocab_size()
    bits = bits_for(max(lib_size, end_id + 1))
    width = "<u2" if bits <= 16 else "<u4"
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text")
    starts = range_starts(texts, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                to = range_of(starts, range_keys(part.column(0), part.column(1)))
                packed = enc.encode([t or "" for t in part.column(2).to_pylist()], end_id)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column(0), part.column(1), pa.array(packed, pa.binary())], ["file", "id", "print", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, doc_ids, ids = 0, 0, [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block(first, doc_ids, ids, bits)], pa.binary())], ["value"])
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw.as_buffer(), width))
                held += len(ids[-1])
                if held >= block_ids:
                    yield out()
                    first, held, doc_ids, ids = first + len(doc_ids), 0, [], []
        if doc_ids:
            yield out()

    dealt = texts.mapInArrow(run, "file int, id long, print long, ids binary").repartitionById(ranges, F.col("file"))
    blocks = dealt.sortWithinPartitions("id", "print", "ids").select("id", "ids").mapInArrow(write, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)


def file_number(path: Column) -> Column:
    """A number in the order of files: that of the task, then that of the file among the task's. Spark's names hold both, with leading
    zeros to five and three digits and without from there on."""
    at = lambda group: F.regexp_extract(path, r"part-(\d+)-.*-c(\d+)[^/]*$", group).cast("long")
    return at(1) * (1 << 31) + at(2)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of path; start counts the ids
    of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, start = content.as_buffer().to_pybytes(), 0
                for body, head in block_offsets(data):
                    doc_ids, sizes, ids = read_block(data, body, head)
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes), pa.int64()), pa.array(doc_ids), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["file", "doc_id", "local", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    files = spark.read.format("binaryFile").load(path)
    rows = stored(files.select(file_number(F.col("path")).alias("file"), "content").mapInArrow(run, "file long, doc_id long, local long, n_tokens long, ids_crc32 long"))
    # one row per file
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return rows.join(sizes, "file").select(doc_id, (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_packed(table(spark, sf_dir, "documents"), path)
    return read_packed(spark, path)
