"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text is normalised and split as the tokenizer file says; the pre-tokens that a worker has not seen
yet are laid out as one flat array of symbol ids with row offsets. In every step each row finds its
pair of lowest rank and merges all its occurrences from the left, all rows at once, until no row has a
known pair; what is left of a row is its token count. A text's count is the sum over its pre-tokens,
plus one for each special string of the file that it holds.

Defined results: a null text is empty; an empty text has no tokens. One row per row of the input,
repeated rows too. An empty table gives no rows. Only doc_id and text are read. Texts of any length are counted
whole; a single word of a million letters takes a minute, as each step passes over all that is left of it.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from corpusops.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Chunks, and pre-tokens, that a worker remembers at most; beyond it starts anew.
REMEMBERED = 400_000
#: What keeps a text from the short way: characters other than Latin letters and common punctuation, for
#: which Python and the library are known to agree on case, composition, letters and white space.
PLAIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """Merges rows of symbols by the ranks of a tokenizer file of the word-BPE kind."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, (split, _) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.any_special = re.compile("|".join(map(re.escape, self.special)))
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array([m for *_, m in pairs], np.int64)
        self.byte_of = {x: i for i, x in enumerate(letters)}
        self.counts: dict[str, int] = {}  # by chunk
        self.word_counts: dict[str, int] = {}  # by pre-token

    def merged(self, symbols: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Symbols left in each of n rows. symbols: flat, rows: each symbol's row, ascending."""
        out, none = np.zeros(n, np.int64), np.int64(len(self.keys))
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (rows[:-1] == rows[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            sizes = np.diff(np.append(starts, len(rows)))
            ended = best == none
            out[rows[starts[ended]]] = sizes[ended]
            hit = np.append(rank, none) == np.repeat(np.where(ended, -1, best), sizes)
            # Of touching hits in one row (a pair of equal symbols) every second is taken, from the left.
            where = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(where, prepend=-2) > 1)
            where = where[(np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[self.ranks[at[where]]]
            stay = np.repeat(~ended, sizes)
            stay[where + 1] = False
            symbols, rows = symbols[stay], rows[stay]
        return out

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 50_000):
            some = [w.encode() for w in words[lo : lo + 50_000]]
            sizes = np.array([len(w) for w in some], np.int64)
            flat = np.frombuffer(b"".join(some), np.uint8)
            symbols, last = self.inner[flat], np.cumsum(sizes) - 1
            symbols[last] = self.final[flat[last]]
            self.word_counts.update(zip(words[lo : lo + 50_000], self.merged(symbols, np.repeat(np.arange(len(some)), sizes), len(some)).tolist(), strict=True))

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a plain chunk or, by the library's own rules, of any text."""
        if not PLAIN.search(text):
            return self.words.findall(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def chunks(self, text: str) -> tuple[list[str], int]:
        """What the text's pre-tokens are counted by, none of which crosses white space, and the number of
        special strings in it."""
        if "<|" in text and self.any_special.search(text):
            parts = self.any_special.split(text)
            return [c for p in parts for c in self.chunks(p)[0]], len(parts) - 1
        if PLAIN.search(text):
            return [text], 0
        return text.lower().split(), 0

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        if len(self.word_counts) > REMEMBERED:
            self.word_counts.clear()
        split = [self.chunks(t) for t in texts]
        new = {c: self.pretokens(c) for c in set(itertools.chain.from_iterable(c for c, _ in split)).difference(self.counts)}
        self.learn(list(set(itertools.chain.from_iterable(new.values())).difference(self.word_counts)))
        counts, of = self.counts, self.word_counts.__getitem__
        counts.update((c, sum(map(of, words)) if len(words) > 1 else of(words[0]) if words else 0) for c, words in new.items())
        out = [sum(map(counts.__getitem__, chunks)) + n for chunks, n in split]
        for c in new:
            if len(c) > 64:  # a long chunk hardly returns
                del counts[c]
        return out


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(path)
        for batch in batches:
            counts, sizes = [], []
            for lo in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(1).slice(lo, 500).to_pylist()]
                counts += counter.count(texts)
                sizes += [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
