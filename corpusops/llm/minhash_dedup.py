"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set holds its distinct shingles of five words (see `shingles`); two documents are linked if
100 * |intersection| >= 75 * |union|, and a component is what links connect. Steps:

1. Every text becomes a set print (128 bits), a set size and a MinHash signature of BANDS * ROWS values.
   Documents of one print are one vertex, so exact copies cost nothing further.
2. Vertices that agree on all values of a band share a bucket. In each bucket all members are paired
   with its smallest member only.
3. Pairs are verified batch by batch of their signatures: a pair goes as soon as the posterior
   probability that its similarity reaches the threshold, given a uniform prior, is below `miss`. What
   survives is confirmed on the full sets.
4. Components of the confirmed links are found by alternating large-star and small-star steps.
5. In buckets whose members (the smallest apart) are still in several components, the members outside
   the bucket's main component are compared with all members of other components, signatures against
   signatures, SIDE against SIDE at a time, and the surviving pairs are confirmed. So no pair of a bucket is
   left out, but only pairs that may still join two components are ever looked at.

Vertices are dealt to chunks by hash. What is to be verified travels as (vertex, chunk, partners in the
chunk), so a pivot of a million partners is sent once per chunk and pairs are never rows.

A pair of similarity 0.75 shares no bucket with probability (1 - 0.75 ** ROWS) ** BANDS = 2e-5.

Defined results: texts of any length are read whole. A null text has no words; documents without words have size 0, are their own
component and kept. Repeated rows are vertices of one print; every row whose doc_id equals the component's
is kept. A null doc_id is never smallest, takes its component's id, and is not kept; a component of null
ids alone has a null id. `keep_one` leaves exactly one row of a component, of null ids and of repeated ids
too. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.llm.common import WORD, discard, fresh, row_print, stored, table

WORDS = 5
BANDS, ROWS = 40, 5
BATCH = 40  # signature values compared at a time
CHUNK = 128  # vertices that a task holds at a time
SIDE = 256  # members of a bucket compared with as many others at a time
SPAN = 64  # chunks whose pairs of one vertex are gathered
#: Words whose hashes a worker remembers at most.
REMEMBERED = 500_000

_U64 = np.uint64
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=_U64) * _U64(2) + _U64(1)
_MUL = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


# --- sets and signatures ----------------------------------------------------------------------------


class WordHash(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of the text in ASCII lower case; fewer
    words are one shingle, no words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, _U64)
    h = np.fromiter(map(_words.__getitem__, words), _U64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), _U64)
    for i in range(min(WORDS, len(h))):
        out = mixed(out) + h[i : i + n] * _PLACE[i]
    return np.unique(mixed(out))


def signature(sets: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS hash functions over the set."""
    low, out = (sets >> _U64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _MUL + _ADD).min(0), out=out)
    return out


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For 0 .. BANDS * ROWS values compared, the fewest matches m with P(similarity >= threshold) >= miss.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m)."""
    out = np.zeros(BANDS * ROWS + 1, int)
    for n in range(len(out)):
        tail = m = 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def possible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of the signatures a and b survive all batches; later batches see survivors only."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), int)
    for at in range(0, BANDS * ROWS, BATCH):
        matches[alive] += (a[alive, at : at + BATCH] == b[alive, at : at + BATCH]).sum(1)
        alive = alive[matches[alive] >= least[min(at + BATCH, BANDS * ROWS)]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


# --- jobs -------------------------------------------------------------------------------------------


def sign(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, locator (what finds the text again), n_shingles, print, sig and more (binary) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sigs = [], [], []
            for text in batch.column(2):
                x = shingles(text.as_py())
                sizes.append(len(x))
                prints.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sigs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), *batch.columns[3:]], ["doc_id", "locator", "n_shingles", "print", "sig", *more])

    return located(docs, *more).mapInArrow(run, "doc_id long, locator long, n_shingles long, print binary, sig binary" + "".join(f", {c} binary" for c in more))


def located(docs: DataFrame, *more: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("locator"), F.col("text").cast("string").alias("text"), *more)


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of (u, v) either has one v or is one: then each v is the root of its component."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not nodes.agg(F.max((F.col("child") + F.col("parent") > 1) & (F.col("child") > 0))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v); root is the component's smallest node. Each round
    hangs all larger neighbours of a node on its smallest one, then all smaller ones, until only stars are left."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that both sides of the join are dealt for it alone and Spark may split the rows of a hot u
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(same_shape(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = small.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        done, edges = edges, stored(pairs.where("u != v").distinct())
        discard(done, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def same_shape(df: DataFrame) -> DataFrame:
    """Joined by sort-merge at every size, so that a small run costs what a large one does by the row."""
    return df.hint("merge")


def sets_of(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(print, chunk, data): the full set of each candidate, from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t.as_py()).tobytes() for t in batch.column(2)]
            same = [xxhash.xxh3_128_digest(r) == p for r, p in zip(rows, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["print", "chunk", "data"]).filter(pa.array(same, pa.bool_()))

    wanted = candidates.select(F.col("locator").alias("at"), "print", "chunk")
    texts = located(docs).select("locator", "text").join(same_shape(wanted), F.col("locator") == F.col("at")).select("print", "chunk", "text")
    return texts.mapInArrow(run, "print binary, chunk int, data binary").dropDuplicates(["print"])


class SignatureTest:
    """Sequential Bayesian verification of one signature against many."""

    def __init__(self, threshold: float, miss: float):
        self.least = least_matches(threshold, miss)

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint32)

    def __call__(self, one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
        return possible(np.broadcast_to(one, (len(many), BANDS * ROWS)), np.stack(many), self.least)


class SetTest:
    """Exact verification of one full set against many."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, _U64)

    def __call__(self, one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
        sizes, flat = np.array([len(x) for x in many]), np.concatenate(many)
        hits = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        both = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * both >= self.percent * (len(one) + sizes - both)


def meet(rows: DataFrame, data: DataFrame, test: SignatureTest | SetTest) -> DataFrame:
    """Of rows (u, chunk, vs) the vs that pass the test with u. data: (print, chunk, data) of all of them.

    A chunk's data comes first in its partition and is held, about CHUNK entries; the rows stream past it. So u
    is sent once per chunk, and not once per pair."""
    us = rows.join(same_shape(data.select(F.col("print").alias("u"), "data")), "u").select("chunk", F.lit(1).alias("kind"), "u", "vs", "data")
    vs = data.select("chunk", F.lit(0).alias("kind"), F.col("print").alias("u"), F.array().cast("array<binary>").alias("vs"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            out = []
            for chunk, kind, u, vs, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if chunk != at:
                    at, held = chunk, {}
                one = test.load(raw.as_py())
                if kind == 0:
                    held[u] = one
                    continue
                passed = test(one, [held[v] for v in vs])
                if passed.any():
                    out.append((u, chunk, [v for v, ok in zip(vs, passed.tolist(), strict=True) if ok]))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.binary()))], ["u", "chunk", "vs"])

    dealt = us.unionByName(vs).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(run, "u binary, chunk int, vs array<binary>")


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.select("u", F.explode("vs").alias("v"))


def across(members: DataFrame, sigs: DataFrame, labels: DataFrame, test: SignatureTest) -> tuple[DataFrame, DataFrame]:
    """Rows (u, chunk, vs) of members (key, band, print, pivot) that share a bucket, are in different
    components and pass the test; and the prints of the buckets looked at."""
    labelled = members.where("print != pivot").join(labels.withColumnRenamed("node", "print"), "print", "left").select("key", "band", "print", F.coalesce("root", "print").alias("label"))
    labelled = stored(labelled)
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = stored(open_.select("key", F.col("main.label").alias("main"), F.ceil(F.col("n") / SIDE).alias("chunks"), F.ceil((F.col("n") - F.col("main.n")) / SIDE).alias("left_chunks")))
    rows = stored(labelled.join(open_, "key").join(sigs, "print"))
    item = F.struct("print", "label", "chunk", F.col("data").alias("sig"))
    dealt = lambda n: F.pmod(F.xxhash64("print"), F.col(n))
    right = rows.groupBy("key", "band", dealt("chunks").alias("part")).agg(F.collect_list(item).alias("right"))
    left = rows.where("label != main").groupBy("key", dealt("left_chunks").alias("left_part")).agg(F.collect_list(item).alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                left, right = left.values, right.values
                sig, sigs = stack(left.field("sig")), stack(right.field("sig"))
                mine, theirs = (np.array(x.field("label").to_pylist(), object) for x in (left, right))
                prints, others, chunk = left.field("print").to_pylist(), right.field("print").to_pylist(), right.field("chunk").to_pylist()
                for i in range(len(prints)):
                    at = np.flatnonzero(theirs != mine[i])
                    at = at[possible(sigs[at], np.broadcast_to(sig[i], (len(at), BANDS * ROWS)), test.least)]
                    # a pair counts in the first band that it shares
                    at = at[(sigs[at] == sig[i]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
                    by: dict[int, list[dict]] = {}
                    for j in at.tolist():
                        by.setdefault(chunk[j] // SPAN, []).append({"chunk": chunk[j], "v": others[j]})
                    out += [(prints[i], span, vs) for span, vs in by.items()]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            item = pa.struct([("chunk", pa.int32()), ("v", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(item))], ["u", "span", "vs"])

    found = left.join(right, "key").select("band", "left", "right").mapInArrow(run, "u binary, span int, vs array<struct<chunk: int, v: binary>>")
    merged = found.groupBy("u", "span").agg(F.flatten(F.collect_list("vs")).alias("vs")).withColumn("chunk", F.explode(F.array_distinct(F.transform("vs", lambda x: x["chunk"]))))
    mine = F.filter("vs", lambda x: x["chunk"] == F.col("chunk"))
    return merged.select("u", "chunk", F.array_distinct(F.transform(mine, lambda x: x["v"])).alias("vs")), rows.select("print").distinct()


def rooted(docs: DataFrame, percent: int, miss: float, *more: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows with their columns more, and (print, first_id, root) of every print: its smallest doc_id
    and its component."""
    bayes, exact = SignatureTest(percent / 100, miss), SetTest(percent)
    signed = stored(sign(docs, *more))
    some = signed.where("n_shingles > 0")
    vertices = stored(some.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min("locator").alias("locator")))
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keyed = some.select("print", "sig", band)
    width = 4 * ROWS
    keyed = keyed.select(F.xxhash64("band", F.substring(F.col("sig"), F.col("band") * width + 1, F.lit(width))).alias("key"), "band", "print")
    mark = F.xxhash64("print")
    shared = stored(keyed.groupBy("key").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo != hi").select("key"))
    members = stored(keyed.join(same_shape(shared), "key").distinct())
    members = stored(members.join(members.groupBy("key").agg(F.min("print").alias("pivot")), "key"))
    candidates = stored(members.select("print").distinct().join(same_shape(vertices.select("print", "locator")), "print"))
    chunks = max(1, -(-candidates.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("print"), F.lit(chunks)).cast("int").alias("chunk")
    candidates = candidates.select("print", "locator", chunk)
    sigs = signed.select("locator", F.col("print").alias("_print"), F.col("sig").alias("data")).join(same_shape(candidates), "locator").where("_print = print").select("print", "chunk", "data")
    sigs = stored(sigs.dropDuplicates(["print"]))
    sets = stored(sets_of(docs, candidates))
    star = members.where("print != pivot").select("pivot", "print", chunk).groupBy(F.col("pivot").alias("u"), "chunk").agg(F.collect_set("print").alias("vs"))
    labels = components(edges_of(meet(stored(meet(star, sigs, bayes)), sets, exact)))
    rows, prints = across(members, sigs, labels, bayes)
    links = edges_of(meet(rows, sets.join(prints, "print", "left_semi"), exact))
    labels = components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
    roots = vertices.select("print", "first_id").join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    return signed, roots


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed, roots = rooted(docs, percent, miss)
    ids = stored(roots.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = stored(roots.join(same_shape(ids), "root").select("print", "component_id"))
    found = signed.select("doc_id", "n_shingles", "print").join(same_shape(classes), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.col("print").isNull())
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """Exactly one row of docs for each component, the one of its smallest doc_id (null after all others; of rows of one id, that
    of the least print of all columns), and every row without words."""
    name = fresh(docs, "_row")
    rows = docs.withColumn(name, row_print(docs))
    signed, roots = rooted(rows, percent, miss, name)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", name)
    best = signed.where("print IS NOT NULL").groupBy("print").agg(F.min(row).alias("row"))
    kept = best.join(same_shape(roots), "print").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row")[name].alias(name))
    wordless = ~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).unionByName(rows.where(wordless)).select(*[f"`{c}`" for c in docs.columns])


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact: two linked sets share a shingle of the first quarter of each, in one order of all shingles (r, f).
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)),
g AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(n - 4, 1)),
p AS (SELECT doc_id, count(*) AS n, bit_xor(md5_number(shingle)) AS print FROM e GROUP BY doc_id),
v AS (SELECT min(doc_id) AS id, print, n FROM p GROUP BY print, n),
r AS (SELECT id, n, shingle, row_number() OVER (PARTITION BY id ORDER BY hash(shingle), shingle) AS place FROM v JOIN e ON doc_id = id),
f AS (SELECT id, n, shingle FROM r WHERE place <= n - (3 * n + 3) // 4 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n + b.n AS n FROM f a JOIN f b USING (shingle) WHERE a.id < b.id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n),
l AS (
  SELECT c.a, c.b FROM c JOIN r x ON x.id = c.a JOIN r y ON y.id = c.b AND y.shingle = x.shingle
  GROUP BY c.a, c.b, c.n HAVING 100 * count(*) >= 75 * (c.n - count(*))),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, seen) AS (SELECT id, id FROM v UNION SELECT reach.id, t.b FROM reach JOIN t ON t.a = reach.seen),
o AS (SELECT v.print, v.n, min(seen) AS component_id FROM reach JOIN v USING (id) GROUP BY v.print, v.n)
SELECT d.doc_id, coalesce(p.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN o ON o.print = p.print AND o.n = p.n
"""
