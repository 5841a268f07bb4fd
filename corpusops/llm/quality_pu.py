"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training documents labelled good; the unlabelled text is any training document,
its label unseen. With the class prior p, the risk of a scorer g under the logistic loss is

    p * R_pos(g) + max(0, R_unl_as_neg(g) - p * R_pos_as_neg(g)),

where the second part estimates the risk on negatives and is kept from going below zero: a step that
finds it below goes up the gradient of that part alone. p is the share of good ones among the labelled
documents of the training fold, with one positive and one negative added: labels cover documents of all kinds,
so this share is that of the unlabelled text too. Labelled negatives are used for this number only and are
unlabelled text in the fit. The scorer is linear in features of the whole text.

The fit takes at most `positives` labelled and `unlabelled` other rows, the ones with the smallest hash
of their id; beyond these bounds more rows hardly change some hundred weights. Every document is
scored, by its features alone: labels, lang, source and doc_id are not inputs.

Defined results: null and empty texts are scored, as texts without bytes. Texts of any length are scored whole.
Empty tables give no rows. A doc_id labelled more than
once is a positive if any of its labels is 1. Labels that are null, or of no document, are left out.
Repeated rows are scored alike; of a repeated doc_id the least
text is fitted. Without any positive the score is the prior for all. A null doc_id
hashes as an empty string. Only doc_id and text are read, of labels doc_id and quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusops.llm.common import table

CUT = 0.3


# --- features ---------------------------------------------------------------------------------------

#: Classes of bytes whose shares are features: lower, upper, digit, space, line feed, and each ASCII sign.
SIGNS = [i for i in range(33, 127) if not chr(i).isalnum()]
N_FEATURES = 5 + len(SIGNS) + 20


def features(text: str) -> np.ndarray:
    """Shares of byte classes and statistics of words and lines of the whole text."""
    raw = text.encode()
    n = len(raw)
    out = np.zeros(N_FEATURES, np.float32)
    if not n:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    out[:5] = share[97:123].sum(), share[65:91].sum(), share[48:58].sum(), share[32], share[10]
    out[5 : 5 + len(SIGNS)] = np.sqrt(share[SIGNS])
    words = raw.split()
    m = len(words)
    if m:
        kinds = len(set(words))
        twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
        two = len(set(zip(words, words[1:], strict=False)))
        sizes = np.fromiter(map(len, words), np.int64, m)
        signs = np.fromiter((not w[-1:].isalnum() and w[-1] < 128 for w in words), bool, m)
        shout = sum(w.isupper() for w in words)
        lines = [x for x in raw.split(b"\n") if x]
        stops = sum(counts[ord(c)] for c in ".!?")
        stats = [
            kinds / m, two / max(1, m - 1), twice / m, np.log1p(m), np.log(sizes.mean()), sizes.std() / 10, np.log(sizes.max()),
            signs.mean(), shout / m, len(set(lines)) / max(1, len(lines)), np.log(n / max(1, len(lines))), stops / m,
            (share[share > 0] * np.log(share[share > 0])).sum(), counts.max() / n, share[128:].sum(), np.sqrt(twice / m), np.sqrt(shout / m), (m < 5), kinds / np.sqrt(m),
        ]
        out[5 + len(SIGNS) : -1] = stats
    return out


# --- the fit ----------------------------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Scorer:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias)


def step(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """At weights w, positives a and unlabelled rows b: the risk on positives, that on negatives, and the gradient to go
    down: of both or, where the second is below zero, of that one alone, upwards."""
    za, zb = a @ w, b @ w
    # d/dw of the logistic losses: log(1 + e^-z) as a positive, log(1 + e^z) as a negative
    as_pos = -(sigmoid(-za) @ a) / len(a)
    negative = (sigmoid(zb) @ b) / len(b) - prior * (sigmoid(za) @ a) / len(a)
    on_pos, rest = prior * np.logaddexp(0, -za).mean(), np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
    return on_pos, rest, prior * as_pos + negative if rest >= 0 else -negative


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 2e-3, seed: int = 0) -> Scorer:
    """Minimises the non-negative risk by Adam over mini-batches."""
    both = np.concatenate([pos, unl]).astype(np.float64)
    mean, scale = (both.mean(0), both.std(0) + 1e-6) if len(both) else (np.zeros(both.shape[1]), np.ones(both.shape[1]))
    if not len(pos) or not len(unl):
        return Scorer(mean, scale, np.zeros(both.shape[1]), float(np.log(prior / (1 - prior))))
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    kept, total = np.zeros_like(w), 0
    for t in range(1, steps + 1):
        *_, g = step(w, p[rng.integers(0, len(p), 1024)], u[rng.integers(0, len(u), 2048)], prior)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate / np.sqrt(1 + t / 200) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            kept, total = kept + w, total + 1
    w = kept / total
    return Scorer(mean, scale, w[:-1], float(w[-1]))


# --- jobs -------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 16_000) -> Scorer:
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    good, total = known.agg(F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    prior = (good + 1) / (total + 2)
    rows = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = by_hash(known.where("good").select("doc_id").join(rows, "doc_id", "left_semi"), positives).withColumn("set", F.lit(1))
    other = by_hash(rows, unlabelled).withColumn("set", F.lit(0))
    chosen = trusted.unionAll(other).groupBy("doc_id").agg(F.max("set").alias("trusted"), (F.min("set") == 0).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [features(t.as_py() or "").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], ["x", "trusted", "other"])

    # at most positives + unlabelled ids are broadcast, and as many feature vectors come back, one of each id
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    met = met.groupBy("doc_id", "trusted", "other").agg(F.min("text").alias("text")).select("text", "trusted", "other")
    sample = met.mapInArrow(run, "x binary, trusted int, other boolean").toPandas()
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T[::-1])  # rows come in any order; the fit must not depend on it
    x, sample = x[order], sample.iloc[order]
    return fit(x[sample["trusted"].to_numpy() == 1], x[sample["other"].to_numpy(dtype=bool)], prior)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = scorer(np.array([features(t.as_py() or "") for t in batch.column(2)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects, their columns unchanged."""
    scorer = train(docs, labels)
    index = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer(np.array([features(t.as_py() or "") for t in batch.column(index)])) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
