"""Re-ranking of the first passages by a pluggable scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusops.functions.text import STOPWORDS, tokenize


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of the question's distinct tokens that the passage has; the built-in scorer."""
    asked = F.array_distinct(tokenize(question))
    return F.round(F.size(F.array_intersect(asked, tokenize(passage))) / F.greatest(F.lit(1), F.size(asked)), 6)


#: Models that this worker has loaded, by name.
_models: dict[str, Callable[[list[str], list[str]], list[float]]] = {}


def loaded(name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[list[str], list[str]], list[float]]:
    """A worker finds this function, and with it the models, in its own module."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def batch_scorer(name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for `rerank` of a model that takes batches: load() gives a function of questions and passages to scores. A worker loads
    it once, under the name; the pairs of all questions come to it in Arrow batches, as the tasks hold them."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for asked, passages in batches:
            yield pd.Series(model(asked.tolist(), passages.tolist()), dtype="float64")

    return score


class OverlapModel:
    """overlap_score for batches: tokens of a question that repeats are made once."""

    def __init__(self):
        self.stop = frozenset(STOPWORDS)

    def tokens(self, text: str | None) -> frozenset[str]:
        return frozenset(t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) > 1 and t not in self.stop)

    def __call__(self, questions: list[str], passages: list[str]) -> list[float]:
        asked = {q: self.tokens(q) for q in set(questions)}
        return [round(len(asked[q] & self.tokens(p)) / max(1, len(asked[q])), 6) for q, p in zip(questions, passages, strict=True)]


def rerank(ranked: DataFrame, scorer: Callable[[Column, Column], Column], most: int = 20, chars: int = 800) -> DataFrame:
    """ranked: (query_id, rank, question, passage, ...). The first `most` are ordered by the scorer (a column
    expression, or a pandas UDF, of question and passage start); the others follow in their old order."""
    head = ranked.where(F.col("rank") <= most).withColumn("rerank_score", scorer(F.col("question"), F.substring("passage", 1, chars)))
    tail = ranked.where(F.col("rank") > most).withColumn("rerank_score", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return head.unionByName(tail).withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")
