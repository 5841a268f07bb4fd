"""Exact duplicate removal by a tree-merge of digest runs (native DataFrame operations only).

Every input partition first reduces its rows to one entry per digest: its run, ordered by digest in the
sort-based aggregate, the only one that Spark has for struct minima. Rounds then merge `fan_in` neighbouring
runs at a time (16 of them are four binomial rounds in one exchange) until one is left, and each merge keeps
the best entry (most code points, then smallest doc_id) and the row count of every digest. Entries are of one
digest only if length and a second hash agree too, at every level. The outcome goes back the same way:
from the last merge to the runs, and from a run to its rows. A digest that fills a third of the table is
therefore cut down inside its own partitions, and no task meets its rows of more than one of them.

Defined results: a null text counts as empty, and all empty texts form one group. Texts of any length are
read whole. In `exact_dedup`, rows that repeat the doc_id of the row that stays are kept with it; `keep_one`
leaves exactly one row of a group. A null doc_id sorts after every other id and is matched null-safely. Other
columns are never read, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusops.llm.common import fresh, row_print, stored, table


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in (" ", "\n", "\t", "\r", "\x0b", "\f"):
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digest_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more, run, chars, and what identifies the normalised text: its SHA-256 and, to verify that,
    its byte length and a second hash."""
    text = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"), normalised(F.col("text")).alias("norm"))
    return text.select(
        "doc_id",
        *more,
        F.spark_partition_id().alias("run"),
        F.length("text").cast("long").alias("chars"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("norm_bytes"),
        F.xxhash64("norm").alias("check"),
    )


SAME = ["digest", "norm_bytes", "check"]


def tree_merge(rows: DataFrame, fan_in: int = 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per text: SAME, keep_id, the columns of ties (which decide among rows of one id) and
    group_size. Each level merges fan_in runs into one."""
    best = F.struct((-F.col("chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *ties)
    left = rows.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    runs = rows.groupBy(*SAME, "run").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    while left > 1:
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy(*SAME, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        left = -(-left // fan_in)
    return runs.select(*SAME, F.col("best.doc_id").alias("keep_id"), *[F.col(f"best.{t}").alias(t) for t in ties], F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    rows = stored(digest_rows(docs))
    outcome = rows.select(*SAME, "run").distinct().join(tree_merge(rows, fan_in), SAME)
    return rows.join(outcome, [*SAME, "run"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of docs for each group of equal texts, whether ids are null or repeated; among rows of one
    id that tie, that of the least print of all columns."""
    row = fresh(docs, "_row")
    rows = docs.withColumn(row, row_print(docs))
    kept = tree_merge(stored(digest_rows(rows, row)), ties=(row,)).select(row)
    return rows.join(kept, row, "left_semi").dropDuplicates([row]).select(*[rows[f"`{c}`"] for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
