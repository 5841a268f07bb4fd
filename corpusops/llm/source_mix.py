"""Mixing sources to target weights by a low-discrepancy schedule (native DataFrame operations only).

The words of a source, its documents in a shuffled but fixed order, are cut into blocks of equal size.
Slot i of the schedule is the golden-ratio point frac(i * phi); the cumulative target shares map it to
a source. Slots are ranked per source, and the slot of rank r takes block r modulo the source's number
of blocks: the first pass over a source is ranks below that number, the second pass the next ones.

Points and bounds are integers in units of 2 ** -40, so they are the same in every engine and order of
summing, and exact for 2 ** 40 slots. The table of sources, a row each, is ordered in one task; documents,
blocks and slots never are.

Defined results: a null or empty text has size 0 and is never taken. Very long texts are many blocks.
A null source is a source of its own, ordered last. Repeated rows are separate documents. An empty table
gives no rows; a table without words gives targets of 0. Columns other than doc_id, text and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.llm.common import fresh, running, stored, table, word_count

#: 1 / phi in units of 1 / UNIT, and the mask of a half of their bits.
UNIT, GOLDEN, HALF = 2**40, 679_535_556_991, 2**20 - 1


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size): source, no, source_size, target.

    Weights repeat over the sources by code point, null last. `share` times all sizes are shared by
    weight; a source gets at most `cap` times its size and the excess goes to the others by weight.
    With sources in the order of cap / weight the capped ones come first, so one running sum finds the
    level at which the rest are served. The table has one row per source.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "no")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn("no", F.row_number().over(by_name) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("no") % len(weights) + 1))
    most = weighed.withColumn("most", cap * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    open_ = most.withColumn("water", left / rest)
    first = F.min_by(F.when(F.col("level") > F.col("water"), F.col("water")), F.when(F.col("level") > F.col("water"), F.struct("level", "no"))).over(everything)
    return open_.withColumn("served", first).select("source", "no", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("served"), F.col("most"))).cast("double").alias("target"))


def point(slot: Column) -> Column:
    """frac(slot * phi) in units of 1 / UNIT; no product reaches 2 ** 63."""
    low, high = slot.bitwiseAND(HALF), F.shiftright(slot, 20).bitwiseAND(HALF)
    return (low * F.lit(GOLDEN) + F.shiftleft((high * F.lit(GOLDEN)).bitwiseAND(HALF), 20)).bitwiseAND(UNIT - 1)


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, no, rank): the source of each of `slots` golden-ratio points and the point's rank in it.

    sources: (no, target). A point meets its source by way of the cell of [0, 1) that both touch; there
    are at least four cells a source, so the work is a plain equi-join with about one match per point."""
    ordered = Window.orderBy("no")
    share = sources.select("no", F.floor(F.col("target") + 0.5).alias("share"))
    whole = F.sum("share").over(Window.partitionBy()).cast("double")
    bound = lambda to: F.floor(F.coalesce(F.sum("share").over(ordered.rowsBetween(Window.unboundedPreceding, to)), F.lit(0)).cast("double") / whole * F.lit(float(UNIT)))
    bounds = stored(share.select("no", "share", bound(-1).alias("lower"), bound(0).alias("upper")).where("share > 0"))
    bits = 40 - max(12, (4 * bounds.count()).bit_length())  # of a place inside a cell
    touched = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("lower", bits), F.shiftright(F.col("upper") - 1, bits))))
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), point(F.col("id")).alias("x")).withColumn("cell", F.shiftright("x", bits))
    hit = points.join(stored(touched), "cell").where("x >= lower AND x < upper").select("slot", "no", F.floor(F.col("slot") / 4096).alias("stretch"))
    return running(hit, ["no"], "stretch", [F.col("slot")], {"rank": F.lit(1)}).select("slot", "no", "rank")


def source_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs. `block`: words in a block."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"), F.monotonically_increasing_id().alias("row")))
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    count, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    slots = -(-int(share * words) // block)
    parts = max(1, count // 512)
    placed = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.lit(parts) / F.lit(2**32)))
    placed = stored(running(placed, ["no"], "bucket", [F.col("place"), F.col("doc_id"), F.col("size")], {"start": F.col("size")}))
    ranks = schedule(spark, sources, slots).join(sources.select("no", F.ceil(F.col("source_size") / block).alias("blocks")), "no")
    passes = int(cap)
    taken = ranks.where(F.col("rank") < passes * F.col("blocks")).groupBy("no", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("row", "no", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    words_in = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    got = pieces.join(taken, ["no", "block"]).groupBy("row").agg(F.sum(words_in * F.col("times")).alias("taken"))
    return placed.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: a document is there as often as the mix takes its words, to the
    nearest whole number, with the columns of docs. Rows that share a doc_id get the mean of their shares."""
    same, times, copy = (fresh(docs, n) for n in ("_id", "_copies", "_copy"))
    copies = source_mix(docs, **options).groupBy(F.col("doc_id").alias(same)).agg(F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).cast("int").alias(times))
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies[same])).where(copies[times] > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copies[times]))).select(*[docs[f"`{c}`"] for c in docs.columns])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS no
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS level FROM w),
o AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / ((SELECT sum(weight) FROM w)
               - coalesce(sum(weight) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
  FROM l),
t AS (
  SELECT source, no, source_size,
         least(most, coalesce(weight * (SELECT water FROM o WHERE level > water ORDER BY level, no LIMIT 1), most))::DOUBLE AS target
  FROM o),
h AS (SELECT no, CAST(floor(target + 0.5) AS BIGINT) AS share FROM t),
b AS (
  SELECT no, share,
         CAST(floor(coalesce(sum(share) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(share) OVER ())::DOUBLE * 1099511627776.0::DOUBLE) AS BIGINT) AS lower,
         CAST(floor((sum(share) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(share) OVER ())::DOUBLE * 1099511627776.0::DOUBLE) AS BIGINT) AS upper
  FROM h),
x AS (
  SELECT i AS slot, ((i & 1048575) * 679535556991 + ((((i >> 20) & 1048575) * 679535556991) & 1048575) * 1048576) & 1099511627775 AS x
  FROM range(1, (SELECT (CAST(floor(1.5 * sum(size)) AS BIGINT) + 63) // 64 + 1 FROM d)) AS r(i)),
k AS (SELECT no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM x JOIN b ON share > 0 AND x >= lower AND x < upper),
g AS (
  SELECT no, rank % ((source_size + 63) // 64) AS block, count(*) AS times
  FROM k JOIN t USING (no) WHERE rank < 2 * ((source_size + 63) // 64) GROUP BY ALL),
p AS (
  SELECT r, doc_id, size, no, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY no ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r, no, start, start + size AS stop, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 AS BIGINT) + 1)) AS block FROM p WHERE size > 0),
q AS (SELECT r, sum((least(stop, (block + 1) * 64) - greatest(start, block * 64)) * times) AS taken FROM e JOIN g USING (no, block) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN q USING (r)
"""
