"""Queries on streams: the events, written as files that come out of order, folded by key in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusops.plans.activity import FEW, events
from corpusops.plans.registry import query
from corpusops.sources import files as S
from corpusops.streaming import admission as A, ordered as O

#: Batches that the events come in, the least number of files of a batch, rows that a file is given before there are more files, and days
#: that a row may be behind the newest before it.
BATCHES, FILES, ROWS, DELAY = 6, 4, 50_000, 2


def arriving(rows: DataFrame, batch: Column, end: Column) -> DataFrame:
    """The rows as a stream: those of batch 0 come first. Then comes a row without a user that takes time to `end`. Large batches are in
    as many files as there are cores. Each file begins with a row of the oldest time, without a user, so that none is left out
    and a batch is never read with the next one's files."""
    spark, path = rows.sparkSession, S.shared_folder(rows.sparkSession, "stream")
    count, oldest = rows.agg(F.count(F.lit(1)), F.min("ts")).first()
    files = max(FILES, min(count // (BATCHES * ROWS), spark.sparkContext.defaultParallelism))
    first = spark.range(files).select(*[F.lit(oldest if c == "ts" else None).cast(t).alias(c) for c, t in rows.dtypes], F.col("id").cast("int").alias("_file"))
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int"))
    for n in range(BATCHES):
        first.unionByName(dealt.where(batch == n)).repartitionById(files, "_file").drop("_file").write.mode("append").parquet(f"{path}/in")
    last = rows.agg(*[end.alias(c) if c == "ts" else F.first(F.when(F.lit(False), F.col(c))).alias(c) for c in rows.columns])
    last.write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def outcome(out: DataFrame) -> DataFrame:
    path = S.shared_folder(out.sparkSession, "stream")
    O.to_files(out, f"{path}/out", f"{path}/state").awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


#: A day's number modulo 30 in five stretches; a third of the rows come a batch late, a batch being at most six days.
STRETCH = "least((dayofyear(ts) - 1) % 30 // 6, 4)"
ON_TIME = f"{STRETCH} + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"


def stretch() -> Column:
    return F.least(F.floor((F.dayofyear("ts") - 1) % 30 / 6), F.lit(4)).cast("int")


def end(days: int) -> Column:
    """When the last row has to come for the watermark to be two seconds past the newest event."""
    return F.date_trunc("second", F.max("ts")) + F.expr(f"INTERVAL {days} DAYS 2 SECONDS")


def replay(rows: str) -> str:
    """Decisions on some of the events, one after the other."""
    whens = " ".join(f"WHEN len(list_filter(a.kept, lambda x: x > n.t - {s * 1_000_000})) >= {m} THEN '{k}'" for k, s, m in FEW)
    return f"""n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {rows}),
  a(user_id, i, event_id, kept, reason) AS (SELECT user_id, 1::BIGINT, event_id, [t], NULL::VARCHAR FROM n WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, CASE WHEN why IS NULL THEN list_append(kept, t) ELSE kept END, why FROM (SELECT n.user_id, n.i, n.event_id, n.t, a.kept, CASE {whens} END AS why FROM a JOIN n ON n.user_id = a.user_id AND n.i = a.i + 1))"""


@query("stream_admit", f"WITH RECURSIVE {replay('events')} SELECT event_id, user_id, reason IS NULL AS allowed, reason FROM a")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Files up to two batches out of order, all within the watermark: the decisions are those of the batch form."""
    rows = events(spark, sf).select("event_id", "user_id", "ts")
    stream = arriving(rows, stretch() + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), end(13))
    return outcome(A.stream_admit(stream, "user_id", "ts", "event_id", FEW, "13 days")).select("event_id", "user_id", "allowed", "reason")


@query("stream_admit_late", f"""WITH RECURSIVE f AS (SELECT *, {ON_TIME} AS batch FROM events),
  m AS (SELECT batch, max(epoch_ms(ts)) - {DELAY * 86_400_000} AS mark FROM f GROUP BY batch),
  l AS (SELECT f.*, coalesce(epoch_ms(ts) < (SELECT max(mark) FROM m WHERE m.batch < f.batch), false) AS late FROM f),
  {replay('(SELECT * FROM l WHERE NOT late)')}
  SELECT event_id, false AS late, reason IS NULL AS allowed, reason FROM a UNION ALL SELECT event_id, true, NULL, NULL FROM l WHERE late""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same under a watermark of two days: requests that come later are a table of their own and leave no trace."""
    rows = events(spark, sf).select("event_id", "user_id", "ts")
    stream = arriving(rows, stretch() + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), end(DELAY))
    return outcome(A.stream_admit(stream, "user_id", "ts", "event_id", FEW, f"{DELAY} days")).select("event_id", "late", "allowed", "reason")


PURCHASES = "SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'purchase'"


@query("stream_sessions", f"""WITH p AS ({PURCHASES}), g AS (SELECT *, t - lag(t) OVER w > 2 * 86400000000 AS gap FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  s AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY t, event_id) AS no FROM g)
  SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY user_id, no HAVING max(t) + 2 * 86400000000 < (SELECT max(t) // 1000000 * 1000000 + 2000000 FROM p)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of purchases that have expired, two days after their last write; each write renews its session."""
    rows = events(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    stream = arriving(rows, stretch() + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), end(13))
    return outcome(A.stream_sessions(stream, "user_id", "ts", "event_id", 2 * 86_400, "13 days")).select("user_id", "first", "last", "n")


@query("stream_apply_ttl", f"""WITH p AS ({PURCHASES}) SELECT event_id, user_id FROM p WHERE user_id IN
  (SELECT user_id FROM p GROUP BY user_id HAVING max(t) + 5 * 86400000000 >= (SELECT max(t) // 1000000 * 1000000 + 2000000 FROM p))
  AND t > coalesce((SELECT max(x.t) FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS gap FROM p) x WHERE x.user_id = p.user_id AND x.gap > 5 * 86400000000), -1)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases of sessions that five days without a write have not ended: those after each user's last expiry."""
    rows = events(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    stream = arriving(rows, stretch() + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), end(13))
    ended = outcome(A.stream_sessions(stream, "user_id", "ts", "event_id", 5 * 86_400, "13 days"))
    last = ended.groupBy("user_id").agg(F.max("last").alias("ended"))
    return rows.join(last, "user_id", "left").where("ended IS NULL OR unix_micros(ts) > ended").select("event_id", "user_id")
