"""Ratings of answers: statistics, worst questions, series, preference pairs and lessons. Rows are
(query, response, rating up or down, comment, created_at)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusops.operators.phrases import occurring


def up() -> Column:
    return F.col("rating") == "up"


def down() -> Column:
    return F.col("rating") == "down"



def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def prepare(rows: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Texts cut to their limits, and hashes in place of session and address."""
    cut = rows.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})
    return cut.withColumns({"user_hash": short_hash(F.col("session").cast("string"), F.col("ip")), "ip_hash": short_hash(F.col("ip"))})


def approval(liked: Column, total: Column) -> Column:
    """Percent to one decimal, 0 without ratings."""
    return F.when(total == 0, 0.0).otherwise(F.round(100.0 * liked / F.nullif(total, F.lit(0)), 1))


def stats(rows: DataFrame, now: Column) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(up()).alias("up"), F.count_if(F.to_date("created_at") == F.to_date(now)).alias("today"), F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"))
    return counts.select("total", "up", (F.col("total") - F.col("up")).alias("down"), approval(F.col("up"), F.col("total")).alias("approval"), "today", "last_7_days")


def top_negative(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The n down-rated questions (by their first 100 characters) with the most ratings; a report of n rows."""
    grouped = rows.where(down()).groupBy(F.substring("query", 1, 100).alias("query")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.substring(F.min_by("response", order), 1, 200).alias("example"))
    return grouped.orderBy(F.desc("n"), "first").limit(n)


def daily_series(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The last calendar days, empty ones too."""
    span = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(now), days - 1), F.to_date(now))).alias("day"))
    counts = rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(up()).alias("up"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return span.join(counts, "day", "left").select("day", zero("total"), zero("up"), (F.coalesce("total", F.lit(0)) - F.coalesce("up", F.lit(0))).alias("down"))


def preference_pairs(rows: DataFrame, order: str, newest: int | None = None, min_votes: int = 1) -> DataFrame:
    """(query, chosen, rejected) of questions with both ratings: the newest response of each kind. newest: only
    so many last ratings are looked at."""
    looked = rows if newest is None else rows.orderBy(F.desc(order)).limit(newest)
    latest = lambda kind: F.max_by(F.when(kind, F.col("response")), F.when(kind, F.col(order)))
    out = looked.groupBy(F.lower(F.trim("query")).alias("query")).agg(latest(up()).alias("chosen"), latest(down()).alias("rejected"), F.count(F.lit(1)).alias("votes"))
    return out.where((F.col("votes") >= min_votes) & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).drop("votes")


def newest(rows: DataFrame, ts: str, tie: str, now: Column, days: int = 30, most: int = 500) -> DataFrame:
    """The newest ratings of the last days, a bounded report on current problems."""
    return rows.where((F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= now)).orderBy(F.desc(ts), tie).limit(most)


def approval_by_type(rows: DataFrame, kind: Column, order: str, least: int = 3, below: float = 70.0) -> DataFrame:
    """Types with enough ratings and an approval under the limit, and three examples in order; what isn't up is down."""
    typed = rows.withColumn("type", kind).withColumn("_n", F.row_number().over(Window.partitionBy("type", up()).orderBy(order)))
    example = F.when(~up() & (F.col("_n") <= 3), F.struct(order, "query"))
    out = typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(up()).alias("up"), F.array_sort(F.collect_list(example)).alias("examples"))
    scored = out.withColumn("approval", approval(F.col("up"), F.col("n"))).where((F.col("n") >= least) & (F.col("approval") < below))
    return scored.select("type", "n", "approval", F.array_join(F.transform("examples", lambda x: x["query"]), "|").alias("examples"))


def overall_approval(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), approval(F.count_if(up()), n).alias("approval"))


def optimizer_stats(rows: DataFrame, lessons_: DataFrame, problems: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: ratings and approval, and how many lessons, problem types and patterns (patterns: a comma-separated
    column of that name) there are."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    listed = patterns.agg(F.coalesce(F.sum(F.size(F.filter(F.split("patterns", ","), lambda x: x != ""))), F.lit(0)).alias("n_patterns"))
    return overall_approval(rows).crossJoin(count(lessons_, "n_lessons")).crossJoin(count(problems, "n_problems")).crossJoin(listed)  # one row each


def lessons(rows: DataFrame, families: Mapping[str, tuple[str, str]], least: int = 2) -> DataFrame:
    """(family, n, lesson): the lesson of each family of phrases that enough negative comments have."""
    counted = rows.where(~up()).agg(*[F.count_if(F.lower("comment").rlike(p)).alias(f) for f, (p, _) in families.items()])
    listed = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("n"), F.lit(text).alias("lesson")) for f, (_, text) in families.items()])
    return counted.select(F.inline(listed)).where(F.col("n") >= least)


def length_lesson(rows: DataFrame) -> DataFrame:
    """Mean lengths of down and up responses, and what their ratio says."""
    means = rows.agg(F.round(F.avg(F.when(up(), F.length("response"))), 6).alias("up_mean"), F.round(F.avg(F.when(~up(), F.length("response"))), 6).alias("down_mean"))
    ratio = F.col("down_mean") / F.nullif(F.col("up_mean"), F.lit(0.0))
    return means.withColumn("lesson", F.when(ratio > 1.5, "shorter").when(ratio < 0.5, "longer").otherwise("none"))


def success_patterns(rows: DataFrame, cue: str) -> DataFrame:
    """Shares of up responses with a digit and with a cue, and their mean length; which of them are patterns."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    out = rows.where(up()).agg(share(F.col("response").rlike("[0-9]")).alias("digits"), share(F.col("response").rlike(cue)).alias("cues"), F.round(F.avg(F.length("response")), 6).alias("mean_length"))
    return out.withColumn("patterns", F.concat_ws(",", F.when(F.col("digits") > 0.7, "digits"), F.when(F.col("cues") > 0.5, "cues"), F.when((F.col("mean_length") > 100) & (F.col("mean_length") < 500), "concise")))


def similar_failure(questions: DataFrame, failures: DataFrame) -> DataFrame:
    """(query_id, example, comment): of the failures of the question's type with a comment, the first of which one of the
    first three words is in the question, as a word or in one. questions: (query_id, type, text); failures: (type,
    failure_no, query, comment)."""
    words = failures.where("comment != ''").select("type", "failure_no", F.col("query").alias("example"), "comment", F.explode(F.array_distinct(F.slice(F.split(F.lower("query"), " "), 1, 3))).alias("word")).where("word != ''")
    asked = questions.select("query_id", "type", F.lower("text").alias("_text"))
    met = occurring(asked, words, "_text", "word", ["query_id", "type"]).join(words, ["type", "word"])
    return met.groupBy("query_id").agg(F.min_by(F.struct("example", "comment"), "failure_no").alias("x")).select("query_id", "x.*")


def learnt(rows: DataFrame, families: Mapping[str, tuple[str, str]], cue: str, least: int = 2) -> DataFrame:
    """One row (lessons, patterns) for `annotate`: what the ratings teach, most frequent lessons first, and what good answers have in common."""
    taught = lessons(rows, families, least).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "family", "lesson"))).alias("l")).select(F.transform("l", lambda x: x["lesson"]).alias("lessons"))  # a row a family
    common = success_patterns(rows, cue).select(F.filter(F.split("patterns", ","), lambda x: x != "").alias("patterns"))
    return taught.crossJoin(F.broadcast(common))  # one row each


def annotate(questions: DataFrame, learnt: DataFrame, problem_types: Sequence[str], base: str) -> DataFrame:
    """Adds the prompt: the base text, at most five lessons, at most three patterns, and a warning for problem types.
    learnt: one row (lessons array, patterns array)."""
    with_ = questions.crossJoin(F.broadcast(learnt))  # one row
    listed = lambda title, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(c, 1, n), "; ")))
    warning = F.when(F.col("type").isin(list(problem_types)), F.concat(F.lit("Careful with "), "type"))
    return with_.withColumn("prompt", F.concat_ws("\n", F.lit(base), listed("Lessons", F.col("lessons"), 5), listed("Patterns", F.col("patterns"), 3), warning))
