"""Queries on conversations, feedback and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusops.functions import rules as C
from corpusops.operators import conversations as M, feedback as B, limits as R
from corpusops.plans.registry import query, read

NOW = "2024-01-28 12:00:00"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


# --- conversations --------------------------------------------------------------------------------------

PAIRED = "SELECT conv_id // 2 AS conv_id, (conv_id % 2) * 1000 + turn AS turn, role, text FROM conversations"


@query("merge_adjacent_roles", f"""WITH c AS ({PAIRED}), s AS (SELECT *, coalesce((role <> lag(role) OVER w)::INT, 0) AS fresh FROM c WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM s), m AS (SELECT conv_id, island, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY ALL)
  SELECT conv_id, island, role, md5(text) AS text FROM m UNION ALL SELECT conv_id, -1, 'user', md5('Hello') FROM m WHERE island = 0 AND role <> 'user'""")
def _(spark, sf):
    """Two conversations are read as one, so that equal roles meet."""
    paired = turns(spark, sf).select(F.floor(F.col("conv_id") / 2).alias("conv_id"), (F.col("conv_id") % 2 * 1000 + F.col("turn")).alias("turn"), "role", "text")
    return M.merge_adjacent_roles(paired).select("conv_id", F.col("island").cast("long").alias("island"), "role", F.md5("text").alias("text"))


@query("recent_messages", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def _(spark, sf):
    return M.recent(turns(spark, sf), 3).select("conv_id", "turn", "place")


@query("history_window", "SELECT conv_id, turn, md5(coalesce(string_agg(upper(role[1]) || role[2:] || ': ' || left(text, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '')) AS history FROM conversations")
def _(spark, sf):
    return M.history(turns(spark, sf)).select("conv_id", "turn", F.md5("history").alias("history"))


OWNED = "WITH c AS (SELECT conv_id % 20 AS user_id, conv_id, left(min_by(text, turn), 50) AS title, max(turn) AS updated FROM conversations GROUP BY conv_id)"


@query("conversation_list", OWNED + """, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, conv_id) AS INT) AS place FROM c WHERE user_id < 15 QUALIFY place <= 3)
  SELECT user_id, k.conv_id, title, updated, place, count(*) AS n_messages FROM k JOIN conversations USING (conv_id) GROUP BY ALL""")
def _(spark, sf):
    """Conversations belong to the users of their number by 20, of whom those from 15 on are not asked for."""
    rows = turns(spark, sf)
    own = rows.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 50).alias("title"), F.max("turn").alias("updated")).withColumn("user_id", F.col("conv_id") % 20)
    return M.listing(own, rows, F.col("user_id") < 15, 3)


@query("session_summary", "SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, left(max_by(text, turn), 100) AS preview FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return M.summary(turns(spark, sf))


@query("carry_state", """WITH s AS (SELECT *, CASE WHEN contains(text, 'zz') THEN '' WHEN role = 'user' THEN text END AS q, CASE WHEN contains(text, 'zz') THEN '' WHEN role = 'assistant' THEN text END AS c, CASE WHEN role = 'assistant' AND contains(text, '?') THEN text WHEN role = 'user' THEN '' END AS p FROM conversations),
  h AS (SELECT conv_id, turn, nullif(last_value(q IGNORE NULLS) OVER w, '') AS q, nullif(last_value(c IGNORE NULLS) OVER w, '') AS c, nullif(last_value(p IGNORE NULLS) OVER w, '') AS p, coalesce(lag(role = 'assistant' AND contains(text, '?')) OVER (PARTITION BY conv_id ORDER BY turn), false) AS asked FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT conv_id, turn, md5(q) AS last_query, md5(c) AS recent_context, md5(p) AS pending, asked FROM h""")
def _(spark, sf):
    """The last question, the last answer, and a question of the assistant's that the user has not answered; "zz" clears
    the first two."""
    text, cleared = F.col("text"), F.when(F.col("text").contains("zz"), "")
    puts = (F.col("role") == "assistant") & text.contains("?")
    out = turns(spark, sf).withColumn("asked", F.coalesce(F.lag(puts).over(M.in_order()), F.lit(False)))
    out = M.carry(out, "last_query", F.coalesce(cleared, F.when(F.col("role") == "user", text)))
    out = M.carry(out, "recent_context", F.coalesce(cleared, F.when(F.col("role") == "assistant", text)))
    out = M.carry(out, "pending", F.when(puts, text).when(F.col("role") == "user", ""))
    return out.select("conv_id", "turn", *[F.md5(c).alias(c) for c in ("last_query", "recent_context", "pending")], "asked")


@query("apply_ttl", f"SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 5 DAYS) AND event_type = 'purchase'")
def _(spark, sf):
    return M.live(events(spark, sf).where("event_type = 'purchase'"), "user_id", "ts", now(), 5).select("event_id", "user_id")


@query("touch_and_title", "SELECT conv_id, CASE WHEN t IS NULL THEN 'New Chat' WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title, updated FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS t, max(turn) AS updated FROM conversations GROUP BY conv_id)")
def _(spark, sf):
    return M.titles(turns(spark, sf))


@query("delete_cascade", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(text, 'zu'))")
def _(spark, sf):
    rows = turns(spark, sf)
    return M.without(rows, rows.where(F.col("text").contains("zu")), "conv_id").select("conv_id", "turn")


@query("combine_clarification", """WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'research' ELSE text END AS text FROM conversations WHERE role = 'user'), l AS (SELECT *, lower(trim(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))) AS v FROM u)
  SELECT conv_id, turn, CASE WHEN v = 'research' THEN text || ' ' || v ELSE text END AS combined FROM l""")
def _(spark, sf):
    text = F.when(F.col("turn") % 4 == 1, "research").otherwise(F.col("text"))
    return M.combine_clarification(turns(spark, sf).withColumn("text", text), ["research", "courses"], ["professors"]).select("conv_id", "turn", "combined")


# --- feedback -------------------------------------------------------------------------------------------

RATED = "WITH f AS (SELECT event_id, user_id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'up' ELSE 'down' END AS rating, 'user ' || user_id AS query, props AS response, value FROM events WHERE event_type IN ('purchase', 'error'))"


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are up, errors down."""
    rows = events(spark, sf).where("event_type IN ('purchase', 'error')")
    return rows.select("event_id", "user_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("rating"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"), F.col("props").alias("response"), "value")


TEXTS = "WITH f AS (SELECT d.doc_id, left(text, 40) AS query, text AS response, text AS comment, source, CASE quality WHEN 1 THEN 'up' ELSE 'down' END AS rating FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def judged_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", F.substring("text", 1, 40).alias("query"), F.col("text").alias("response"), F.col("text").alias("comment"), "source", F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"))


@query("prepare_feedback", "SELECT event_id, left(props, 20) AS props, left(sha256(user_id || ':' || event_type), 16) AS user_hash, left(sha256(event_type), 16) AS ip_hash FROM events")
def _(spark, sf):
    rows = events(spark, sf).select("event_id", "props", F.col("user_id").alias("session"), F.col("event_type").alias("ip"))
    return B.prepare(rows, {"props": 20}).select("event_id", "props", "user_hash", "ip_hash")


@query("feedback_stats", RATED + f" SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating <> 'up') AS down, round(100.0 * count(*) FILTER (rating = 'up') / count(*), 1)::DOUBLE AS approval, count(*) FILTER (created_at::DATE = DATE '2024-01-28') AS today, count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS last_7_days FROM f")
def _(spark, sf):
    return B.stats(rated(spark, sf), now())


@query("top_negative", RATED + " SELECT query, count(*) AS n, min(event_id) AS first, left(min_by(response, event_id), 200) AS example FROM f WHERE rating = 'down' GROUP BY query ORDER BY n DESC, first LIMIT 10")
def _(spark, sf):
    return B.top_negative(rated(spark, sf), "event_id")


@query("daily_series", RATED + ", d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-28', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, count(rating) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down FROM d LEFT JOIN f ON created_at::DATE = day GROUP BY day")
def _(spark, sf):
    return B.daily_series(rated(spark, sf), now()).withColumn("day", F.col("day").cast("string"))


@query("export_newest", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def _(spark, sf):
    """The newest rows: an export with a limit."""
    return read(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "event_type")


@query("preference_pairs", RATED + " SELECT query, max_by(response, event_id) FILTER (rating = 'up') AS chosen, max_by(response, event_id) FILTER (rating = 'down') AS rejected FROM f GROUP BY query HAVING chosen IS NOT NULL AND rejected IS NOT NULL")
def _(spark, sf):
    return B.preference_pairs(rated(spark, sf), "event_id")


@query("preference_pairs_newest", RATED + ", n AS (SELECT * FROM f ORDER BY event_id DESC LIMIT 5000) SELECT query, max_by(response, event_id) FILTER (rating = 'up') AS chosen, max_by(response, event_id) FILTER (rating = 'down') AS rejected FROM n GROUP BY query HAVING chosen IS NOT NULL AND rejected IS NOT NULL")
def _(spark, sf):
    """Of the newest 5000 ratings, as the report is defined."""
    return B.preference_pairs(rated(spark, sf), "event_id", 5000)


@query("approval_by_type", RATED + f""", k AS (SELECT *, CASE WHEN contains(query, '7') THEN 'sevens' WHEN contains(query, '3') OR contains(query, '5') THEN 'odd' ELSE 'general' END AS type FROM f WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AND created_at <= TIMESTAMP '{NOW}' ORDER BY created_at DESC, event_id LIMIT 500),
  r AS (SELECT *, row_number() OVER (PARTITION BY type, rating ORDER BY event_id) AS n FROM k)
  SELECT type, count(*) AS n, round(100.0 * count(*) FILTER (rating = 'up') / count(*), 1)::DOUBLE AS approval, coalesce(string_agg(query, '|' ORDER BY event_id) FILTER (rating = 'down' AND n <= 3), '') AS examples FROM r GROUP BY type HAVING count(*) >= 3 AND approval < 70""")
def _(spark, sf):
    """Problem types among the newest 500 ratings of 30 days."""
    recent = B.newest(rated(spark, sf), "created_at", "event_id", now())
    return B.approval_by_type(recent, C.first_keyword_type(F.col("query"), {"sevens": ["7"], "odd": ["3", "5"]}), "event_id")


FAMILIES = {"wrong": ("tion|ung", "check facts"), "short": ("zz", "say more"), "old": ("erha", "use new data"), "off": ("the|der", "stay on the topic"), "unclear": ("[?]{3}|qqq", "say it plainly")}


@query("lessons", TEXTS + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) FILTER (regexp_matches(lower(comment), '{p}')) AS n, '{t}' AS lesson FROM f WHERE rating = 'down'" for f, (p, t) in FAMILIES.items()) + ") SELECT * FROM c WHERE n >= 2")
def _(spark, sf):
    return B.lessons(judged_texts(spark, sf), FAMILIES)


@query("length_lesson", TEXTS + ", m AS (SELECT round(avg(length(response)) FILTER (rating = 'up'), 6) AS up_mean, round(avg(length(response)) FILTER (rating = 'down'), 6) AS down_mean FROM f) SELECT *, CASE WHEN down_mean / up_mean > 1.5 THEN 'shorter' WHEN down_mean / up_mean < 0.5 THEN 'longer' ELSE 'none' END AS lesson FROM m")
def _(spark, sf):
    return B.length_lesson(judged_texts(spark, sf))


@query("success_patterns", TEXTS + ", m AS (SELECT round(avg(regexp_matches(response, '[0-9]')::INT), 6) AS digits, round(avg(regexp_matches(response, 'The|Der')::INT), 6) AS cues, round(avg(length(response)), 6) AS mean_length FROM f WHERE rating = 'up') SELECT *, array_to_string(list_filter([CASE WHEN digits > 0.7 THEN 'digits' END, CASE WHEN cues > 0.5 THEN 'cues' END, CASE WHEN mean_length > 100 AND mean_length < 500 THEN 'concise' END], lambda x: x IS NOT NULL), ',') AS patterns FROM m")
def _(spark, sf):
    return B.success_patterns(judged_texts(spark, sf), "The|Der")


@query("overall_approval", TEXTS + " SELECT count(*) AS n, round(100.0 * count(*) FILTER (rating = 'up') / count(*), 1)::DOUBLE AS approval FROM f")
def _(spark, sf):
    return B.overall_approval(judged_texts(spark, sf))


@query("optimizer_stats", TEXTS + ", c AS (" + " UNION ALL ".join(f"SELECT count(*) FILTER (regexp_matches(lower(comment), '{p}')) AS n FROM f WHERE rating = 'down'" for p, _ in FAMILIES.values()) + """),
  t AS (SELECT CASE WHEN contains(lower(response), 'tion') THEN 'english' WHEN contains(lower(response), 'ung') THEN 'german' ELSE 'general' END AS type, count(*) AS n, 100.0 * count(*) FILTER (rating = 'up') / count(*) AS approval FROM f GROUP BY 1),
  u AS (SELECT avg(regexp_matches(response, '[0-9]')::INT) AS digits, avg(regexp_matches(response, 'The|Der')::INT) AS cues, avg(length(response)) AS mean_length FROM f WHERE rating = 'up')
  SELECT (SELECT count(*) FROM f) AS n, (SELECT round(100.0 * count(*) FILTER (rating = 'up') / count(*), 1)::DOUBLE FROM f) AS approval, (SELECT count(*) FROM c WHERE n >= 2) AS n_lessons, (SELECT count(*) FROM t WHERE n >= 3 AND approval < 70) AS n_problems,
    CAST((digits > 0.7)::INT + (cues > 0.5)::INT + (mean_length > 100 AND mean_length < 500)::INT AS BIGINT) AS n_patterns FROM u""")
def _(spark, sf):
    rows = judged_texts(spark, sf)
    problems = B.approval_by_type(rows, C.first_keyword_type(F.col("response"), {"english": ["tion"], "german": ["ung"]}), "doc_id")
    return B.optimizer_stats(rows, B.lessons(rows, FAMILIES), problems, B.success_patterns(rows, "The|Der"))


TYPED = "CASE WHEN contains(lower({0}), 'tion') THEN 'english' WHEN contains(lower({0}), 'ung') THEN 'german' ELSE 'general' END"


@query("similar_failure", f"""WITH f AS (SELECT {TYPED.format('text')} AS type, doc_id AS failure_no, text AS query, CASE WHEN doc_id % 3 > 0 THEN 'bad ' || doc_id END AS comment FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
  w AS (SELECT type, failure_no, query AS example, comment, unnest(string_split(lower(query), ' ')[1:3]) AS word FROM f WHERE comment IS NOT NULL), q AS (SELECT item_id AS query_id, {TYPED.format('text')} AS type, lower(text) AS text FROM benchmark)
  SELECT query_id, md5(min_by(example, failure_no)) AS example, min_by(comment, failure_no) AS comment FROM q JOIN w ON q.type = w.type AND contains(q.text, word) WHERE word <> '' GROUP BY query_id""")
def _(spark, sf):
    """Bad documents are the failures, of which every third has no comment."""
    kind = lambda c: C.first_keyword_type(F.col(c), {"english": ["tion"], "german": ["ung"]})
    bad = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").where("quality = 0")
    failures = bad.select(kind("text").alias("type"), F.col("doc_id").alias("failure_no"), F.col("text").alias("query"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("bad "), F.col("doc_id").cast("string"))).alias("comment"))
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", kind("text").alias("type"))
    return B.similar_failure(asked, failures).select("query_id", F.md5("example").alias("example"), "comment")


@query("annotate_prompt", "SELECT conv_id, turn, 'Be helpful.' || chr(10) || 'Lessons: check facts; use new data' || chr(10) || 'Patterns: digits' || CASE WHEN contains(lower(text), 'tion') THEN chr(10) || 'Careful with english' ELSE '' END AS prompt FROM conversations")
def _(spark, sf):
    learnt = spark.range(1).select(F.array(F.lit("check facts"), F.lit("use new data")).alias("lessons"), F.array(F.lit("digits")).alias("patterns"))
    rows = turns(spark, sf).withColumn("type", C.first_keyword_type(F.col("text"), {"english": ["tion"]}))
    return B.annotate(rows, learnt, ["english"], "Be helpful.").select("conv_id", "turn", "prompt")


@query("annotate_learnt", TEXTS + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) FILTER (regexp_matches(lower(comment), '{p}')) AS n, '{t}' AS lesson FROM f WHERE rating = 'down'" for f, (p, t) in FAMILIES.items()) + """),
  l AS (SELECT string_agg(lesson, '; ' ORDER BY n DESC, family) AS lessons FROM c WHERE n >= 2), u AS (SELECT avg(regexp_matches(response, '[0-9]')::INT) AS digits, avg(regexp_matches(response, 'The|Der')::INT) AS cues, avg(length(response)) AS mean_length FROM f WHERE rating = 'up'),
  p AS (SELECT nullif(array_to_string(list_filter([CASE WHEN digits > 0.7 THEN 'digits' END, CASE WHEN cues > 0.5 THEN 'cues' END, CASE WHEN mean_length > 100 AND mean_length < 500 THEN 'concise' END], lambda x: x IS NOT NULL), '; '), '') AS patterns FROM u)
  SELECT conv_id, turn, concat_ws(chr(10), 'Be helpful.', 'Lessons: ' || lessons, 'Patterns: ' || patterns, CASE WHEN contains(lower(text), 'tion') THEN 'Careful with english' END) AS prompt FROM conversations, l, p""")
def _(spark, sf):
    """Prompts with what the ratings have taught."""
    rows = turns(spark, sf).withColumn("type", C.first_keyword_type(F.col("text"), {"english": ["tion"]}))
    return B.annotate(rows, B.learnt(judged_texts(spark, sf), FAMILIES, "The|Der"), ["english"], "Be helpful.").select("conv_id", "turn", "prompt")


# --- limits ---------------------------------------------------------------------------------------------

#: Small limits, so that the events meet them.
FEW = (("hour", 3600, 1), ("day", 86_400, 2), ("week", 604_800, 8))


#: Which requests are let in, decided one after the other: a request joins its key's admitted ones if no window is full.
ADMITTED = """WITH RECURSIVE n AS (SELECT event_id, user_id, value, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  a(user_id, i, event_id, kept, reason) AS (SELECT user_id, 1::BIGINT, event_id, [t], NULL::VARCHAR FROM n WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, CASE WHEN why IS NULL THEN list_append(kept, t) ELSE kept END, why FROM (SELECT n.user_id, n.i, n.event_id, n.t, a.kept, CASE
      """ + " ".join(f"WHEN len(list_filter(a.kept, lambda x: x > n.t - {s * 1_000_000})) >= {m} THEN '{k}'" for k, s, m in FEW) + """ END AS why FROM a JOIN n ON n.user_id = a.user_id AND n.i = a.i + 1))"""


@query("admit", ADMITTED + " SELECT event_id, user_id, reason IS NULL AS allowed, reason FROM a")
def _(spark, sf):
    return R.admit(events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", FEW).select("event_id", "user_id", "allowed", "reason")


@query("offered_load", "SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {s * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS last_{n}" for n, s, _ in FEW) + " FROM events")
def _(spark, sf):
    return R.offered_load(events(spark, sf), "user_id", "ts", FEW).select("event_id", *[f"last_{n}" for n, _, _ in FEW])


@query("budget_gate", ADMITTED + """, c AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN value ELSE 25.0 END AS cost FROM a JOIN n USING (event_id) WHERE reason IS NULL)
  SELECT event_id, round(sum(cost) OVER w, 6) AS spent, round(sum(cost) OVER w, 6) <= 1000 AS within FROM c WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    """Of the requests that are let in, even ones have told their cost, the others are estimated at 25."""
    let_in = R.admit(events(spark, sf).select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", FEW).where("allowed")
    actual = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    return R.budget(let_in, "ts", "event_id", F.coalesce(actual, F.lit(25.0)), 1000.0).select("event_id", "spent", "within")


@query("budget_coupled", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, ts::DATE AS day, CASE WHEN event_id % 2 = 0 THEN value ELSE 25.0 END AS cost, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
  a(i, event_id, held, day, spent, reason) AS (SELECT 0::BIGINT, NULL::BIGINT, []::STRUCT(u BIGINT, t BIGINT)[], NULL::DATE, 0.0::DOUBLE, NULL::VARCHAR
    UNION ALL SELECT i, event_id, CASE WHEN why IS NULL THEN list_append(list_filter(held, lambda x: x.t > t - {max(s for _, s, _ in FEW[:2]) * 1_000_000}), {{u: user_id, t: t}}) ELSE held END, day, CASE WHEN why IS NULL THEN spent + cost ELSE spent END, why
      FROM (SELECT *, CASE {' '.join(f"WHEN len(list_filter(held, lambda x: x.u = user_id AND x.t > t - {s * 1_000_000})) >= {m} THEN '{k}'" for k, s, m in FEW[:2])} WHEN round(spent, 6) >= 1000 THEN 'budget' END AS why
        FROM (SELECT n.i, n.event_id, n.user_id, n.t, n.day, n.cost, a.held, CASE WHEN a.day = n.day THEN a.spent ELSE 0.0 END AS spent FROM a JOIN n ON n.i = a.i + 1)))
  SELECT event_id, reason IS NULL AS allowed, reason FROM a WHERE i > 0""")
def _(spark, sf):
    """One gate over all requests: what the day's budget refuses leaves its key's windows free."""
    actual = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    return R.coupled(events(spark, sf), "user_id", "ts", "event_id", F.coalesce(actual, F.lit(25.0)), 1000.0, FEW[:2]).select("event_id", "allowed", "reason")


@query("remaining", "SELECT user_id, " + ", ".join(f"greatest({m} - count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL {s} SECONDS AND ts <= TIMESTAMP '{NOW}'), 0) AS left_{n}" for n, s, m in FEW) + " FROM events GROUP BY user_id")
def _(spark, sf):
    return R.remaining(events(spark, sf), "user_id", "ts", now(), FEW)


@query("limiter_stats", "SELECT count(*) AS n_requests, round(count(*) * 0.005, 6)::DOUBLE AS spent, round(50 - count(*) * 0.005, 6)::DOUBLE AS \"left\", count(DISTINCT user_id) AS n_keys FROM events WHERE ts::DATE = DATE '2024-01-28'")
def _(spark, sf):
    return R.limiter_stats(events(spark, sf), "user_id", "ts", F.to_date(F.lit("2024-01-28")), 0.005, 50.0)


@query("exempt", "SELECT event_id, user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS exempt FROM events")
def _(spark, sf):
    listed = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    free, counted = R.exempt(events(spark, sf), listed, "user_id")
    flag = lambda df, x: df.select("event_id", "user_id", F.lit(x).alias("exempt"))
    return flag(free, True).unionByName(flag(counted, False))


@query("client_key", "SELECT event_id, left(sha256(CASE WHEN event_id % 3 = 0 THEN 'peer' ELSE 'u' || user_id END), 16) AS key FROM events")
def _(spark, sf):
    forwarded = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(", proxy")))
    return events(spark, sf).select("event_id", R.client_key(forwarded, F.lit("peer")).alias("key"))
