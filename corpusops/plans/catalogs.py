"""Queries on catalogue lookups; parts, suppliers and nations stand for courses, people and departments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.functions import text as T
from corpusops.operators import catalog as L, ranking as R
from corpusops.plans.registry import query, read


def part(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part")


def type_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand with a size class is asked as text."""
    return part(spark, sf).groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"), F.min("p_type").alias("p_type")).select("query_id", F.concat_ws(" ", "p_type", "p_brand").alias("text"))


ASK = "WITH q AS (SELECT min(p_partkey) AS query_id, min(p_type) || ' ' || p_brand AS text FROM part GROUP BY p_brand), t AS (SELECT DISTINCT query_id, unnest(string_split(lower(text), ' ')) AS term FROM q)"


@query("match_any_term", ASK + """, m AS (SELECT DISTINCT query_id, p_partkey FROM t JOIN part ON contains(lower(p_name || ' ' || p_type), term)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY query_id) AS n_found FROM m) SELECT query_id, p_partkey, CAST(rank AS INT) AS rank, n_found FROM r WHERE rank <= 20""")
def _(spark, sf):
    return L.match_any_term(type_questions(spark, sf), part(spark, sf), "p_partkey", ["p_name", "p_type"], 20).select("query_id", "p_partkey", "rank", "n_found")


@query("match_tokens_min_len", ASK + """, m AS (SELECT DISTINCT query_id, p_partkey FROM t JOIN part ON contains(lower(p_name || ' ' || p_brand), term) WHERE length(term) >= 7),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY query_id) AS n_found FROM m) SELECT query_id, p_partkey, CAST(rank AS INT) AS rank, n_found FROM r WHERE rank <= 10""")
def _(spark, sf):
    return L.match_any_term(type_questions(spark, sf), part(spark, sf), "p_partkey", ["p_name", "p_brand"], 10, least=7).select("query_id", "p_partkey", "rank", "n_found")


@query("match_all_terms", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') AND contains(lower(p_name), 'a') AND p_size < 25")
def _(spark, sf):
    return L.match_all_terms(part(spark, sf), "p_name", ["e", "a"], F.col("p_size") < 25).select("p_partkey", "p_name")


def sql_points(field: str, weight: int) -> str:
    return f"(CASE WHEN contains(lower({field}), term) THEN {weight} + CASE WHEN regexp_matches(lower({field}), '\\b' || regexp_escape(term) || '\\b') THEN {weight // 2} ELSE 0 END ELSE 0 END)"


#: Parts as courses: the code is of the brand's number, the size the credits, and even keys are graduate courses.
COURSES = "c AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, 'BR ' || (100 + TRY_CAST(replace(p_brand, 'Brand#', '') AS INT)) AS code, CASE WHEN p_partkey % 2 = 0 THEN 'graduate' ELSE 'undergraduate' END AS level FROM part)"


def courses(spark: SparkSession, sf: str) -> DataFrame:
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int")
    level = F.when(F.col("p_partkey") % 2 == 0, "graduate").otherwise("undergraduate")
    return part(spark, sf).withColumns({"code": F.concat(F.lit("BR "), (number + 100).cast("string")), "level": level})


#: A question for each brand: its least type and name, a number of credits, and for some a level.
PUT = "SELECT min(p_partkey) AS query_id, min(p_type) || ' ' || p_brand || ' ' || min(p_size) || CASE min(p_partkey) % 4 WHEN 0 THEN ' grad courses' WHEN 1 THEN ' undergraduate' WHEN 2 THEN ' graduate' ELSE '' END AS text FROM part GROUP BY p_brand"


def put(spark: SparkSession, sf: str) -> DataFrame:
    rows = part(spark, sf).groupBy("p_brand").agg(F.min("p_partkey").alias("query_id"), F.min("p_type").alias("t"), F.min("p_size").alias("s"))
    level = F.element_at(F.array(*map(F.lit, [" grad courses", " undergraduate", " graduate", ""])), (F.col("query_id") % 4 + 1).cast("int"))
    return rows.select("query_id", F.concat(F.concat_ws(" ", "t", "p_brand", F.col("s").cast("string")), level).alias("text"))


def sql_scored(q: str = "q", k: int = 15) -> str:
    """Tables t, s and r: the scored search of questions q."""
    fields = " + ".join(sql_points(f, w) for f, w in FIELDS.items())
    return f"""t AS (SELECT query_id, text, unnest(string_split(lower(text), ' ')) AS term FROM {q}),
  s AS (SELECT query_id, p_partkey, CAST(sum({fields} + CASE WHEN regexp_matches(term, '^[0-9]+$') AND term = p_size::VARCHAR THEN 5 ELSE 0 END)
      + max(CASE WHEN level = 'undergraduate' THEN 5 * contains(lower(text), 'undergraduate')::INT + 5 * contains(lower(text), 'undergrad')::INT ELSE 5 * contains(lower(text), 'graduate')::INT + 5 * contains(lower(text), 'grad ')::INT END) AS BIGINT) AS score FROM t, c WHERE term <> '' GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})"""


FIELDS = {"p_name": 8, "p_brand": 6, "p_type": 4}


@query("field_weighted_score", f"WITH {COURSES}, q AS ({PUT}), {sql_scored()} SELECT query_id, p_partkey, score, rank FROM r")
def _(spark, sf):
    found = L.field_weighted_score(put(spark, sf), courses(spark, sf), "p_partkey", FIELDS, 15, "p_size", "level")
    return found.select("query_id", "p_partkey", "score", "rank")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the code of their brand's number, as "BRAND 12"."""
    return part(spark, sf).withColumn("code", F.concat_ws(" ", F.lit("BRAND"), F.regexp_extract("p_brand", "([0-9]+)", 1)))


@query("lookup_code", "WITH q AS (SELECT DISTINCT p_size AS query_id FROM part), c AS (SELECT regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n, max(p_partkey) AS p_partkey FROM part GROUP BY 1) SELECT query_id, p_partkey FROM q JOIN c ON n = query_id")
def _(spark, sf):
    asked = part(spark, sf).select(F.col("p_size").alias("query_id")).distinct().withColumn("text", F.concat(F.lit("what is brand"), F.col("query_id").cast("string"), F.lit(" like?")))
    return L.lookup_code(asked, coded(spark, sf), "code", "p_partkey").select("query_id", "p_partkey")


@query("lookup_group", "SELECT p_brand, p_type, p_partkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rank FROM part) WHERE rank <= 5")
def _(spark, sf):
    return L.lookup_group(part(spark, sf), ["p_brand", "p_type"], "p_partkey", 5).select("p_brand", "p_type", "p_partkey", "rank")


#: Codes that exist and don't, subjects, scored questions, and texts that only the question as it was put answers.
MIXED = """SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'br ' || (100 + query_id % 60) WHEN 1 THEN CASE WHEN query_id % 2 = 0 THEN 'BR' ELSE 'ZZ' END WHEN 2 THEN 'zzzz qqqq' ELSE text END AS text, text AS original FROM q"""


@query("search_catalog", f"""WITH {COURSES}, q AS ({PUT}), m AS ({MIXED}), k AS (SELECT code, max(p_partkey) AS p_partkey FROM c GROUP BY code),
  a AS (SELECT query_id, p_partkey, 1 AS rank, 0 AS stage FROM m JOIN k ON upper(text) = code AND regexp_matches(text, '^[A-Za-z]+ [0-9]+$')),
  b AS (SELECT query_id, p_partkey, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS INT) AS rank, 1 AS stage FROM m JOIN c ON upper(text) = 'BR' WHERE code IS NOT NULL QUALIFY rank <= 5),
  m1 AS (SELECT query_id, text FROM m), m2 AS (SELECT query_id, original AS text FROM m WHERE lower(text) <> lower(original)),
  x AS (WITH {sql_scored('m1', 5)} SELECT query_id, p_partkey, rank, 2 AS stage FROM r), y AS (WITH {sql_scored('m2', 5)} SELECT query_id, p_partkey, rank, 3 AS stage FROM r),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y)
  SELECT query_id, p_partkey, rank, stage FROM u QUALIFY stage = min(stage) OVER (PARTITION BY query_id)""")
def _(spark, sf):
    """By code, by subject, by score, and by score of the question as it was put."""
    text = F.expr("CASE query_id % 5 WHEN 0 THEN concat('br ', 100 + query_id % 60) WHEN 1 THEN CASE WHEN query_id % 2 = 0 THEN 'BR' ELSE 'ZZ' END WHEN 2 THEN 'zzzz qqqq' ELSE text END")
    asked = put(spark, sf).select("query_id", text.alias("text"), F.col("text").alias("original"))
    rows = courses(spark, sf).withColumn("subject", F.when(F.col("code").isNotNull(), "BR"))
    return L.search_catalog(asked, rows, "p_partkey", "code", "subject", FIELDS, 5, "p_size", "level").select("query_id", "p_partkey", "rank", "stage")


#: Parts as programs; each name has as alias its words with dashes.
PROGRAMS = """p AS (SELECT p_partkey, lower(p_name || ' ' || p_partkey % 50) AS name, CASE p_size % 4 WHEN 0 THEN 'bachelors' WHEN 1 THEN 'masters' WHEN 2 THEN 'doctoral' ELSE 'certificate' END AS level, lower(p_type || ' ' || p_brand) AS outcomes FROM part)"""
WANTED = """q AS (SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || p_partkey % 50 WHEN 1 THEN replace(p_name, ' ', '-') || '-' || p_partkey % 50 WHEN 2 THEN p_name WHEN 3 THEN 'a phd or ' || p_name || '?' ELSE 'MS with ' || p_type || ' outcomes' END AS text FROM part)"""


@query("search_programs", f"""WITH {PROGRAMS}, {WANTED}, w AS (SELECT query_id, lower(text) AS l FROM q), names AS (SELECT name, max(p_partkey) AS last, min(p_partkey) AS first FROM p GROUP BY name),
  a AS (SELECT query_id, last AS p_partkey, 1 AS rank, 0 AS stage FROM w JOIN names ON name = l), b AS (SELECT query_id, last AS p_partkey, 1 AS rank, 1 AS stage FROM w JOIN names ON replace(name, ' ', '-') = l),
  d AS (SELECT DISTINCT l FROM w), h AS (SELECT l, min(first) AS p_partkey FROM d JOIN names ON contains(name, l) GROUP BY l), c AS (SELECT query_id, p_partkey, 1 AS rank, 2 AS stage FROM w JOIN h USING (l)),
  o AS (SELECT l FROM d WHERE l NOT IN (SELECT l FROM h) AND l NOT IN (SELECT replace(name, ' ', '-') FROM names)),
  t AS (SELECT l, unnest(regexp_extract_all(l, '[a-z0-9]+')) AS term FROM o), e AS (SELECT DISTINCT name, level, outcomes FROM p),
  f AS (SELECT l, name, level, outcomes, sum(CASE WHEN length(term) >= 3 AND contains(name, term) THEN 5 ELSE 0 END + CASE WHEN length(term) > 3 AND contains(outcomes, term) THEN 1 ELSE 0 END)
      + max(CASE WHEN level = 'masters' AND list_contains(regexp_extract_all(l, '[a-z0-9]+'), 'ms') OR level = 'doctoral' AND list_contains(regexp_extract_all(l, '[a-z0-9]+'), 'phd') THEN 3 ELSE 0 END) AS score FROM t, e GROUP BY ALL),
  g AS (SELECT l, p_partkey, CAST(row_number() OVER (PARTITION BY l ORDER BY score DESC, p_partkey) AS INT) AS rank FROM f JOIN p USING (name, level, outcomes) WHERE score > 0 QUALIFY rank <= 3),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT query_id, p_partkey, rank, 3 FROM w JOIN g USING (l))
  SELECT query_id, p_partkey, rank, stage FROM u QUALIFY stage = min(stage) OVER (PARTITION BY query_id)""")
def _(spark, sf):
    """An exact name, an alias, a part of a name, or points. Each part puts a question."""
    key = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", (key % 50).cast("string"))
    level = F.element_at(F.array(*map(F.lit, ["bachelors", "masters", "doctoral", "certificate"])), F.col("p_size") % 4 + 1)
    programs = part(spark, sf).select("p_partkey", name.alias("name"), level.alias("level"), F.concat_ws(" ", "p_type", "p_brand").alias("outcomes"))
    aliases = programs.select(F.replace("name", F.lit(" "), F.lit("-")).alias("alias"), "name")
    text = F.when(key % 5 == 0, name).when(key % 5 == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(key % 5 == 2, F.col("p_name")).when(key % 5 == 3, F.concat(F.lit("a phd or "), "p_name", F.lit("?"))).otherwise(F.concat(F.lit("MS with "), "p_type", F.lit(" outcomes")))
    asked = part(spark, sf).select(key.alias("query_id"), text.alias("text"))
    levels = {"doctoral": ((), ("phd",)), "masters": ((), ("ms",))}
    subjects = {"steel": (("steel",), ())}
    return L.search_programs(asked, programs, aliases, "p_partkey", 3, levels, subjects).select("query_id", "p_partkey", "rank", "stage")


KEYS = [("economy", "the"), ("economy", "and"), ("promo", "tion"), ("standard", "ing"), ("standard", "erha")]


@query("keyword_length_score", "WITH k(name, keyword) AS (VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in KEYS) + """), s AS (SELECT item_id AS query_id, name, CAST(sum(length(keyword)) AS BIGINT) AS score, max(name = 'promo') AS special FROM benchmark JOIN k ON contains(lower(text), keyword) GROUP BY ALL)
  SELECT query_id, name, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY special DESC, score DESC, name) AS INT) AS rank FROM s QUALIFY rank <= 2""")
def _(spark, sf):
    keys = spark.createDataFrame([(n, k, n == "promo") for n, k in KEYS], "name string, keyword string, special boolean")
    return L.keyword_length_score(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), keys, 2).select("query_id", "name", "score", "rank")


@query("keyword_overview_score", "WITH k(name, keyword) AS (VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in KEYS) + """), o(name, overview) AS (SELECT 'document ' || doc_id, lower(text) FROM documents),
  t AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark), c AS (SELECT query_id, term, count(*) AS n FROM t WHERE length(term) > 4 GROUP BY ALL),
  e AS (SELECT item_id AS query_id, name, length(keyword) AS points, name = 'promo' AS special FROM benchmark JOIN k ON contains(lower(text), keyword) UNION ALL SELECT query_id, name, n, false FROM c JOIN o ON contains(overview, term)),
  s AS (SELECT query_id, name, CAST(sum(points) AS BIGINT) AS score, max(special) AS special FROM e GROUP BY ALL)
  SELECT query_id, name, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY special DESC, score DESC, name) AS INT) AS rank FROM s QUALIFY rank <= 3""")
def _(spark, sf):
    """Points for keywords and for words of an overview; every document is the overview of something."""
    keys = spark.createDataFrame([(n, k, n == "promo") for n, k in KEYS], "name string, keyword string, special boolean")
    overviews = read(spark, sf, "documents").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("overview"))
    return L.keyword_length_score(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), keys, 3, overviews).select("query_id", "name", "score", "rank")


@query("trigger_lookup", """WITH k(no, trigger, target) AS (VALUES (0, 'zz', 'rare'), (1, 'erha', 'office'), (2, 'tion', 'chair'), (3, 'tien', 'office')),
  m AS (SELECT item_id AS query_id, target, min(no) AS no FROM benchmark JOIN k ON contains(lower(text), trigger) GROUP BY ALL), w AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM m)),
  n(no, target) AS (VALUES (0, 'that house'), (1, 'from here')), f AS (SELECT query_id, target, min(no) AS no FROM w JOIN n ON list_contains(string_split(target, ' '), term) GROUP BY ALL),
  u AS (SELECT * FROM m UNION ALL SELECT * FROM f UNION ALL SELECT item_id, 'everyone', 0 FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM m UNION ALL SELECT query_id FROM f))
  SELECT query_id, target, CAST(row_number() OVER (PARTITION BY query_id ORDER BY no, target) AS INT) AS position FROM u""")
def _(spark, sf):
    """Triggers, then words of the targets, then all."""
    triggers = spark.createDataFrame([(0, "zz", "rare"), (1, "erha", "office"), (2, "tion", "chair"), (3, "tien", "office")], "trigger_no int, trigger string, target string")
    named = spark.createDataFrame([(0, "that house"), (1, "from here")], "position int, target string")
    return L.trigger_lookup(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), triggers, "everyone", named)


@query("substring_filter", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'an') OR contains(lower(s_name), '7')")
def _(spark, sf):
    rows = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named, numbered = L.substring_filter(rows, "n_name", "AN"), L.substring_filter(rows, "s_name", "7")
    return named.unionByName(numbered).select("s_suppkey", "s_name", "n_name").distinct()


@query("affinity_rank", "SELECT p_type AS topic, p_partkey, preferred, CAST(row_number() OVER (PARTITION BY p_type ORDER BY preferred DESC, p_partkey) AS INT) AS place FROM (SELECT *, p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2') OR p_type = 'PROMO' AND p_brand = 'Brand#3' AS preferred FROM part)")
def _(spark, sf):
    rows = part(spark, sf).withColumn("topic", F.col("p_type"))
    return L.affinity_rank(rows, F.col("topic"), "p_brand", {"ECONOMY": ["Brand#1", "Brand#2"], "PROMO": ["Brand#3"]}, "p_partkey").select("topic", "p_partkey", "preferred", "place")


@query("search_people", "SELECT s_suppkey, place FROM (SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_suppkey) AS INT) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND contains(s_name, '1')) WHERE place <= 10")
def _(spark, sf):
    """People of a department (region) on a topic, distinct by name, ten at most: a top-k report."""
    rows = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fit = L.match_all_terms(rows, "s_name", ["1"], F.col("r_name") == "ASIA")
    people = R.keep_first(fit, [F.lower("s_name")], [F.asc("s_suppkey")])
    return R.top_k(people, ["r_name"], [F.asc("s_suppkey")], 10, "place").select("s_suppkey", "place")


#: Short and long forms of a topic, and nations that are preferred for topics.
FORMS, AFFINITY = {"th": "erha", "onen": "tien"}, {"erha": ["NATION_14", "NATION_3", "NATION_7"], "onen": ["NATION_5", "NATION_11"]}


def sql_people() -> str:
    forms = {**FORMS, **{v: k for k, v in FORMS.items()}}
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in forms.items())
    liked = " OR ".join(f"'{t}' IN (topic, other) AND n_name IN ({', '.join(map(repr, names))})" for t, names in AFFINITY.items())
    return f"""WITH q AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 4 IN (0, 2) THEN n_name END AS department, CASE n_nationkey % 4 WHEN 1 THEN 'th' WHEN 2 THEN 'onen' END AS topic, n_nationkey % 5 = 1 OR n_nationkey % 4 = 0 AS whole FROM nation),
  t AS (SELECT *, CASE topic {arms} END AS other FROM q), s AS (SELECT s_suppkey, s_name, n_name, lower(coalesce(text, '')) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN documents ON doc_id = s_suppkey),
  f AS (SELECT query_id, whole, s_suppkey, s_name, coalesce({liked}, false) AS preferred FROM t JOIN s ON (department IS NULL OR department = n_name) AND (topic IS NULL OR contains(text, topic) OR contains(text, other)) WHERE department IS NOT NULL OR topic IS NOT NULL),
  d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, lower(s_name) ORDER BY preferred DESC, s_suppkey) = 1)
  SELECT query_id, s_suppkey AS person, preferred, CAST(row_number() OVER (PARTITION BY query_id ORDER BY preferred DESC, s_suppkey) AS INT) AS rank, FROM d QUALIFY rank <= CASE WHEN whole THEN 100 ELSE 10 END"""


@query("search_people_scoped", sql_people())
def _(spark, sf):
    """A question a nation: by department, by topic under either of its forms, by both, or by neither; every fifth wants a complete list."""
    nations, key = read(spark, sf, "nation"), F.col("n_nationkey")
    whole = (key % 5 == 1) | (key % 4 == 0)
    asked = nations.select(key.alias("query_id"), F.when(key % 2 == 0, F.col("n_name")).alias("department"), F.when(key % 4 == 1, "th").when(key % 4 == 2, "onen").alias("topic"), F.when(whole, "complete_list").otherwise("top_results").alias("scope"))
    rows = read(spark, sf, "supplier").join(nations, F.col("s_nationkey") == key).join(read(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id") == F.col("s_suppkey"), "left")
    people = rows.select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), F.col("n_name").alias("department"), F.coalesce("text", F.lit("")).alias("searchable"))
    return L.search_people(asked, people, FORMS, AFFINITY)


@query("retry_prefixed", """WITH t AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'q' || item_id FROM benchmark WHERE item_id % 2 = 1),
  h AS (SELECT DISTINCT item_id, p_partkey, 0 AS stage FROM t JOIN part ON term <> '' AND contains(lower(p_name), term)),
  g AS (SELECT * FROM h UNION ALL SELECT item_id, p_partkey, 1 FROM benchmark, part WHERE contains(lower(p_name), 'plate') AND NOT contains(lower(text), 'plate') AND item_id NOT IN (SELECT item_id FROM h))
  SELECT item_id AS query_id, p_partkey, CAST(row_number() OVER (PARTITION BY item_id ORDER BY p_partkey) AS INT) AS rank, stage FROM g QUALIFY rank <= 3""")
def _(spark, sf):
    """Questions of which no word is in a part's name, as of all odd ones here, are asked again with a prefix that is
    a word of names."""
    odd = F.col("item_id") % 2 == 1
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(odd, F.concat(F.lit("q"), F.col("item_id").cast("string"))).otherwise(F.col("text")).alias("text"))
    return L.retry_prefixed(asked, "plate", lambda q: L.match_any_term(q, part(spark, sf), "p_partkey", ["p_name"], 3).select("query_id", "p_partkey", "rank"))
