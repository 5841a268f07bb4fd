"""Queries on document preparation, relations and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.functions import rules as C, text as T
from corpusops.operators import context as X, documents as D, lexical as L, relations as G
from corpusops.operators.embedding import embed, hashed_tfidf, letter_shares
from corpusops.plans.registry import query, read
from corpusops.plans.retrieval import bm25_sql, documents, questions, standing
from corpusops.sources import html as H
from corpusops.sources.files import stored


def part(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part")


# --- documents ------------------------------------------------------------------------------------------


@query("render_template", "SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Brand: ' || CASE WHEN p_size < 10 THEN 'N/A' ELSE p_brand END || chr(10) || 'Large: ' || CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS text FROM part")
def _(spark, sf):
    fields = [("Name", F.col("p_name"), "N/A"), ("Brand", F.when(F.col("p_size") >= 10, F.col("p_brand")), "N/A"), ("Large", D.yes_no(F.col("p_size") > 25), None)]
    return part(spark, sf).select("p_partkey", D.render_template(fields).alias("text"))


@query("format_hours", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Hours not available' WHEN p_size % 3 = 1 THEN 'Hours vary' ELSE 'mon: ' || p_size || '; wed: 9-5' END AS hours FROM part")
def _(spark, sf):
    some = F.create_map(F.lit("mon"), F.col("p_size").cast("string"), F.lit("tue"), F.lit("Closed"), F.lit("wed"), F.lit("9-5"))
    none = F.create_map(F.lit("mon"), F.lit("Closed"))
    hours = F.when(F.col("p_size") % 3 == 2, some).when(F.col("p_size") % 3 == 1, none)
    return part(spark, sf).select("p_partkey", D.format_hours(hours).alias("hours"))


@query("yes_no", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS large FROM part")
def _(spark, sf):
    return part(spark, sf).select("p_partkey", D.yes_no(F.when(F.col("p_size") != 3, F.col("p_size") > 25)).alias("large"))


@query("first_nonempty", "SELECT conv_id, md5(coalesce(string_agg(text, '; ' ORDER BY turn) FILTER (role = 'system'), string_agg(text, '; ' ORDER BY turn) FILTER (role = 'user'))) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    lists = read(spark, sf, "conversations").groupBy("conv_id").agg(of("system").alias("a"), of("user").alias("b"))
    return lists.select("conv_id", F.md5(D.first_nonempty([F.col("a"), F.col("b")])).alias("text"))


@query("join_pairs", "SELECT l_orderkey, string_agg(l_linenumber || ': ' || l_shipmode2, '; ' ORDER BY l_linenumber, l_shipmode2) AS lines FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode2 FROM lineitem) GROUP BY l_orderkey")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("v"), F.lit(None).cast("string").alias("name")))).alias("items"))
    return rows.select("l_orderkey", D.join_pairs(F.col("items"), ["name", "l_linenumber"], "v").alias("lines"))


@query("split_facets", "SELECT p_partkey, 'size' AS type, 'size ' || p_size AS text FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size % 2 = 0")
def _(spark, sf):
    size = F.col("p_size")
    return D.split_facets(part(spark, sf), ["p_partkey"], [("size", size > 10, F.concat(F.lit("size "), size.cast("string"))), ("brand", size % 2 == 0, F.col("p_brand"))])


@query("chunk_children", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) SELECT p_brand, (rn - 1) // 5 + 1 AS chunk, count(*) AS n, string_agg(p_name, '; ' ORDER BY rn) AS text FROM r GROUP BY ALL")
def _(spark, sf):
    return D.chunk_children(part(spark, sf), "p_brand", "p_partkey", F.col("p_name"))


@query("subset_document", "SELECT p_brand, count(*) AS n, string_agg(p_type, '; ' ORDER BY p_partkey) AS text FROM part WHERE contains(lower(p_type), 'eco') OR contains(lower(p_type), 'pro') GROUP BY p_brand")
def _(spark, sf):
    return D.subset_document(part(spark, sf), "p_brand", "p_type", ["eco", "pro"], "p_partkey")


@query("parent_overview", "SELECT n_name, count(*) AS n, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf):
    return D.parent_overview(read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), "n_name", "s_name")


@query("humanize_key", "SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_brand[1]) || lower(p_brand[2:]) AS name FROM part")
def _(spark, sf):
    return part(spark, sf).select("p_partkey", T.humanize_key(F.concat_ws("_", "p_type", "p_brand")).alias("name"))


@query("slug", "SELECT p_partkey, left(replace(replace(replace(replace(replace(lower(p_name || ', ' || p_type || ' & ' || p_brand), ' ', '_'), ',', ''), '.', ''), '&', 'and'), '/', '_'), 30) AS slug FROM part")
def _(spark, sf):
    name = F.concat("p_name", F.lit(", "), "p_type", F.lit(" & "), "p_brand")
    return part(spark, sf).select("p_partkey", T.slug(name, 30).alias("slug"))


@query("flatten_tree", "SELECT p_partkey, '' AS category, 'p_name' AS item, p_name AS value FROM part UNION ALL SELECT p_partkey, 'kind', 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'inner', 'p_size', p_size::VARCHAR FROM part")
def _(spark, sf):
    rows = part(spark, sf).select("p_partkey", F.struct("p_name", F.struct("p_type", F.struct("p_size").alias("inner")).alias("kind"), F.lit("x").alias("source")).alias("tree"))
    return rows.select("p_partkey", F.inline(F.array(*D.flatten_tree(F.col("tree"), rows.schema["tree"].dataType, ("source",)))))


#: Trees of different depth: objects in objects, lists of objects and of lists, and items that are no container.
TREE = """CASE WHEN event_id % 4 = 0 THEN props
  WHEN event_id % 4 = 1 THEN '{"source": {"k": 1}, "plan": [{"name": "' || event_type || '", "user": ' || user_id || '}, 7, [{"deep": {"id": ' || event_id || ', "none": null}}]], "sizes": [1, 2]}'
  WHEN event_id % 4 = 2 THEN '{"a": {"b": {"c": {"d": [{"e": true, "source": 3}, {"e": ' || user_id || '}]}}}, "top": "' || event_type || '"}' ELSE 'no json' END"""


@query("flatten_json", f"""WITH t AS (SELECT event_id, user_id, event_type, event_id % 4 AS m, props FROM events)
  SELECT event_id, '' AS category, 'k' AS item, props::JSON->>'k' AS value FROM t WHERE m = 0 UNION ALL SELECT event_id, 'plan', 'name', event_type FROM t WHERE m = 1 UNION ALL SELECT event_id, 'plan', 'user', user_id::VARCHAR FROM t WHERE m = 1
  UNION ALL SELECT event_id, 'deep', 'id', event_id::VARCHAR FROM t WHERE m = 1 UNION ALL SELECT event_id, 'deep', 'none', NULL FROM t WHERE m = 1
  UNION ALL SELECT event_id, '', 'top', event_type FROM t WHERE m = 2 UNION ALL SELECT event_id, 'd', 'e', 'true' FROM t WHERE m = 2 UNION ALL SELECT event_id, 'd', 'e', user_id::VARCHAR FROM t WHERE m = 2""")
def _(spark, sf):
    return D.flatten_json(read(spark, sf, "events").select("event_id", F.expr(TREE).alias("tree")), ["event_id"], "tree", ["source"])


@query("searchable_text", "SELECT s_suppkey, s_name || ' ' || s_nationkey AS searchable_text FROM supplier WHERE NOT contains(s_name, '9')")
def _(spark, sf):
    return D.searchable_text(read(spark, sf, "supplier"), "s_name", ["s_name", "s_nationkey"], ["9"]).select("s_suppkey", "searchable_text")


@query("dropped_names", "SELECT CASE WHEN contains(s_name, '9') THEN 'invalid name' ELSE 'no name' END AS reason, count(*) AS n FROM supplier WHERE contains(s_name, '9') OR contains(s_name, '00') GROUP BY 1")
def _(spark, sf):
    """Of names those with 00 are blanked; 9 marks an invalid one."""
    rows = read(spark, sf, "supplier").withColumn("name", F.when(F.col("s_name").contains("00") & ~F.col("s_name").contains("9"), " ").otherwise(F.col("s_name")))
    return D.dropped_names(rows, "name", ["9"])


@query("dropped_on_write", "SELECT count(*) AS seen, count(*) FILTER (contains(s_name, '9')) AS invalid_name, count(*) FILTER (contains(s_name, '00') AND NOT contains(s_name, '9')) AS no_name, count(*) FILTER (NOT contains(s_name, '9') AND NOT contains(s_name, '00')) AS written FROM supplier")
def _(spark, sf):
    """What is dropped, counted by the write of what stays."""
    rows = read(spark, sf, "supplier").withColumn("name", F.when(F.col("s_name").contains("00") & ~F.col("s_name").contains("9"), " ").otherwise(F.col("s_name")))
    kept, counted = D.searchable_text_counted(rows, "name", ["name"], ["9"])
    written = stored(kept, "searchable")
    counts = counted.get
    return written.agg(*[F.lit(counts[n]).alias(n) for n in ("seen", "no_name", "invalid_name")], F.count(F.lit(1)).alias("written"))


@query("text_or_fallback", "SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, 'page ' || page_id) AS text FROM pages")
def _(spark, sf):
    rows = read(spark, sf, "pages").withColumn("a", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("  "))
    return rows.select("page_id", D.text_or_fallback(["a"], F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("text"))


@query("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n[ \n]*\n', E'\n\n', 'g'))) AS clean FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate(F.col("text"), 100).alias("text"))


@query("truncate_at_newline", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(left(text, 400), chr(10)) THEN left(text, 400 - instr(reverse(left(text, 400)), chr(10))) ELSE left(text, 400) END AS text FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate_at_newline(F.col("text"), 400).alias("text"))


@query("map_sections", """WITH m AS (SELECT source, lang, string_agg('- ' || doc_id, chr(10) ORDER BY doc_id) AS items FROM documents GROUP BY ALL)
  SELECT source, md5(string_agg('The ' || upper(lang[1]) || lang[2:] || chr(10) || items, chr(10) ORDER BY lang)) AS text FROM m GROUP BY source""")
def _(spark, sf):
    lists = documents(spark, sf).groupBy("source", "lang").agg(F.array_sort(F.collect_list("doc_id")).cast("array<string>").alias("items"))
    maps = lists.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("the_"), "lang"), "items"))).alias("sections"))
    return maps.select("source", F.md5(D.map_sections(F.col("sections"))).alias("text"))


@query("map_sections_labels", """WITH o AS (SELECT s_nationkey, s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS code FROM supplier)
  SELECT s_nationkey, md5(string_agg('Of ' || lpad(s_suppkey::VARCHAR, 9, '0') || chr(10) || 'Name: ' || s_name || CASE WHEN code <> '' THEN chr(10) || 'Code: ' || code ELSE '' END, chr(10) ORDER BY s_suppkey)) AS text FROM o GROUP BY s_nationkey""")
def _(spark, sf):
    """A nation's suppliers as a map of structs; every third has no code."""
    rows = read(spark, sf, "supplier").withColumn("code", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey").cast("string")).otherwise(""))
    entry = F.struct(F.concat(F.lit("of_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("key"), F.struct("s_name", "code").alias("value"))
    maps = rows.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(entry)).alias("sections"))
    return maps.select("s_nationkey", F.md5(D.map_sections(F.col("sections"), [("s_name", "Name"), ("code", "Code")])).alias("text"))


@query("scalarize_metadata", "SELECT doc_id, 'doc_id=' || doc_id || ';lang=' || lang || ';source=' || CASE WHEN doc_id % 7 = 0 THEN 'None' ELSE source END || ';n_chars=' || n_chars AS metadata FROM documents")
def _(spark, sf):
    rows = documents(spark, sf).withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
    entries = F.map_entries(D.scalarize_metadata(rows, ["text"]))
    return rows.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@query("ensure_unique_ids", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN p_name || '_' || (row_number() OVER (ORDER BY p_partkey) - 1) ELSE p_name END AS unique_id FROM part")
def _(spark, sf):
    return D.ensure_unique_ids(part(spark, sf), "p_name", "p_partkey").select("p_partkey", "unique_id")


# --- relations ------------------------------------------------------------------------------------------

BLOCKS = "SELECT p_partkey, 'CS ' || (100 + p_size) || '. ' || p_name || '. ' || (p_size % 5 + 1) || '-9 Credits. About ' || p_type || ' and more of it. Prerequisite: CS ' || (100 + p_size % 7) || ' and MATH ' || (200 + p_size % 3) || ' or consent. Corequisite: ' || p_brand || '. Satisfies: Goal ' || p_size || '.' AS text FROM part"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_partkey", "p_brand", F.expr("concat('CS ', 100 + p_size, '. ', p_name, '. ', p_size % 5 + 1, '-9 Credits. About ', p_type, ' and more of it. Prerequisite: CS ', 100 + p_size % 7, ' and MATH ', 200 + p_size % 3, ' or consent. Corequisite: ', p_brand, '. Satisfies: Goal ', p_size, '.')").alias("text"))


@query("course_codes", "SELECT p_partkey, 'CS ' || (100 + p_size) || CASE WHEN p_size % 7 <> p_size THEN '|CS ' || (100 + p_size % 7) ELSE '' END || '|MATH ' || (200 + p_size % 3) AS codes FROM part")
def _(spark, sf):
    return blocks(spark, sf).select("p_partkey", F.array_join(G.course_codes(F.col("text")), "|").alias("codes"))


@query("prerequisite_edges", "SELECT 'CS ' || (100 + p_size) AS course_code, 'CS ' || (100 + p_size % 7) AS prereq_code FROM part WHERE p_size % 7 <> p_size UNION ALL SELECT 'CS ' || (100 + p_size), 'MATH ' || (200 + p_size % 3) FROM part")
def _(spark, sf):
    rows = blocks(spark, sf).withColumn("code", F.regexp_extract("text", "^(CS [0-9]+)", 1))
    return G.prerequisite_edges(rows, "code", "text")


@query("course_blocks", f"WITH b AS ({BLOCKS}) SELECT p_partkey, regexp_extract(text, '^(CS [0-9]+)', 1) AS code, regexp_extract(text, '^CS [0-9]+\\. ([^.]+)\\.', 1) AS title, CAST(regexp_extract(text, '([0-9]+)-9 Credits', 1) AS INT) AS credits, regexp_extract(text, 'Credits\\. (.*)Prerequisite', 1) AS description, regexp_extract(text, 'Prerequisite: ([^.]+)\\.', 1) AS prerequisites, regexp_extract(text, 'Corequisite: ([^.]+)\\.', 1) AS corequisites, regexp_extract(text, 'Satisfies: ([^.]+)\\.', 1) AS core FROM b")
def _(spark, sf):
    return G.course_blocks(blocks(spark, sf), "p_partkey", "text").drop("block_no")


@query("program_requirements", "SELECT p_brand, string_agg(DISTINCT 'CS ' || (100 + p_size), '|' ORDER BY 'CS ' || (100 + p_size)) AS required, min(p_type) AS admission FROM part GROUP BY p_brand")
def _(spark, sf):
    rows = part(spark, sf).withColumn("code", F.concat(F.lit("CS "), (100 + F.col("p_size")).cast("string")))
    return G.program_requirements(rows, "p_brand", "code", "p_type")


@query("program_record", """WITH y AS (SELECT p_brand, p_size % 4 AS place, min(p_name) AS fall, max(p_name) AS spring FROM part WHERE p_size % 5 > 0 GROUP BY ALL), o AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 3 = 0)
  SELECT p_brand, string_agg(DISTINCT 'CS ' || (100 + p_size), '|' ORDER BY 'CS ' || (100 + p_size)) AS required, min(p_type) AS admission,
    coalesce((SELECT string_agg('Year ' || place || ': ' || fall || ' / ' || spring, '|' ORDER BY place) FROM y WHERE y.p_brand = part.p_brand), '') AS plan, coalesce((SELECT string_agg(p_type, '|' ORDER BY p_type) FROM o WHERE o.p_brand = part.p_brand), '') AS outcomes FROM part GROUP BY p_brand""")
def _(spark, sf):
    """Brands as programs, with a plan of up to four years and outcomes."""
    rows = part(spark, sf).withColumn("code", F.concat(F.lit("CS "), (100 + F.col("p_size")).cast("string")))
    plan = rows.where("p_size % 5 > 0").groupBy("p_brand", (F.col("p_size") % 4).alias("place")).agg(F.min("p_name").alias("fall"), F.max("p_name").alias("spring")).withColumn("year", F.concat(F.lit("Year "), F.col("place").cast("string")))
    outcomes = rows.where("p_size % 3 = 0").select("p_brand", F.col("p_type").alias("place"), F.col("p_type").alias("outcome")).distinct()
    found = G.program_requirements(rows, "p_brand", "code", "p_type", plan, outcomes)
    years = F.transform("plan", lambda x: F.concat(x["year"], F.lit(": "), x["fall"], F.lit(" / "), x["spring"]))
    return found.select("p_brand", "required", "admission", F.array_join(years, "|").alias("plan"), F.array_join("outcomes", "|").alias("outcomes"))


NAMES = ["History, Ph.D.", "Doctor of Music", "Physics, M.S.", "Master of Arts", "Art, M.A.", "Design, M.Arch.", "Chemistry, B.S.", "History, B.A.", "Art, B.F.A.", "Bachelor of Music", "Certificate in Data", "Minor in Latin", "PhD in Law", "Doctor of Philosophy in Law", "Master of Science in Law", "Summer School"]
TYPES = ["doctoral", "doctoral", "masters", "masters", "masters", "masters", "bachelors", "bachelors", "bachelors", "bachelors", "certificate", "minor", "other", "doctoral", "masters", "other"]
DEGREES = ["other", "other", "other", "other", "other", "other", "other", "other", "other", "bachelors", "certificate", "other", "doctoral", "doctoral", "masters", "other"]


@query("program_type", f"""WITH t AS (SELECT unnest(range(0, 16)) AS i, unnest({TYPES}) AS type, unnest({DEGREES}) AS degree)
  SELECT p_partkey, type, degree FROM part JOIN t ON i = p_partkey % 16""")
def _(spark, sf):
    """Each part gets one of the names, by both tables of rules; the SQL has the types that names should get."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 16 + 1).cast("int"))
    return part(spark, sf).select("p_partkey", G.program_type(name).alias("type"), G.program_type(name, G.DEGREE_TYPES).alias("degree"))


DAYNAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
CAL = ", ".join(f"(o_custkey >> {i}) % 2 = 1 AND (o_orderkey >> {i}) % 2 = 1 AS {d}" for i, d in enumerate(DAYNAMES))
ROUTED = f"WITH t AS (SELECT DISTINCT c_custkey AS route_id, o_orderkey AS service_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey), c AS (SELECT o_orderkey AS service_id, {CAL} FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT route_id, " + ", ".join(f"coalesce(bool_or({d}), false) AS {d}" for d in DAYNAMES) + " FROM t LEFT JOIN c USING (service_id) GROUP BY route_id)"


def service_days(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for routes, their orders for services, of which pending ones are in no calendar. A service
    runs on the days whose bits both its and its route's number have."""
    orders = read(spark, sf, "orders")
    routes = read(spark, sf, "customer").select(F.col("c_custkey").alias("route_id"))
    trips = orders.select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("service_id"))
    runs = lambda i: (F.shiftright("o_custkey", i) % 2 == 1) & (F.shiftright("o_orderkey", i) % 2 == 1)
    calendar = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("service_id"), *[runs(i).alias(d) for i, d in enumerate(DAYNAMES)])
    return G.route_service_days(routes, trips, calendar)


@query("route_service_days", ROUTED + " SELECT * FROM s")
def _(spark, sf):
    return service_days(spark, sf)


@query("day_label", ROUTED + """ SELECT route_id, CASE WHEN monday AND friday AND saturday AND NOT sunday THEN 'Monday-Saturday' WHEN monday AND friday AND NOT saturday AND NOT sunday THEN 'Monday-Friday'
  WHEN monday AND thursday AND NOT friday THEN 'Monday-Thursday' WHEN monday AND tuesday AND wednesday AND thursday AND friday AND saturday AND sunday THEN 'Daily'
  WHEN monday OR tuesday OR wednesday OR thursday OR friday OR saturday OR sunday THEN array_to_string(list_filter([CASE WHEN monday THEN 'Mon' END, CASE WHEN tuesday THEN 'Tue' END, CASE WHEN wednesday THEN 'Wed' END, CASE WHEN thursday THEN 'Thu' END, CASE WHEN friday THEN 'Fri' END, CASE WHEN saturday THEN 'Sat' END, CASE WHEN sunday THEN 'Sun' END], lambda x: x IS NOT NULL), ', ')
  ELSE 'Special schedule' END AS label FROM s""")
def _(spark, sf):
    return service_days(spark, sf).select("route_id", G.day_label().alias("label"))


@query("numeric_first_sort", "SELECT p_brand, CAST(dense_rank() OVER (ORDER BY coalesce(TRY_CAST(replace(p_brand, 'Brand#', '') AS INT), 999), p_brand) AS INT) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, sf):
    from pyspark.sql.window import Window

    brands = part(spark, sf).select("p_brand").distinct()
    number = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    return brands.withColumn("place", F.dense_rank().over(Window.orderBy(*G.numeric_first(number))))  # one row per brand


@query("membership_flags", "SELECT p_partkey, p_size IN (1, 2, 3) AS small, p_size IN (10, 20) AS round, CASE p_size WHEN 1 THEN 'smallest' WHEN 20 THEN 'a score' END AS note FROM part")
def _(spark, sf):
    return G.membership_flags(part(spark, sf), "p_size", {"small": [1, 2, 3], "round": [10, 20]}, {1: "smallest", 20: "a score"}).select("p_partkey", "small", "round", "note")


@query("catalog_summary", "SELECT CASE WHEN grouping(p_type) = 1 THEN 'all' WHEN p_type = 'ECONOMY' THEN 'Economy class' ELSE p_type END AS name, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY ROLLUP (p_type)")
def _(spark, sf):
    return G.catalog_summary(part(spark, sf), "p_type", {"large": F.col("p_size") > 25}, {"ECONOMY": "Economy class"})


@query("course_level", "SELECT p_partkey, CASE WHEN p_size * 20 >= 500 THEN 'graduate' ELSE 'undergraduate' END AS two, CASE WHEN p_size * 20 >= 700 THEN 'graduate' WHEN p_size * 20 >= 500 THEN 'advanced_undergraduate' ELSE 'undergraduate' END AS three FROM part")
def _(spark, sf):
    n = F.col("p_size") * 20
    return part(spark, sf).select("p_partkey", G.course_level(n).alias("two"), G.course_level(n, "three").alias("three"))


# --- context --------------------------------------------------------------------------------------------


@query("relevant_fields", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'title,credits' WHEN 'assistant' THEN 'name' ELSE '' END || CASE WHEN len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), ['and', 'ands'])) > 0 THEN CASE WHEN role IN ('user', 'assistant') THEN ',email' ELSE 'email' END ELSE '' END AS fields FROM conversations")
def _(spark, sf):
    fields = X.relevant_fields(F.col("role"), F.col("text"), {"user": ["title", "credits"], "assistant": ["name"]}, {"email": ["and"]})
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(fields, ",").alias("fields"))


#: Texts by language as results of three intents: courses have a code and a page, people a list of topics.
CODE = "upper(source) || ' ' || doc_id"
BLOCK = f"""'[Source: ' || source || ']' || chr(10) || CASE lang WHEN 'en' THEN 'Code: ' || {CODE} || chr(10) || CASE WHEN text <> '' THEN 'Text: ' || left(text, 600) || chr(10) ELSE '' END || 'URL: https://courses.example.org/' || lower(source) || '/' || doc_id
  WHEN 'de' THEN concat_ws(chr(10), 'Name: ' || doc_id, 'Topics: ' || left(nullif(array_to_string(string_split(text, ' ')[1:5], ', '), ''), 200)) ELSE left(text, 400) END"""


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    ranked = standing(spark, sf).search(questions(spark, sf), 5).join(docs, "doc_id")
    number, source, text = F.col("doc_id").cast("string"), F.col("source"), F.col("text")
    page = F.concat_ws("/", F.lit("https://courses.example.org"), F.lower(source), number)
    blocks = {
        "en": [("Code", F.concat_ws(" ", F.upper(source), number), 50), ("Text", text, 600), ("URL", page, 200)],
        "de": [("Name", number, 50), ("Topics", X.listed(F.split(text, " ")), 200)],
    }
    block = X.render_by_intent(F.col("lang"), source, blocks, F.substring(text, 1, 400))
    return ranked.select("query_id", "rank", "doc_id", "source", "lang", block.alias("block"))


@query("render_result", bm25_sql() + f" SELECT query_id, b.rank, doc_id, md5({BLOCK}) AS block FROM bm25 b JOIN documents USING (doc_id)")
def _(spark, sf):
    return rendered(spark, sf).select("query_id", "rank", "doc_id", F.md5("block").alias("block"))


#: Results of seven kinds, by number; every second has a name of its own, every third one in its metadata, every fifth no content.
KINDS = ["people", "course", "dining", "transit", "housing", "program", "other"]
#: What each kind shows in SQL, from d (doc_id, source, lang, name, content, words): the name that it needs, its lines, and how much content it shows without a name and with one.
SHOWN = {
    "people": ("name", """'Professor: ' || name, 'Department: ' || coalesce(nullif(lang, ''), 'N/A'), CASE WHEN doc_id % 4 < 2 THEN 'Email: u' || doc_id || '@x.org' END,
      CASE WHEN doc_id % 3 = 1 OR doc_id % 4 = 1 THEN 'Office: ' || trim(CASE WHEN doc_id % 3 = 1 THEN 'R' || doc_id ELSE '' END || ' ' || CASE WHEN doc_id % 4 = 1 THEN 'Hall' ELSE '' END) END,
      'Research: ' || nullif(array_to_string(words[1:5], ', '), ''), CASE WHEN doc_id % 3 = 2 THEN 'URL: https://x.org/' || doc_id END""", 400, 0),
    "course": ("coalesce(CASE WHEN doc_id % 2 = 0 THEN upper(source) || ' ' || doc_id END, name)", """'Course: ' || CASE WHEN doc_id % 2 = 0 THEN upper(source) || ' ' || doc_id || ' - ' ELSE '' END || coalesce(name, ''), CASE WHEN doc_id % 4 < 2 THEN 'Credits: ' || doc_id % 5 END,
      'Description: ' || nullif(left(content, 200), ''), CASE WHEN doc_id % 2 = 0 THEN 'URL: https://x.org/?P=' || replace(upper(source) || ' ' || doc_id, ' ', '+') END""", 500, 0),
    "dining": ("name", "'Name: ' || name, 'Building: ' || nullif(lang, ''), CASE WHEN doc_id % 3 < 2 THEN 'Hours: Mo: 8-5' || CASE WHEN doc_id % 2 = 0 THEN '; Tu: 9-5' ELSE '' END END, 'Source URL: https://x.org/dining'", 400, 500),
    "transit": ("name", "'Route: ' || name, 'Number: ' || doc_id % 50, 'Operates: ' || nullif(array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Monday' END, CASE WHEN doc_id % 3 = 0 THEN 'Sunday' END], lambda x: x IS NOT NULL), ', '), ''), 'Source URL: https://x.org/transit'", 400, 500),
    "housing": ("name", "'Name: ' || name, CASE WHEN doc_id % 2 = 0 THEN 'Bath: shared' END, 'Room types: ' || nullif(array_to_string(words[1:3], ', '), ''), 'Source URL: https://x.org/housing'", 400, 600),
    "program": ("'?'", """'Program: ' || coalesce(name, '?'), 'Level: ' || nullif(lang, ''), 'Courses: ' || nullif(array_to_string(words[1:15], ', ') || CASE WHEN len(words) > 15 THEN ' (+' || len(words) - 15 || ' more)' ELSE '' END, ''),
      CASE WHEN len(words) > 0 THEN 'Outcomes:' || chr(10) || array_to_string(list_transform(words[1:4], lambda x: '  - ' || left(x, 180)), chr(10)) END, CASE WHEN doc_id % 3 = 2 THEN 'Catalog URL: https://x.org/' || doc_id END""", 400, 0),
    "other": ("NULL", "NULL", 400, 0),
}


def sql_block(kind: str) -> str:
    name, lines, bare, ready = SHOWN[kind]
    body = f"CASE WHEN {name} IS NOT NULL THEN concat_ws(chr(10), {lines}) ELSE left(nullif(content, ''), {bare}) END"
    body = f"CASE WHEN {name} IS NOT NULL AND content <> '' THEN left(content, {ready}) ELSE {body} END" if ready else body
    return f"coalesce('[Source: ' || source || ']' || chr(10) || {body}, '')"


@query("render_kinds", bm25_sql() + """, z AS (SELECT query_id, rank, doc_id, source, lang, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'N' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'M' || doc_id END) AS name, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS content FROM bm25 b JOIN documents USING (doc_id)),
  shown AS (SELECT *, list_filter(string_split(content, ' '), lambda x: x <> '') AS words FROM z) SELECT query_id, rank, doc_id, md5(CASE doc_id % 7 """ + " ".join(f"WHEN {i} THEN {sql_block(k)}" for i, k in enumerate(KINDS)) + " END) AS block FROM shown")
def _(spark, sf):
    """Blocks of six kinds of result, with values of the row or of its metadata, and of those of none."""
    number = F.col("doc_id")
    ranked = standing(spark, sf).search(questions(spark, sf), 5).join(documents(spark, sf), "doc_id")
    rows = ranked.withColumns({
        "own": F.when(number % 2 == 0, F.concat(F.lit("N"), number.cast("string"))),
        "metadata": F.when(number % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("M"), number.cast("string")))),
        "content": F.when(number % 5 == 0, "").otherwise(F.col("text")), "fields": F.when(number % 4 < 2, F.array(F.lit("email"), F.lit("credits"))).otherwise(F.array(F.lit("phone"))),
        "kind": F.element_at(F.array(*map(F.lit, KINDS)), (number % 7 + 1).cast("int")),
    })
    rows = rows.withColumn("words", F.filter(F.split("content", " "), lambda x: x != ""))
    name, text, n = X.picked(F.col("own"), F.col("metadata"), "name"), F.col("content"), number.cast("string")
    code = F.when(number % 2 == 0, F.concat_ws(" ", F.upper("source"), n))
    url = F.when(number % 3 == 2, F.concat(F.lit("https://x.org/"), n))
    office = F.trim(F.concat_ws(" ", F.when(number % 3 == 1, F.concat(F.lit("R"), n)), F.when(number % 4 == 1, "Hall")))
    hours = F.when(number % 3 < 2, F.concat_ws("; ", F.lit("Mo: 8-5"), F.when(number % 2 == 0, "Tu: 9-5")))
    days = F.array_join(F.array_compact(F.array(F.when(number % 2 == 0, "Monday"), F.when(number % 3 == 0, "Sunday"))), ", ")
    fields, words = F.col("fields"), F.col("words")
    blocks = {
        "people": X.Block(name, [X.line("Professor", name), X.line("Department", F.coalesce(F.nullif("lang", F.lit("")), F.lit("N/A"))), X.if_asked(fields, ["email"], X.line("Email", F.concat(F.lit("u"), n, F.lit("@x.org")))), X.line("Office", office), X.line("Research", X.listed(words)), X.line("URL", url)]),
        "course": X.Block(F.coalesce(code, name), [X.line("Course", F.concat(F.coalesce(F.concat(code, F.lit(" - ")), F.lit("")), F.coalesce(name, F.lit("")))), X.if_asked(fields, ["credits"], X.line("Credits", number % 5)), X.line("Description", text, 200), X.line("URL", F.concat(F.lit("https://x.org/?P="), F.replace(code, F.lit(" "), F.lit("+"))))], 500),
        "dining": X.Block(name, [X.line("Name", name), X.line("Building", F.col("lang")), X.line("Hours", hours), F.lit("Source URL: https://x.org/dining")], ready=500),
        "transit": X.Block(name, [X.line("Route", name), X.line("Number", number % 50), X.line("Operates", days), F.lit("Source URL: https://x.org/transit")], ready=500),
        "housing": X.Block(name, [X.line("Name", name), X.line("Bath", F.when(number % 2 == 0, "shared")), X.line("Room types", X.listed(words, 3)), F.lit("Source URL: https://x.org/housing")], ready=600),
        "program": X.Block(F.lit("?"), [X.line("Program", F.coalesce(name, F.lit("?"))), X.line("Level", F.col("lang")), X.line("Courses", X.counted(words, 15)), X.below("Outcomes", words, 4, 180), X.line("Catalog URL", url)]),
    }
    block = X.render_kinds(F.col("kind"), F.col("source"), text, blocks, X.Block(F.lit(None).cast("string"), []))
    return rows.select("query_id", "rank", "doc_id", F.md5(block).alias("block"))


@query("build_context", bm25_sql() + f""", rr AS (SELECT query_id, b.rank, source, {BLOCK} AS block FROM bm25 b JOIN documents USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM rr),
  j AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS c FROM k WHERE n = 1 GROUP BY query_id) SELECT query_id, CASE WHEN length(c) > 600 THEN left(c, 600) || '[...additional results omitted]' ELSE c END AS context FROM j""")
def _(spark, sf):
    return X.build_context(rendered(spark, sf).withColumn("name", F.col("source")), 600)


@query("filter_blocks", "SELECT p_brand, coalesce(string_agg('Name: ' || p_name || chr(10) || 'Department: ' || p_type, chr(10) || chr(10) ORDER BY p_partkey) FILTER (contains(lower(p_type), 'eco')), '') AS context FROM part GROUP BY p_brand")
def _(spark, sf):
    block = F.concat(F.lit("Name: "), "p_name", F.lit("\nDepartment: "), "p_type")
    joined = part(spark, sf).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
    return joined.select("p_brand", X.filter_blocks(F.col("context"), "Department", "eco").alias("context"))


@query("sectioned_context", bm25_sql() + """, rr AS (SELECT query_id, lang, min(bm25.rank) OVER (PARTITION BY query_id, lang) AS no, bm25.rank AS rank, text AS t FROM bm25 JOIN documents USING (doc_id)),
  s AS (SELECT query_id, lang, no, '=== ' || upper(lang) || ' INFORMATION ===' || chr(10) || string_agg(t, chr(10) ORDER BY rank) AS body FROM rr GROUP BY query_id, lang, no) SELECT query_id, md5(string_agg(body, chr(10) || chr(10) ORDER BY no)) AS context FROM s GROUP BY query_id""")
def _(spark, sf):
    from pyspark.sql.window import Window

    docs = documents(spark, sf)
    ranked = standing(spark, sf).search(questions(spark, sf), 5).join(docs, "doc_id")
    rows = ranked.select("query_id", "lang", "rank", F.col("text").alias("t"), F.min("rank").over(Window.partitionBy("query_id", "lang")).alias("no"))
    return X.sectioned_context(rows, "query_id", "lang", "no", "rank", "t").select("query_id", F.md5("context").alias("context"))


@query("mentions", "SELECT doc_id, array_to_string(list_distinct_first, '|') AS emails FROM (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(m), lambda x: [lpad(list_position(m, x)::VARCHAR, 9, '0'), x]))[1:3], lambda y: y[2]) AS list_distinct_first FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS m FROM documents))")
def _(spark, sf):
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), F.lit(0))), 1, 3)
    return documents(spark, sf).select("doc_id", F.array_join(found, "|").alias("emails"))


@query("contact_fields", r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' <a href="mailto:desk' || doc_id || '@x.org">desk</a>' WHEN 1 THEN text || ' Visit 12B Main Hall.' ELSE text END AS text FROM documents)
  SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1), ''), nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '')) AS email, nullif(regexp_extract(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}'), '') AS phone,
    nullif(regexp_extract(text, '\b([0-9]{2,4}[A-Z]?) ([A-Z][a-z]+ (?:Hall|Building|Center))', 1), '') AS room, nullif(regexp_extract(text, '\b([0-9]{2,4}[A-Z]?) ([A-Z][a-z]+ (?:Hall|Building|Center))', 2), '') AS building FROM t""")
def _(spark, sf):
    """Some documents get a mail link, others a room."""
    number = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(' <a href="mailto:desk'), number, F.lit('@x.org">desk</a>'))).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" Visit 12B Main Hall."))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", H.contacts(text).alias("c")).select("doc_id", "c.*")


@query("outcome_items", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '- ' || replace(text, chr(10), chr(10) || '- ') ELSE text END AS text FROM documents), l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS lines FROM t),
  b AS (SELECT doc_id, lines, list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '^[-*\x{2022}] ')), lambda x: trim(x[2:])), lambda x: length(x) > 20) AS bulleted FROM l),
  i AS (SELECT doc_id, CASE WHEN len(bulleted) > 0 THEN bulleted ELSE list_filter(lines, lambda x: length(x) > 15 AND NOT contains(lower(x), 'licen') AND NOT contains(lower(x), 'home')) END AS items FROM b)
  SELECT doc_id, CAST(generate_subscripts(items, 1) - 1 AS INT) AS item_no, md5(unnest(items)) AS item FROM i""")
def _(spark, sf):
    """Lines of every second document get bullets; licence lines introduce nothing."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", F.posexplode(H.outcome_items(text, ["licen", "home"])).alias("item_no", "item")).select("doc_id", "item_no", F.md5("item").alias("item"))


@query("page_kind", "SELECT page_id, CASE WHEN contains(url, 'course') THEN 'courses' WHEN contains(url, '1') THEN 'plan' WHEN contains(url, '2') THEN 'requirements' ELSE 'generic' END AS kind FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", C.first_keyword_type(F.col("url"), {"courses": ["course"], "plan": ["1"], "requirements": ["2"]}, "generic").alias("kind"))



@query("program_page", "SELECT p_partkey, p_size + 100 AS hours, 'overall: 3.' || (p_size % 10) || '|major: 2.5' AS gpas FROM part")
def _(spark, sf):
    text = F.expr("concat('Needs ', p_size + 100, ' credit hours, an overall GPA of 3.', p_size % 10, ' and a major GPA of 2.5.')")
    return part(spark, sf).select("p_partkey", G.program_hours(text).alias("hours"), F.array_join(G.program_gpas(text), "|").alias("gpas"))


@query("course_buckets", "SELECT DISTINCT p_brand, CASE p_size % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'electives' ELSE 'core' END AS bucket, 'CS ' || (100 + p_size) AS code FROM part")
def _(spark, sf):
    rows = part(spark, sf).selectExpr("p_brand", "CASE p_size % 3 WHEN 0 THEN 'Math courses' WHEN 1 THEN 'Electives' ELSE 'Required' END AS header", "concat('Take CS ', 100 + p_size, '.') AS body")
    return G.course_buckets(rows, "p_brand", "header", "body")


LETTERS = "list_transform(range(97, 123), lambda i: (length({0}) - length(replace({0}, chr(i::INT), '')))::DOUBLE)"


@query("embed", f"WITH c AS (SELECT doc_id, {LETTERS.format('lower(text)')} AS c FROM documents), n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS size FROM c) SELECT doc_id, round(CASE WHEN size > 0 THEN c[1] / size ELSE 0 END, 5) AS first, round(CASE WHEN size > 0 THEN list_sum(c) / size ELSE 0 END, 4) AS total FROM n")
def _(spark, sf):
    """Vectors of all documents by a batch function; of each the first component and the sum."""
    v = embed(documents(spark, sf), "doc_id", "text", letter_shares)
    return v.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("hashed_tfidf")
def _(spark, sf):
    """Hashed TF-IDF vectors of all documents, as text."""
    vectors = hashed_tfidf(documents(spark, sf), "doc_id", "text")
    return vectors.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), ",").alias("embedding"))
