"""Queries on sources, pages and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusops.functions import decompose as Q, rules as C
from corpusops.operators import catalog as L, lexical, ranking as R, relations as G, rerank as R2, routing as W
from corpusops.plans.activity import events
from corpusops.plans.questions import INTENTS, SEED, sql_intent, sql_score, sql_word
from corpusops.plans.registry import query, read
from corpusops.plans.retrieval import IDF, documents, questions, sql_tokens
from corpusops.sources import files as S, html as H
from corpusops.streaming import admission as A


@query("flatten_keyed_groups", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS group_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    rows = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    groups = rows.groupBy(F.col("n_nationkey").cast("string").alias("key"), "n_name").agg(F.collect_list(F.struct("s_suppkey")).alias("items")).select("key", F.struct(F.col("n_name").alias("name"), "items").alias("value"))
    return S.flatten_keyed_groups(groups, "items").select("key", "group_name", "s_suppkey")


@query("latest_snapshot", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate)::DATE FROM orders)")
def _(spark, sf):
    return S.latest_snapshot(read(spark, sf, "orders"), F.date_format("o_orderdate", "yyyyMMdd")).select("o_orderkey")


@query("read_pages", "SELECT page_id, url, CAST(length(html) AS INT) AS n_chars FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


@query("write_partitioned", "SELECT replace(lower(p_brand), ' ', '_') AS group_slug, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    path = S.shared_folder(spark, "partitioned")
    S.write_partitioned(read(spark, sf, "part"), F.col("p_brand"), path)
    return spark.read.parquet(path).groupBy("group_slug").agg(F.count(F.lit(1)).alias("n"))


@query("group_manifest", "SELECT n_name, count(*) AS n, count(*) OVER () AS n_groups, CAST(sum(count(*)) OVER () AS BIGINT) AS n_rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf):
    return S.group_manifest(read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), "n_name")


@query("jsonp_results", "SELECT event_id, event_type AS kind, user_id AS owner FROM events")
def _(spark, sf):
    """Events wrapped as JSONP in two ways, and unwrapped."""
    body = F.concat(F.lit('[{"kind": "'), "event_type", F.lit('", "owner": '), F.col("user_id").cast("string"), F.lit("}]"))
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("callback("), body, F.lit(");"))).otherwise(F.concat(F.lit('cb({"results": '), body, F.lit("})")))
    return S.jsonp(read(spark, sf, "events").select("event_id", wrapped.alias("raw")), "raw", "kind string, owner long")


@query("wrapped_json", "SELECT 'PT ' || p_partkey AS course_code, p_name AS title, p_size::VARCHAR AS credits FROM part")
def _(spark, sf):
    """Parts as courses in JSON files of the form {"brand": ..., "courses": [...]}, at most a thousand in a file, and read back."""
    course = F.struct(F.concat(F.lit("PT "), F.col("p_partkey").cast("string")).alias("course_code"), F.col("p_name").alias("title"), F.col("p_size").cast("string").alias("credits"))
    files = read(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.collect_list(course).alias("courses"))
    path = S.shared_folder(spark, "wrapped")
    files.select(F.to_json(F.struct(F.col("p_brand").alias("brand"), "courses")).alias("value"), F.col("p_brand").alias("of"), "part").write.partitionBy("of", "part").text(path)
    return S.read_wrapped_json(spark, path, "courses").select("course_code", "title", "credits")


@query("transit_feed", """SELECT c_custkey::VARCHAR AS route_id, '#' || CASE WHEN c_nationkey % 2 = 0 THEN '00FF00' ELSE 'FF0000' END AS route_color, count(o_orderkey) AS n_trips, count(o_orderkey) FILTER (o_orderkey % 2 = 1) AS n_monday FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _(spark, sf):
    """Customers and orders written as the four files of a feed, read back, and joined."""
    path = S.shared_folder(spark, "feed")
    routes, orders = read(spark, sf, "customer"), read(spark, sf, "orders")
    color = F.when(F.col("c_nationkey") % 2 == 0, "00FF00").otherwise("FF0000")
    days = [F.when(F.col("o_orderkey") % (i + 2) == 1, "1").otherwise("0").alias(d) for i, d in enumerate(G.DAYS)]
    made = {
        "routes": routes.select(F.col("c_custkey").alias("route_id"), F.col("c_custkey").alias("route_short_name"), F.col("c_name").alias("route_long_name"), F.lit("d").alias("route_desc"), color.alias("route_color"), F.lit("u").alias("route_url")),
        "calendar": orders.select(F.col("o_orderkey").alias("service_id"), *days, F.lit("20240101").alias("start_date"), F.lit("20241231").alias("end_date")),
        "trips": orders.select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("service_id")),
        "stops": read(spark, sf, "nation").select(F.col("n_nationkey").alias("stop_id"), F.col("n_name").alias("stop_name"), F.lit("38.9").alias("stop_lat"), F.lit("-95.2").alias("stop_lon")),
    }
    for name, rows in made.items():
        rows.write.option("header", True).csv(f"{path}/{name}.txt")
    feed = S.read_gtfs(spark, path)
    trips = feed["trips"].join(feed["calendar"], "service_id")
    counts = trips.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_trips"), F.count_if("monday").alias("n_monday"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return feed["routes"].join(counts, "route_id", "left").select("route_id", "route_color", zero("n_trips"), zero("n_monday"))


@query("rebuild_corpus", "SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source")
def _(spark, sf):
    """A corpus is built, built anew from other documents, and left alone by a third build that must not replace it."""
    path = S.shared_folder(spark, "corpus")
    docs = documents(spark, sf)
    S.rebuild_corpus(docs, path)
    S.rebuild_corpus(docs.where("lang <> 'en'"), path)
    S.rebuild_corpus(docs, path, replace=False)
    return S.Corpus(spark, path).read().groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_corpus", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS made_in, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS text FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 2, md5(text) FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2, md5(text || '!') FROM documents WHERE doc_id % 15 = 0""")
def _(spark, sf):
    """All documents but every fifth, then all of them, of which every third has changed: what is new or has changed is made anew."""
    corpus, docs = S.Corpus(spark, S.shared_folder(spark, "corpus")), read(spark, sf, "documents").select("doc_id", "text")
    corpus.upsert(docs.where("doc_id % 5 <> 0"), "doc_id", ["text"], lambda rows: rows.withColumn("made_in", F.lit(1)))
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    corpus.upsert(later, "doc_id", ["text"], lambda rows: rows.withColumn("made_in", F.lit(2)))
    return corpus.read().select("doc_id", "made_in", F.md5("text").alias("text"))


@query("latest_file", "SELECT event_id, user_id, event_type FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events)")
def _(spark, sf):
    """Events in a folder a day, of which the newest is read."""
    path = S.shared_folder(spark, "snapshots")
    rows = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"))
    rows.repartition("day").write.partitionBy("day").json(path)
    day = lambda p: F.element_at(F.split(p, "/"), -2)
    return S.latest_file(spark, path, "event_id long, user_id long, event_type string", day).drop("file_name")


@query("export_files", """WITH n AS (SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
  SELECT 'csv' AS fmt, event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'a "b", ' || chr(10) || event_type WHEN event_id % 3 = 1 THEN event_type END AS note FROM n
  UNION ALL SELECT 'json', event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'a "b", ' || chr(10) || event_type WHEN event_id % 3 = 1 THEN event_type END FROM n""")
def _(spark, sf):
    """The newest events as CSV and as JSON lines, with quotes, commas, line feeds and nulls in a column, and read back."""
    path = S.shared_folder(spark, "export")
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('a "b", \n'), "event_type")).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    rows = read(spark, sf, "events").select("event_id", "user_id", note.alias("note"), "ts")
    schema, out = "event_id long, user_id long, note string, ts timestamp", None
    for fmt in ("csv", "json"):
        S.export_newest(rows, "ts", "event_id", 500, f"{path}/{fmt}", fmt)
        back = spark.read.schema(schema).option("header", True).option("multiLine", fmt == "csv").option("escape", '"').format(fmt).load(f"{path}/{fmt}").select(F.lit(fmt).alias("fmt"), "event_id", "user_id", "note")
        out = back if out is None else out.unionByName(back)
    return out


@query("stream_counts", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    """Events counted by hour and type on a stream."""
    path = S.shared_folder(spark, "stream")
    rows = events(spark, sf).select("event_type", "ts")
    rows.write.parquet(f"{path}/in")
    counts = A.stream_counts(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "ts", "event_type")
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination(600)
    return spark.read.schema(counts.schema).parquet(f"{path}/out").select(F.col("start").cast("string").alias("start"), "event_type", "n")


# --- pages ----------------------------------------------------------------------------------------------

#: Lines of a piece of a page: what stands between tags, entities resolved, runs of white space one space.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", " "), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")]


def sql_lines(html: str) -> str:
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    parts = f"regexp_split_to_array({text}, '<[^>]*>')"
    entity = "x"
    for a, b in ENTITIES:  # a browser takes them without their semicolon too, as in a title that was cut there
        entity = f"regexp_replace({entity}, '{a}?', '{b}', 'g')"
    return f"list_filter(list_transform({parts}, lambda x: trim(regexp_replace({entity}, '\\s+', ' ', 'g'))), lambda x: x <> '')"


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
PAGE = "regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|header|footer|aside|form)\\b.*?</\\1>', '', 'g'), '(?s)<head>.*?</head>', '', 'g')"


@query("main_text", f"SELECT page_id, md5(array_to_string({sql_lines(ARTICLE)}, chr(10))) AS text FROM pages")
def _(spark, sf):
    found = H.extract(read(spark, sf, "pages"), "page_id", "html", lambda h: [{"text": H.main_text(h)}], "text string")
    return found.select("page_id", F.md5("text").alias("text"))


@query("heading_sections")
def _(spark, sf):
    return H.extract(read(spark, sf, "pages"), "page_id", "html", lambda h: [{"heading": a, "body": b} for a, b in H.heading_sections(h)], "heading string, body string")


LINK = r"""(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""


@query("outbound_links", f"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 1) AS h, regexp_extract_all(html, '{LINK}', 2) AS x FROM pages),
  u AS (SELECT page_id, url, unnest(h) AS h, unnest(x) AS x, generate_subscripts(h, 1) - 1 AS place FROM l),
  a AS (SELECT page_id, CAST(place AS INT) AS place, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, CASE WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h ELSE h END AS href FROM u)
  SELECT page_id, place, text, href FROM a WHERE regexp_matches(href, '^https?://') QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place) = 1""")
def _(spark, sf):
    return H.outbound_links(read(spark, sf, "pages"), "page_id", "html", "url")


@query("person_profile")
def _(spark, sf):
    return H.extract(read(spark, sf, "pages"), "page_id", "html", lambda h: [p] if (p := H.person(h)) else [], "name string, title string, email string, phone string, office string, research string, biography string")


@query("people_cards")
def _(spark, sf):
    found = H.extract(read(spark, sf, "pages"), "page_id", "html", H.cards, "name string, title string, email string")
    return R.keep_first(found, [F.lower("email")], [F.asc("page_id"), F.asc("item_no")])


@query("program_plan", "SELECT p_partkey AS page_id, CASE no WHEN 0 THEN 'First Year' ELSE 'Second Year ' || p_size END AS year, CASE no WHEN 0 THEN p_name ELSE p_type END AS fall, CASE no WHEN 0 THEN p_brand ELSE p_name END AS spring FROM part, range(2) r(no)")
def _(spark, sf):
    """Parts as pages with a plan of two years."""
    page = F.expr("concat('<main><table><tr><th>First Year</th></tr><tr><td>', p_name, '</td><td>3</td><td>', p_brand, '</td></tr><tr><th>Second Year ', p_size, '</th></tr><tr><td>', p_type, '</td><td>3</td><td>', p_name, '</td></tr><tr><td>short</td></tr></table></main>')")
    pages = S.spread(read(spark, sf, "part")).select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return H.extract(pages, "page_id", "html", H.plan_rows, "year string, fall string, spring string").select("page_id", "year", "fall", "spring")


@query("section_rows", """SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS item_no, l_partkey::VARCHAR AS class_number,
  CASE WHEN l_quantity < 10 THEN 'open' WHEN l_quantity < 20 THEN 'full' WHEN l_quantity < 30 THEN 'unopened' ELSE 'unknown' END AS seats_status, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS INT) END AS enrolled, CASE WHEN l_linenumber % 2 = 0 THEN 'MWF' END AS days FROM lineitem""")
def _(spark, sf):
    """Orders as pages of class sections; every second section has a row of notes."""
    seats = F.expr("CASE WHEN l_quantity < 10 THEN cast(1 + cast(l_quantity AS INT) AS STRING) WHEN l_quantity < 20 THEN 'Full' WHEN l_quantity < 30 THEN 'Unopened' ELSE '?' END")
    notes = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("<tr><td>"), F.col("l_suppkey").cast("string"), F.lit(" students enrolled out of 300 MWF 10:00 - 10:50 AM</td></tr>"))).otherwise("")
    row = F.concat(F.lit("<tr><td>LEC</td><td>Lee</td><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), seats, F.lit("</td></tr>"), notes)
    pages = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    found = H.extract(pages.select("page_id", F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html")), "page_id", "html", H.section_rows, "class_number string, seats_status string, enrolled int, days string")
    return found.select("page_id", "item_no", "class_number", "seats_status", "enrolled", "days")


@query("section_details", """SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS item_no, CASE WHEN l_returnflag = 'A' THEN 'LAB' ELSE 'LEC' END AS type, 'Lee ' || l_suppkey AS instructor, l_partkey::VARCHAR AS class_number,
  CASE WHEN l_quantity < 10 THEN 'open' WHEN l_quantity < 20 THEN 'full' WHEN l_quantity < 30 THEN 'unopened' ELSE 'unknown' END AS seats_status, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_suppkey AS INT) END AS enrolled, CASE WHEN l_linenumber % 3 > 0 THEN 300 END AS most,
  CASE l_linenumber % 3 WHEN 1 THEN 'MWF' WHEN 2 THEN 'TuTh' END AS days, CASE l_linenumber % 3 WHEN 1 THEN '10:00 - 10:50 AM' WHEN 2 THEN '1:05 - 2:15 PM' END AS time, CASE WHEN l_linenumber % 3 = 1 THEN 'Hall ' || l_partkey || ' & Annex' END AS location FROM lineitem""")
def _(spark, sf):
    """All fields of class sections: some rows of notes have no place, some sections no notes."""
    seats = F.expr("CASE WHEN l_quantity < 10 THEN cast(1 + cast(l_quantity AS INT) AS STRING) WHEN l_quantity < 20 THEN 'Full' WHEN l_quantity < 30 THEN 'Unopened' ELSE '?' END")
    number, kind = F.col("l_linenumber"), F.when(F.col("l_returnflag") == "A", "LAB").otherwise("LEC")
    when = F.when(number % 3 == 1, F.concat(F.lit("MWF 10:00 - 10:50 AM <a href='https://maps.example.org'><span>Hall "), F.col("l_partkey").cast("string"), F.lit(" &amp; Annex</span></a>"))).otherwise("TuTh 1:05 - 2:15 PM")
    notes = F.when(number % 3 > 0, F.concat(F.lit("<tr><td>Notes</td><td>"), F.col("l_suppkey").cast("string"), F.lit(" students enrolled out of 300 "), when, F.lit("</td></tr>"))).otherwise("")
    row = F.concat(F.lit("<tr><td>"), kind, F.lit("</td><td>Lee "), F.col("l_suppkey").cast("string"), F.lit("</td><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), seats, F.lit("</td></tr>"), notes)
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row"))))
    pages = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "").alias("rows"))
    schema = "type string, instructor string, class_number string, seats_status string, enrolled int, most int, days string, time string, location string"
    return H.extract(pages.select("page_id", F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html")), "page_id", "html", H.section_rows, schema)


@query("leaders_by_role", "SELECT role, max_by(p_name, p_partkey) AS name, max(p_partkey) AS p_partkey FROM (SELECT *, CASE WHEN contains(lower(p_type), 'eco') THEN 'chair' WHEN contains(lower(p_type), 'pro') THEN 'director' END AS role FROM part) WHERE role IS NOT NULL GROUP BY role")
def _(spark, sf):
    """The last match of each role counts."""
    role = C.first_keyword_type(F.col("p_type"), {"chair": ["eco"], "director": ["pro"]}, "none")
    rows = read(spark, sf, "part").withColumn("role", role).where("role != 'none'")
    return rows.groupBy("role").agg(F.max_by("p_name", "p_partkey").alias("name"), F.max("p_partkey").alias("p_partkey"))


# --- routing --------------------------------------------------------------------------------------------

LANGS = {"en": ["the", "and"], "de": ["der", "und"], "fr": ["les", "une"], "es": ["que", "una"]}
#: Tables v (vectors), c (documents), and BM25's by language and over all.
CORPUS = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT doc_id, lang, text, v FROM documents LEFT JOIN v ON vec_id = doc_id),
  d AS (SELECT doc_id, lang, {sql_tokens('text')} AS tokens FROM documents), p AS (SELECT lang, doc_id, len(tokens) AS length, unnest(tokens) AS term FROM d), t AS (SELECT lang, doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
  f AS (SELECT lang, term, count(*) AS df FROM t GROUP BY ALL), s AS (SELECT lang, count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d GROUP BY lang),
  fa AS (SELECT term, count(*) AS df FROM t GROUP BY ALL), sa AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d)"""


def sql_hybrid(q: str, out: str, most: int, by_lang: bool) -> str:
    """Table out (query_id, doc_id, score, rank) of q (query_id, text, vid, n[, lang])."""
    lang, using = (" AND c.lang = q.lang", "JOIN f USING (lang, term) JOIN s USING (lang)") if by_lang else ("", "JOIN fa USING (term) CROSS JOIN sa")
    own, on = (", lang", "lang, term") if by_lang else ("", "term")
    return f"""{out}_n AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INT) AS rank, distance FROM (SELECT query_id, doc_id, round(1 - list_dot_product(a.v, c.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(c.v, c.v)), 6) AS distance FROM {q} q JOIN v a ON a.vec_id = q.vid JOIN c ON c.v IS NOT NULL{lang}) QUALIFY rank <= {most}),
  {out}_q AS (SELECT query_id{own}, term, count(*) AS qtf FROM (SELECT query_id{own}, unnest({sql_tokens('text')}) AS term FROM {q}) GROUP BY ALL),
  {out}_b AS (SELECT query_id, doc_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM t {using} JOIN {out}_q USING ({on}) GROUP BY ALL),
  {out}_w AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {out}_b WHERE score > 0 QUALIFY rank <= {most}),
  {out}_u AS (SELECT query_id, doc_id, 0 AS list, rank, 0.6::DOUBLE / (60 + rank) AS share FROM {out}_n WHERE 1 - distance >= 0.25 UNION ALL SELECT query_id, doc_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM {out}_w),
  {out}_g AS (SELECT query_id, doc_id, round(sum(share), 9) AS score, min(list * 1000 + rank) AS first FROM {out}_u GROUP BY ALL),
  {out} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS rank FROM {out}_g) JOIN {q} USING (query_id) WHERE rank <= least({most}, n))"""


def sql_fan_out(q: str, out: str) -> str:
    """Table out (query_id, lang, doc_id, score, rank) of q (query_id, text, vid)."""
    flags = " UNION ALL ".join(f"SELECT query_id, '{d}' AS lang, {i} AS no, text, vid FROM {q} WHERE {sql_word('text', w)}" for i, (d, w) in enumerate(LANGS.items()))
    n = "CASE WHEN regexp_matches(lower(text), '\\ball\\b') THEN 6 WHEN lang IN ('en', 'de') THEN 2 ELSE 3 END"
    return f"""{out}_a AS (SELECT *, query_id * 4 + no AS ask, {n} AS n FROM ({flags})), {out}_i AS (SELECT ask AS query_id, lang, text, vid, n FROM {out}_a), {sql_hybrid(out + '_i', out + '_h', 6, True)},
  {out}_f AS (SELECT a.query_id, lang, doc_id, score, rank FROM {out}_h h JOIN {out}_a a ON a.ask = h.query_id),
  {out}_o AS (SELECT query_id, text, vid, coalesce((SELECT max(n) FROM {out}_a a WHERE a.query_id = {q}.query_id), 6) AS n FROM {q} WHERE query_id NOT IN (SELECT query_id FROM {out}_f)), {sql_hybrid(out + '_o', out + '_r', 6, False)},
  {out} AS (SELECT * FROM {out}_f UNION ALL SELECT query_id, NULL, doc_id, score, rank FROM {out}_r)"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return documents(spark, sf).join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "lang", "text", "embedding")


def with_vectors(spark: SparkSession, sf: str, asked: DataFrame, vid: Column) -> DataFrame:
    """Questions with the vector of an id; the tables have none of questions."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("_vid"), F.col("embedding").alias("query"))
    return asked.join(vectors, vid == F.col("_vid"), "left").drop("_vid")


def active_domains(asked: DataFrame) -> DataFrame:
    """The languages of which a question has a word, two results each of the first two, three of the others, and six of
    any for a complete list."""
    flagged = asked.select("query_id", "text", F.explode(C.domain_flags(F.col("text"), LANGS)).alias("lang"))
    n = F.when(C.scope_of(F.col("text"), [r"\ball\b"]) == "complete_list", 6).when(F.col("lang").isin("en", "de"), 2).otherwise(3)
    return flagged.select("query_id", "lang", n.alias("n"))


@query("fan_out_domains", f"WITH {CORPUS}, q AS (SELECT item_id AS query_id, text, item_id AS vid FROM benchmark), {sql_fan_out('q', 'x')} SELECT * FROM x")
def _(spark, sf):
    """Each domain that a question names (here a language) is searched by words and vectors; a question that names none
    is asked of everything."""
    asked = with_vectors(spark, sf, questions(spark, sf), F.col("query_id"))
    return W.fan_out(asked, corpus(spark, sf), active_domains(asked), "lang", 6).select("query_id", "lang", "doc_id", "score", "rank")


#: Benchmark texts, every third as a question about two things in it.
COMPOUND = "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'tell me about ' || w[2] || ' ' || w[3] || ', ' || w[5] || ' ' || w[6] || '?' ELSE text END AS text FROM (SELECT item_id, text, string_split(trim(regexp_replace(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM benchmark)"
SUBS = "SELECT query_id * 10 AS query_id, text, query_id AS vid FROM m WHERE query_id % 3 <> 0 UNION ALL SELECT query_id * 10 + i, string_split(text[15:length(text) - 1], ', ')[i + 1], query_id FROM m, range(2) r(i) WHERE query_id % 3 = 0"
ROUTED_BY = {"article": ("en", 3, 6), "german": ("de", 3, 6), "romance": ("fr", 2, 4)}


@query("route", f"""WITH {CORPUS}, m AS ({COMPOUND}), sub AS ({SUBS}), k AS (SELECT query_id, text, vid, {sql_score(text="x")} AS s FROM (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS x FROM sub)),
  i AS (SELECT query_id, text, vid, {sql_intent()} AS intent FROM k), b(intent, lang, n_top, n_all) AS (VALUES {", ".join(f"('{i}', '{x}', {n}, {k})" for i, (x, n, k) in ROUTED_BY.items())}),
  a AS (SELECT query_id, text, vid, lang, CASE WHEN regexp_matches(lower(text), '\\ball\\b') THEN n_all ELSE n_top END AS n FROM i JOIN b USING (intent)), {sql_hybrid('a', 'y', 6, True)},
  o AS (SELECT query_id, text, vid FROM sub WHERE query_id NOT IN (SELECT query_id FROM y)), {sql_fan_out('o', 'x')},
  z AS (SELECT query_id, doc_id, max(score) AS score FROM x GROUP BY ALL), e AS (SELECT query_id, 'source' AS strategy, doc_id, score, rank FROM y UNION ALL SELECT query_id, 'fan_out', doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM z QUALIFY rank <= 6),
  l AS (SELECT CAST(floor(e.query_id / 10) AS BIGINT) AS query_id, e.query_id % 10 AS sub_no, strategy, doc_id, score, rank, left(c.text, 100) AS head FROM e JOIN c USING (doc_id))
  SELECT query_id, sub_no, strategy, doc_id, score, rank FROM l QUALIFY head = '' OR row_number() OVER (PARTITION BY query_id, head ORDER BY sub_no, rank) = 1""")
def _(spark, sf):
    """Compound questions are taken apart, every part is classified and routed, and the parts' results are one list, the
    first of equal beginnings kept."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", " "), " +", " ")), " ")
    w = lambda i: F.get(words, i)
    about = F.concat(F.lit("tell me about "), w(1), F.lit(" "), w(2), F.lit(", "), w(4), F.lit(" "), w(5), F.lit("?"))
    put = questions(spark, sf).withColumn("text", F.when(F.col("query_id") % 3 == 0, about).otherwise(F.col("text")))
    parts = Q.decompose(put).select((F.col("query_id") * 10 + F.col("sub_no")).alias("query_id"), "text", F.col("query_id").alias("vid"))
    plain = F.regexp_replace("text", "[^\\x00-\\x7F]", "x")
    asked = with_vectors(spark, sf, parts, F.col("vid")).withColumns({"intent": C.score_intents(plain, INTENTS, SEED)["intent"], "scope": C.scope_of(F.col("text"), [r"\ball\b"])})
    table = spark.createDataFrame([(i, *x) for i, x in ROUTED_BY.items()], "intent string, lang string, n_top int, n_all int")
    docs = corpus(spark, sf)
    found = W.route(asked, docs, table, active_domains(asked), "lang", 6).join(docs.select("doc_id", F.substring("text", 1, 100).alias("head")), "doc_id")
    whole = found.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("sub_no"), "strategy", "doc_id", "score", "rank", "head")
    return R.keep_first(whole, [F.col("query_id"), F.col("head")], [F.asc("sub_no"), F.asc("rank")]).select("query_id", "sub_no", "strategy", "doc_id", "score", "rank")


#: Every intent with the strategies that are tried for it, in order; six kinds of question, by number.
CHAINS = {"course": ["code", "source"], "money": ["two_sources"], "office": ["trigger", "source"], "people": ["people_in_department", "people"], "program": ["program"]}
KINDS = ["course", "money", "office", "people", "program", "general"]
TRIGGERS = [(0, "zz", "rare"), (1, "erha", "office"), (2, "tien", "office"), (3, "ung", "chair")]


@query("route_all", f"""WITH {CORPUS}, w AS (SELECT item_id, text, string_split(trim(regexp_replace(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM benchmark),
  q AS (SELECT item_id AS query_id, item_id % 6 AS kind, CASE item_id % 6 WHEN 0 THEN 'PT ' || item_id * 7 || ' ' || text WHEN 4 THEN coalesce(p_name, text) ELSE text END AS text, item_id AS vid, lower(w[2]) AS topic, n_name AS department
    FROM w LEFT JOIN part ON p_partkey = item_id * 3 LEFT JOIN nation ON n_nationkey = item_id % 25),
  code AS (SELECT query_id, 'code' AS strategy, p_partkey::VARCHAR AS key, 1.0::DOUBLE AS score, 1 AS rank FROM q JOIN part ON p_partkey = query_id * 7 WHERE kind = 0),
  k(no, trigger, target) AS (VALUES {", ".join(f"({n}, '{t}', '{x}')" for n, t, x in TRIGGERS)}), m AS (SELECT query_id, target, min(no) AS no FROM q JOIN k ON contains(lower(text), trigger) WHERE kind = 2 GROUP BY ALL),
  trig AS (SELECT query_id, 'trigger', target, 1.0::DOUBLE, CAST(row_number() OVER (PARTITION BY query_id ORDER BY no, target) AS INT) FROM m),
  pr AS (SELECT query_id, 'program', p_partkey::VARCHAR, 1.0::DOUBLE, 1 FROM q JOIN (SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name) p ON lower(p_name) = lower(trim(q.text)) WHERE kind = 4),
  st AS (SELECT s_suppkey AS person, s_name AS name, n_name AS of, lower(coalesce(text, '')) AS research FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN documents ON doc_id = s_suppkey),
  hp AS (SELECT query_id, person, name, department = of AS own FROM q JOIN st ON contains(research, topic) WHERE kind = 3 AND length(topic) > 0),
  pd AS (SELECT query_id, 'people_in_department', person::VARCHAR, 1.0::DOUBLE, CAST(row_number() OVER (PARTITION BY query_id ORDER BY person) AS INT) AS rank FROM (SELECT query_id, min(person) AS person FROM hp WHERE own GROUP BY query_id, lower(name)) QUALIFY rank <= 3),
  pa AS (SELECT query_id, 'people', person::VARCHAR, 1.0::DOUBLE, CAST(row_number() OVER (PARTITION BY query_id ORDER BY person) AS INT) AS rank FROM (SELECT query_id, min(person) AS person FROM hp WHERE query_id NOT IN (SELECT query_id FROM pd) GROUP BY query_id, lower(name)) QUALIFY rank <= 3),
  a AS (SELECT query_id, text, vid, 'en' AS lang, 3 AS n FROM q WHERE kind = 0 AND query_id NOT IN (SELECT query_id FROM code) OR kind = 2 AND query_id NOT IN (SELECT query_id FROM trig)), {sql_hybrid('a', 'y', 3, True)},
  b AS (SELECT query_id * 2 + no AS query_id, text, vid, CASE no WHEN 0 THEN 'en' ELSE 'fr' END AS lang, 3 AS n FROM q, range(2) r(no) WHERE kind = 1), {sql_hybrid('b', 'z', 3, True)},
  zz AS (SELECT CAST(floor(z.query_id / 2) AS BIGINT) AS query_id, (z.query_id % 2) * 3 + rank AS before, z.doc_id FROM z),
  zs AS (SELECT zz.*, round(len(list_distinct(list_intersect({sql_tokens('q.text')}, {sql_tokens('left(c.text, 800)')}))) / greatest(1, len(list_distinct({sql_tokens('q.text')})))::DOUBLE, 6) AS score FROM zz JOIN q USING (query_id) JOIN c USING (doc_id)),
  two AS (SELECT query_id, 'two_sources', doc_id::VARCHAR, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank FROM zs QUALIFY rank <= 4),
  e AS (SELECT * FROM code UNION ALL SELECT * FROM trig UNION ALL SELECT * FROM pr UNION ALL SELECT * FROM pd UNION ALL SELECT * FROM pa UNION ALL SELECT query_id, 'source', doc_id::VARCHAR, score, rank FROM y UNION ALL SELECT * FROM two),
  o AS (SELECT query_id, text, vid FROM q WHERE query_id NOT IN (SELECT query_id FROM e)), {sql_fan_out('o', 'x')},
  g AS (SELECT query_id, doc_id, max(score) AS score FROM x GROUP BY ALL)
  SELECT * FROM e UNION ALL SELECT query_id, 'fan_out', doc_id::VARCHAR, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM g QUALIFY rank <= 6""")
def _(spark, sf):
    """One router over all strategies: a course code or else the courses' source; two sources in one re-ranked list; offices by trigger or
    else by source; people of a department or else of all; programs by name; and everything else, with all that stays unanswered, fanned
    out over the domains that it names."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", " "), " +", " ")), " ")
    parts, nations = read(spark, sf, "part"), read(spark, sf, "nation")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("query_id") % 6 + 1).cast("int"))
    put = questions(spark, sf).withColumns({"intent": kind, "topic": F.lower(F.get(words, 1))})
    put = put.join(parts.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("query_id") * 3, "left").join(nations.select("n_nationkey", F.col("n_name").alias("department")), F.col("n_nationkey") == F.col("query_id") % 25, "left")
    text = F.when(F.col("intent") == "course", F.concat(F.lit("PT "), (F.col("query_id") * 7).cast("string"), F.lit(" "), "text")).when(F.col("intent") == "program", F.coalesce("p_name", "text")).otherwise(F.col("text"))
    asked = S.stored(with_vectors(spark, sf, put.withColumn("text", text).drop("p_partkey", "p_name", "n_nationkey"), F.col("query_id")), "asked")
    docs = corpus(spark, sf)
    held = lexical.counts(asked, docs, "doc_id", "text", ["lang"])
    staff = read(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(documents(spark, sf).select("doc_id", "text"), F.col("doc_id") == F.col("s_suppkey"), "left")
    staff = staff.select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), F.col("n_name").alias("department"), F.coalesce("text", F.lit("")).alias("research"))
    catalog = parts.select("p_partkey", F.concat(F.lit("PT "), F.col("p_partkey").cast("string")).alias("code"))
    triggers = spark.createDataFrame(TRIGGERS, "trigger_no int, trigger string, target string")
    one = lambda df: df.select("query_id", F.col("p_partkey").cast("string").alias("key"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    by_document = lambda df: df.withColumn("key", F.col("doc_id").cast("string"))
    names = parts.groupBy(F.lower("p_name").alias("_name")).agg(F.max("p_partkey").alias("p_partkey"))

    def fan_out(q: DataFrame) -> DataFrame:
        found = W.fan_out(q.select("query_id", "text", "query"), docs, active_domains(q), "lang", 6, held)
        return by_document(R.top_k(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.asc("doc_id")], 6))

    def trigger(q: DataFrame) -> DataFrame:
        found = L.trigger_lookup(q.select("query_id", "text"), triggers, "").where("target != ''")
        return found.select("query_id", F.col("target").alias("key"), F.lit(1.0).alias("score"), F.col("position").alias("rank"))

    strategies = {
        "code": lambda q: one(L.lookup_code(q.select("query_id", "text"), catalog, "code", "p_partkey")),
        "source": lambda q: by_document(W.hybrid(q.select("query_id", "text", "query", F.lit("en").alias("lang"), F.lit(3).alias("n")), docs, 3, ["lang"], held=held)),
        "two_sources": lambda q: by_document(W.two_sources(q.select("query_id", "text", "query"), docs, "lang", ["en", "fr"], 3, 4, R2.overlap_score, held)),
        "trigger": trigger,
        "people_in_department": lambda q: W.people_on(q, staff, 3, True),
        "people": lambda q: W.people_on(q, staff, 3, False),
        "program": lambda q: one(q.join(names, F.lower(F.trim("text")) == F.col("_name"))),
        "fan_out": fan_out,
    }
    return W.dispatch(asked, CHAINS, strategies, "fan_out")


#: Suppliers as staff, of whom documents tell the research; a question for each nation and kind.
STAFF = "p AS (SELECT s_suppkey AS person, s_name AS name, n_name AS department, coalesce(text, '') AS research, CAST(embedding AS DOUBLE[]) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN documents ON doc_id = s_suppkey LEFT JOIN embeddings ON vec_id = s_suppkey)"
WANTED = """q AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS name, CASE WHEN n_nationkey % 4 IN (1, 2) THEN n_name END AS department, CASE WHEN n_nationkey % 4 >= 2 THEN lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')) END AS topic, n_nationkey % 4 = 1 AS complete, n_nationkey AS vid
  FROM nation LEFT JOIN benchmark ON item_id = n_nationkey)"""


@query("strategy_people", f"""WITH {STAFF}, {WANTED}, o AS (SELECT * FROM q WHERE query_id % 4 >= 2),
  a AS (SELECT query_id, person, 'name' AS strategy, 1.0::DOUBLE AS score FROM q JOIN p ON contains(lower(p.name), q.name)), b AS (SELECT query_id, person, 'department', 1.0::DOUBLE FROM q JOIN p USING (department) WHERE complete),
  n AS (SELECT query_id, person, 'vector', 1 - distance FROM (SELECT query_id, person, round(1 - list_dot_product(e.v, p.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(p.v, p.v)), 6) AS distance FROM o JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e ON e.vec_id = vid JOIN p ON p.v IS NOT NULL AND (o.department IS NULL OR o.department = p.department)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, person) <= 3),
  w AS (SELECT DISTINCT query_id, department, unnest(list_filter(regexp_split_to_array(topic, '[\\s/]+'), lambda t: length(t) > 2)) AS word FROM o),
  h AS (SELECT DISTINCT query_id, person FROM w JOIN p ON contains(lower(research), word) AND (w.department IS NULL OR w.department = p.department)), m AS (SELECT query_id, person, 'supplement', 0.5::DOUBLE FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY person) <= 10),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n UNION ALL SELECT * FROM m),
  k AS (SELECT u.*, research FROM u JOIN p USING (person) QUALIFY row_number() OVER (PARTITION BY query_id, lower(name) ORDER BY strategy = 'supplement', score DESC, person) = 1),
  r AS (SELECT query_id, person, strategy, round(score, 6) AS score, CASE WHEN topic IS NOT NULL THEN round(len(list_intersect(list_distinct(regexp_split_to_array(topic, '[\\s/]+')), regexp_split_to_array(lower(research), '[^a-z]+'))) / len(list_distinct(regexp_split_to_array(topic, '[\\s/]+')))::DOUBLE, 6) END AS share, complete FROM k JOIN q USING (query_id))
  SELECT query_id, person, strategy, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY share DESC NULLS LAST, score DESC, person) AS INT) AS rank FROM r QUALIFY rank <= CASE WHEN complete THEN 8 ELSE 3 END""")
def _(spark, sf):
    """By name, by department, or by vector and words."""
    people = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    told = documents(spark, sf).select("doc_id", F.col("text").alias("research"))
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    staff = people.join(told, F.col("doc_id") == F.col("s_suppkey"), "left").join(vectors, F.col("vec_id") == F.col("s_suppkey"), "left")
    staff = staff.select(F.col("s_suppkey").cast("long").alias("person"), F.col("s_name").alias("name"), F.col("n_name").alias("department"), F.coalesce("research", F.lit("")).alias("research"), "embedding")
    k = F.col("n_nationkey")
    topic = F.when(k % 4 >= 2, F.lower(F.regexp_replace("text", "[^A-Za-z]", " ")))
    asked = read(spark, sf, "nation").join(read(spark, sf, "benchmark"), F.col("item_id") == k, "left")
    asked = asked.select(k.cast("long").alias("query_id"), F.when(k % 4 == 0, k.cast("string")).alias("name"), F.when((k % 4).isin(1, 2), F.col("n_name")).alias("department"), topic.alias("topic"), (k % 4 == 1).alias("complete"))
    return W.people(with_vectors(spark, sf, asked, F.col("query_id")), staff, 3, 8)
