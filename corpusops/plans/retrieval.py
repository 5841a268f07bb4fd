"""Queries on lexical and vector retrieval, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.functions import text as T
from corpusops.operators import evaluation as E, lexical as L, ranking as R, rerank as R2, vectors as V
from corpusops.operators.standing import Index
from corpusops.plans.registry import query, read
from corpusops.sources.files import exists, shared_folder, spread, state_of

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([{STOP}], t))"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents"))


# --- lexical ------------------------------------------------------------------------------------------

#: This application's standing indexes, by what their documents were when they were built.
_standing: dict[tuple, Index] = {}


def standing(spark: SparkSession, sf: str) -> Index:
    """The index over the documents of a folder, built when it is first asked for, and again when their files change or it is gone."""
    name = (spark.sparkContext.applicationId, sf, state_of(spark, f"{sf}/documents.parquet"))
    if name not in _standing or not exists(spark, _standing[name].path):
        _standing[name] = Index.build(documents(spark, sf), "doc_id", "text", shared_folder(spark, "index"))
    return _standing[name]


TOKENS = f"WITH d AS (SELECT doc_id, source, text, {sql_tokens('text')} AS tokens FROM documents),"


@query("tokenize", f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS INT) AS n_tokens, md5(array_to_string({sql_tokens('text')}, ' ')) AS tokens FROM documents")
def _(spark, sf):
    tokens = T.tokenize(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.concat_ws(" ", tokens)).alias("tokens"))


@query("postings", f"{TOKENS} p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM d) SELECT doc_id, term, CAST(length AS INT) AS length, count(*) AS tf FROM p GROUP BY ALL")
def _(spark, sf):
    return L.postings(documents(spark, sf), "doc_id", "text").select("doc_id", "term", "length", "tf")


IDF = "ln((n_docs - df + 0.5) / (df + 0.5) + 1)"


@query("term_idf", f"{TOKENS} p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f")
def _(spark, sf):
    docs = documents(spark, sf)
    stats = L.statistics(docs, "text").select("n_docs")
    return L.frequencies(L.postings(docs, "doc_id", "text")).crossJoin(F.broadcast(stats)).select("term", "df", F.round(L.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_sql(by: str = "", k: int = 5) -> str:
    comma, on = (f"{by}, ", f" AND p.{by} = f.{by}") if by else ("", "")
    stats = f"JOIN (SELECT {by}, count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d GROUP BY {by}) s ON p.{by} = s.{by}" if by else "CROSS JOIN (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d) s"
    pby = f"p.{by}, " if by else ""
    return f"""{TOKENS}
      p AS (SELECT {comma}doc_id, len(tokens) AS length, unnest(tokens) AS term FROM d),
      t AS (SELECT {comma}doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
      f AS (SELECT {comma}term, count(*) AS df FROM t GROUP BY ALL),
      q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
      b AS (SELECT query_id, {pby}doc_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
            FROM t p JOIN f ON p.term = f.term{on} {stats} JOIN q ON q.term = p.term GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id{', ' + by if by else ''} ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0),
      bm25 AS (SELECT query_id, {comma}doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k})"""


@query("bm25_top5", bm25_sql() + " SELECT * FROM bm25")
def _(spark, sf):
    return standing(spark, sf).search(questions(spark, sf), 5).select("query_id", "doc_id", "score", "rank")


@query("bm25_scan", bm25_sql() + " SELECT * FROM bm25")
def _(spark, sf):
    """The same without an index, in one pass over the documents."""
    return L.search(questions(spark, sf), documents(spark, sf), "doc_id", "text", 5).select("query_id", "doc_id", "score", "rank")


@query("bm25_blocks", f"""{TOKENS} p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM d), q AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark)
  SELECT query_id, count(DISTINCT p.term) AS n_terms, true AS some_opened, true AS no_more_than_there_are FROM q JOIN p USING (term) GROUP BY query_id""")
def _(spark, sf):
    """Blocks of the index that belong to a question's terms, and how many of them its search opens, held against the terms found in the documents."""
    index, asked = standing(spark, sf), questions(spark, sf)
    blocks = index.skipped(asked, 5)
    terms = index.terms(asked).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return blocks.join(terms, "query_id").select("query_id", "n_terms", (F.col("n_opened") > 0).alias("some_opened"), (F.col("n_opened") <= F.col("n_blocks")).alias("no_more_than_there_are"))


@query("bm25_by_source", bm25_sql("source", 3) + " SELECT * FROM bm25")
def _(spark, sf):
    return L.search(questions(spark, sf), documents(spark, sf), "doc_id", "text", 3, ["source"]).select("query_id", "source", "doc_id", "score", "rank")


@query("top_k_parts", "SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 10")
def _(spark, sf):
    return R.top_k(read(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 10).select("p_brand", "p_partkey", "p_retailprice", "rank")


# --- vectors ------------------------------------------------------------------------------------------

COS = "round(1 - list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 6)"
VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"


def knn_sql(on: str = "true", k: int = 5, distance: str = COS) -> str:
    return f"""{VEC} m AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS query_label, {distance} AS distance FROM v q JOIN v c ON {on} WHERE q.vec_id % 100 = 0),
      knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM m) WHERE rank <= {k})"""


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions are the vectors of every hundredth id."""
    rows = read(spark, sf, "embeddings")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label"), rows


@query("knn_cosine", knn_sql() + " SELECT query_id, vec_id, distance, rank FROM knn")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    return V.knn(asked.drop("label"), rows, 5).select("query_id", "vec_id", "distance", "rank")


@query("knn_blocks", knn_sql() + " SELECT query_id, vec_id, distance, rank FROM knn")
def _(spark, sf):
    """knn where questions count as many: the corpus lies in parts, past which they stream."""
    asked, rows = vectors(spark, sf)
    return V.knn(asked, rows, 5, few=4, part=128).select("query_id", "vec_id", "distance", "rank")


@query("knn_l2", knn_sql(distance="round(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6)") + " SELECT query_id, vec_id, distance, rank FROM knn")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    return V.knn(asked.drop("label"), rows, 5, "l2").select("query_id", "vec_id", "distance", "rank")


@query("knn_filtered", knn_sql("q.label = c.label") + " SELECT query_id, vec_id, distance, rank FROM knn")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    return V.knn(asked, rows, 5, same=["label"]).select("query_id", "vec_id", "distance", "rank")


@query("knn_postfiltered", knn_sql(k=100) + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM knn WHERE label = query_label) SELECT query_id, vec_id, distance, CAST(place AS INT) AS rank FROM k WHERE place <= 5")
def _(spark, sf):
    """Over-fetch, then filter: fewer than five may be left."""
    asked, rows = vectors(spark, sf)
    found = V.knn(asked.drop("label"), rows, min(400, 20 * 5)).join(rows.select("vec_id", "label"), "vec_id").join(asked.select("query_id", F.col("label").alias("query_label")), "query_id")
    return R.top_k(found.where("label = query_label"), ["query_id"], [F.asc("rank")], 5, "place").select("query_id", "vec_id", "distance", F.col("place").alias("rank"))


@query("min_relevance", knn_sql(k=20) + " SELECT query_id, vec_id, round(1 - distance, 6) AS relevance FROM knn WHERE 1 - distance >= 0.25")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    scored = V.knn(asked.drop("label"), rows, 20).withColumn("relevance", V.distance_to_score(F.col("distance")))
    return scored.where("relevance >= 0.25").select("query_id", "vec_id", F.round("relevance", 6).alias("relevance"))


@query("distance_scores", knn_sql(k=3) + " SELECT query_id, vec_id, round(1 - distance, 6) AS cosine_score, round(1 / (1 + distance), 6) AS inverse_score FROM knn")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    d = F.col("distance")
    return V.knn(asked.drop("label"), rows, 3).select("query_id", "vec_id", F.round(V.distance_to_score(d), 6).alias("cosine_score"), F.round(V.distance_to_score(d, "inverse"), 6).alias("inverse_score"))


@query("verified_top1", knn_sql("q.vec_id <> c.vec_id", 1) + """, n AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+')) AS name, lower(text) AS text FROM documents)
  SELECT knn.query_id, vec_id, distance FROM knn JOIN n a ON a.doc_id = query_id JOIN n b ON b.doc_id = vec_id WHERE contains(b.text, a.name)""")
def _(spark, sf):
    """The nearest other vector counts only if the asked name (the first word of the question's document) is in the found
    document."""
    asked, rows = vectors(spark, sf)
    first = R.top_k(V.knn(asked.drop("label"), rows, 2).where("query_id != vec_id"), ["query_id"], [F.asc("rank")], 1, "place")
    names = documents(spark, sf).select(F.col("doc_id").alias("query_id"), F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("name"))
    return V.verified(first.join(names, "query_id"), documents(spark, sf).select(F.col("doc_id").alias("vec_id"), "text"), "name", "text").select("query_id", "vec_id", "distance")


@query("centroid_intent", """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
  s AS (SELECT vec_id, c.label AS intent, round(list_dot_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(c, c)), 6) AS score FROM embeddings, c),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, intent) AS n FROM s)
  SELECT vec_id, CASE WHEN score >= 0.45 THEN intent END AS intent, score FROM r WHERE n = 1""")
def _(spark, sf):
    rows = read(spark, sf, "embeddings")
    middle = V.centroids(rows, "label", "embedding")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e, c = F.col("embedding").cast("array<double>"), F.col("centroid")
    score = F.round(dot(e, c) / F.sqrt(dot(e, e) * dot(c, c)), 6)
    met = rows.select("vec_id", "embedding").crossJoin(F.broadcast(middle)).select("vec_id", F.col("label").alias("intent"), score.alias("score"))  # one row per label
    best = met.groupBy("vec_id").agg(F.max(F.struct("score", (-F.col("intent")).alias("neg"))).alias("best"))
    return best.select("vec_id", F.when(F.col("best.score") >= 0.45, -F.col("best.neg")).alias("intent"), F.col("best.score").alias("score"))


# --- fusion -------------------------------------------------------------------------------------------


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists per question: BM25 over all terms, and over the question's longest words. One search
    answers both, so the corpus is read once."""
    asked = questions(spark, sf)
    long_ = F.concat_ws(" ", F.filter(T.tokenize(F.col("text")), lambda t: F.length(t) > 5))
    both = asked.select("query_id", F.inline(F.array(F.struct(F.lit(0).alias("list"), "text"), F.struct(F.lit(1).alias("list"), long_.alias("text")))))
    found = standing(spark, sf).search(both.select(F.struct("query_id", "list").alias("query_id"), "text"), 10)
    return found.select("query_id.query_id", "query_id.list", F.col("doc_id").alias("key"), "rank")


RRF = bm25_sql(k=10) + f""",
  q2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter({sql_tokens('text')}, lambda t: length(t) > 5)) AS term FROM benchmark) GROUP BY ALL),
  b2 AS (SELECT query_id, doc_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
         FROM t p JOIN f ON p.term = f.term CROSS JOIN (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d) s JOIN q2 q ON q.term = p.term GROUP BY ALL),
  r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b2 WHERE score > 0) WHERE rank <= 10),
  u AS (SELECT query_id, doc_id AS key, 0 AS list, rank, 0.6::DOUBLE / (60 + rank) AS share FROM bm25 UNION ALL SELECT query_id, doc_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM r2),
  g AS (SELECT query_id, key, round(sum(share), 9) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY ALL),
  rrf AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS rank FROM g)"""


@query("rrf", RRF + " SELECT query_id, key, score, rank FROM rrf WHERE rank <= 5")
def _(spark, sf):
    fused = R.fuse(lists(spark, sf), [0.6, 0.4]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, ["query_id"], [F.desc("score"), F.asc("first_list"), F.asc("first_rank")], 5).select("query_id", "key", "score", "rank")


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and documents of one id stand for each other; a document's whole text is the question."""
    asked, rows = vectors(spark, sf)
    docs = documents(spark, sf)
    near = V.knn(asked.drop("label"), rows, 11).where("query_id != vec_id")
    near = R.top_k(near, ["query_id"], [F.asc("rank")], 10, "place").where(V.distance_to_score(F.col("distance")) >= 0.25).select("query_id", F.col("vec_id").alias("key"), F.col("place").alias("rank"))
    said = docs.join(asked.select("query_id"), F.col("doc_id") == F.col("query_id")).select("query_id", "text")
    words = standing(spark, sf).search(said, 10).select("query_id", F.col("doc_id").alias("key"), "rank")
    fused = R.reciprocal_rank_fusion([near, words], [0.6, 0.4]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, ["query_id"], [F.desc("score"), F.asc("first_list"), F.asc("first_rank")], 5).select("query_id", "key", "score", "rank")


@query("hybrid_search", knn_sql("q.vec_id <> c.vec_id", 10) + f""", h AS (SELECT query_id, vec_id, rank FROM knn WHERE 1 - distance >= 0.25),
  d AS (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents), p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM d),
  t AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY ALL),
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest({sql_tokens('text')}) AS term FROM documents JOIN v ON doc_id = vec_id WHERE vec_id % 100 = 0) GROUP BY ALL),
  b AS (SELECT query_id, doc_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
        FROM t JOIN f USING (term) CROSS JOIN (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d) s JOIN q USING (term) GROUP BY ALL),
  l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0),
  u AS (SELECT query_id, vec_id AS key, 0 AS list, rank, 0.6::DOUBLE / (60 + rank) AS share FROM h UNION ALL SELECT query_id, doc_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM l WHERE rank <= 10),
  g AS (SELECT query_id, key, round(sum(share), 9) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY ALL)
  SELECT query_id, key, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS rank FROM g) WHERE rank <= 5""")
def _(spark, sf):
    return hybrid(spark, sf)


@query("stable_key", "SELECT page_id, CASE WHEN url <> '' AND page_id % 2 = 0 THEN 'url:' || url ELSE 'sha1:' || sha1(html) END AS key FROM pages")
def _(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"), "html", F.lit("").alias("id"))
    return rows.select("page_id", R.stable_key(["id", "url"], "html").alias("key"))


@query("multi_source", bm25_sql("source", 3) + """, m AS (SELECT query_id, source, doc_id, CASE WHEN doc_id % 3 = 0 THEN round(score * 2, 6) END AS hybrid, CASE WHEN doc_id % 3 = 1 THEN round(score * 3, 6) END AS relevance, score AS bm25 FROM bm25)
  SELECT query_id, source, doc_id, score, rank FROM (SELECT query_id, source, doc_id, coalesce(hybrid, relevance, bm25) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(hybrid, relevance, bm25) DESC, doc_id) AS INT) AS rank FROM m) WHERE rank <= 10""")
def _(spark, sf):
    """Results of several sources by the first score that each has; some have other kinds of scores."""
    found = L.search(questions(spark, sf), documents(spark, sf), "doc_id", "text", 3, ["source"]).drop("rank")
    some = lambda i, n: F.when(F.col("doc_id") % 3 == i, F.round(F.col("score") * n, 6))
    kinds = found.select("query_id", "source", "doc_id", some(0, 2).alias("hybrid"), some(1, 3).alias("relevance"), F.col("score").alias("bm25"))
    return R.merge_sources(kinds, ["hybrid", "relevance", "bm25"], "doc_id", 10).select("query_id", "source", "doc_id", "score", "rank")


@query("supplement", "SELECT p_partkey, p_name, CAST(1.0 AS DOUBLE) AS score FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_name, CAST(0.5 AS DOUBLE) FROM part WHERE p_retailprice > 1500 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 20)")
def _(spark, sf):
    part = read(spark, sf, "part")
    main = part.where("p_size < 20").select("p_partkey", "p_name", F.lit(1.0).alias("score"))
    extra = part.where("p_retailprice > 1500").select("p_partkey", "p_name", F.lit(0.5).alias("score"))
    return main.unionByName(extra.join(main.select(F.lower("p_name").alias("_name")), F.lower("p_name") == F.col("_name"), "left_anti"))


@query("keep_first", "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def _(spark, sf):
    return R.keep_first(read(spark, sf, "part"), [F.lower("p_name")], [F.asc("p_partkey")]).select("p_partkey", "p_name")


OVERLAP = f"list_unique(list_intersect({sql_tokens('q.text')}, {sql_tokens('left(d2.text, 800)')})) / greatest(1, list_unique({sql_tokens('q.text')}))::DOUBLE"


RERANKED = bm25_sql(k=20) + f""", s AS (SELECT b.query_id, b.doc_id, b.rank, round({OVERLAP}, 6) AS rerank_score FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d2 ON d2.doc_id = b.doc_id)
  SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INT) AS rank FROM s"""


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best documents of every question, with both texts."""
    asked, docs = questions(spark, sf), documents(spark, sf)
    ranked = standing(spark, sf).search(asked, 20)
    return ranked.join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id").join(asked.withColumnRenamed("text", "question"), "query_id")


@query("rerank", RERANKED)
def _(spark, sf):
    return R2.rerank(passages(spark, sf), R2.overlap_score, 20, 800).select("query_id", "doc_id", "rerank_score", "rank")


@query("rerank_batched", RERANKED)
def _(spark, sf):
    """The same by a model that scores batches of pairs of all questions and is loaded once a worker."""
    return R2.rerank(passages(spark, sf), R2.batch_scorer("overlap", R2.OverlapModel), 20, 800).select("query_id", "doc_id", "rerank_score", "rank")


# --- evaluation ---------------------------------------------------------------------------------------

# Expected of a question's results are its two longest words; the first three of five documents are results, all
# five are its context.
JUDGED = bm25_sql(k=5) + f""", w AS (SELECT query_id, list(term ORDER BY place) AS tokens FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS place FROM q) WHERE place <= 2 GROUP BY query_id),
  e AS (SELECT b.query_id, b.rank, len(list_filter(tokens, lambda x: contains(lower(text), x))) > 0 AS hit FROM bm25 b JOIN documents USING (doc_id) JOIN w USING (query_id)),
  j AS (SELECT * FROM e WHERE rank <= 3), x AS (SELECT query_id, bool_or(hit) AS context FROM e GROUP BY query_id)"""


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results and contexts of every question, judged by the question's longest words."""
    asked, docs = questions(spark, sf), documents(spark, sf)
    ranked = standing(spark, sf).search(asked, 5).join(docs.select("doc_id", "text"), "doc_id")
    sized = F.array_sort(F.transform(F.array_distinct(T.tokenize(F.col("text"))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    expected = asked.select("query_id", F.transform(F.slice(sized, 1, 2), lambda x: x["t"]).alias("tokens"))
    every = E.judge(ranked.select("query_id", "rank", "text"), expected, "text").select("query_id", "rank", "hit")
    return every.where("rank <= 3"), every.select("query_id", "hit")


@query("hit_rate", JUDGED + " SELECT query_id, coalesce(bool_or(hit), false) OR any_value(context) AS hit FROM j JOIN x USING (query_id) GROUP BY query_id")
def _(spark, sf):
    return E.hit(*judged(spark, sf))


@query("precision_at_k", JUDGED + " SELECT query_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS p_at_k FROM j WHERE rank <= 3 GROUP BY query_id")
def _(spark, sf):
    return E.precision_at_k(judged(spark, sf)[0], 3)


@query("mrr", JUDGED + " SELECT query_id, round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), CASE WHEN any_value(context) THEN 1.0 / (count(*) + 1) ELSE 0 END), 6) AS mrr FROM j JOIN x USING (query_id) GROUP BY query_id")
def _(spark, sf):
    return E.reciprocal_rank(*judged(spark, sf))


@query("ndcg_at_5", JUDGED + """, g AS (SELECT query_id, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (hit) AS hits, any_value(context) AS context FROM j JOIN x USING (query_id) GROUP BY query_id)
  SELECT query_id, round(CASE WHEN hits = 0 THEN CASE WHEN context THEN 0.5 ELSE 0 END ELSE dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM g""")
def _(spark, sf):
    return E.ndcg_at_k(*judged(spark, sf), 5)


@query("precision_recall_f1", bm25_sql(k=5) + """, w AS (SELECT doc_id % 40 AS part, count(DISTINCT doc_id) AS wanted FROM documents GROUP BY 1),
  c AS (SELECT query_id, count(*) AS found, count(*) FILTER (doc_id % 40 = query_id % 40) AS n_both FROM bm25 GROUP BY 1),
  pr AS (SELECT query_id, coalesce(n_both, 0) AS n_both, coalesce(found, 0) AS found, coalesce(wanted, 0) AS wanted FROM c FULL JOIN (SELECT item_id AS query_id, wanted FROM benchmark JOIN w ON part = item_id % 40) USING (query_id)),
  s AS (SELECT query_id, CASE WHEN found = 0 THEN 0 ELSE n_both / found::DOUBLE END AS p, CASE WHEN wanted = 0 THEN 1 ELSE n_both / wanted::DOUBLE END AS r FROM pr)
  SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s""")
def _(spark, sf):
    """A question wants the documents whose id has its remainder by 40; they are counted before they meet it."""
    asked, docs = questions(spark, sf), documents(spark, sf)
    found = standing(spark, sf).search(asked, 5).select("query_id", (F.col("doc_id") % 40 == F.col("query_id") % 40).alias("hit"))
    counts = docs.groupBy((F.col("doc_id") % 40).alias("part")).agg(F.count_distinct("doc_id").alias("w"))
    wanted = asked.join(F.broadcast(counts), F.col("query_id") % 40 == F.col("part")).select("query_id", "w")  # 40 rows
    return E.precision_recall_f1_counts(found, wanted)


@query("filter_accuracy", knn_sql(k=10) + " SELECT query_id, bool_and(label = query_label) AND NOT bool_or(label = (query_label + 1) % 10) AS ok FROM knn GROUP BY query_id")
def _(spark, sf):
    asked, rows = vectors(spark, sf)
    found = V.knn(asked.drop("label"), rows, 10).join(rows.select("vec_id", "label"), "vec_id").join(asked.select("query_id", F.col("label").alias("wanted")), "query_id")
    return E.filter_accuracy(found, F.col("label") == F.col("wanted"), F.col("label") == (F.col("wanted") + 1) % 10)


SCORES = """WITH s AS (SELECT d.doc_id, d.lang AS difficulty, d.source AS domain, quality, toxic, n_chars,
  round((quality + (1 - toxic) + least(1.0, n_chars / 3000.0) + (d.doc_id % 5) / 4.0) / 4, 6) AS composite,
  CASE WHEN regexp_matches(d.text, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0 END AS entity FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Four judge scores derived from labels and lengths, and their composite. Texts are looked at before the join, which shuffles none."""
    looked_at = documents(spark, sf).select("doc_id", "lang", "source", "n_chars", E.entity_check(F.col("text"), F.lit("[0-9]")).alias("entity"))
    rows = looked_at.join(read(spark, sf, "labels"), "doc_id")
    four = {"quality_score": F.col("quality").cast("double"), "safety": 1.0 - F.col("toxic"), "length_score": F.least(F.lit(1.0), F.col("n_chars") / 3000.0), "grounding": (F.col("doc_id") % 5) / 4.0}
    judged = rows.select("doc_id", F.col("lang").alias("difficulty"), F.col("source").alias("domain"), *[c.alias(n) for n, c in four.items()], F.round(E.composite([*four.values()]), 6).alias("composite"), "entity")
    return judged


GRADE = "CASE WHEN composite >= 0.85 THEN 'PASS' WHEN composite >= 0.65 THEN 'PARTIAL' ELSE 'FAIL' END"


@query("entity_check", SCORES + " SELECT doc_id, entity FROM s")
def _(spark, sf):
    return scores(spark, sf).select("doc_id", "entity")


@query("grade_scores", SCORES + f" SELECT doc_id, composite, {GRADE} AS grade, CASE WHEN composite >= 0.9 THEN 'A' WHEN composite >= 0.8 THEN 'B' WHEN composite >= 0.7 THEN 'C' ELSE 'D' END AS letter FROM s")
def _(spark, sf):
    c = F.col("composite")
    return scores(spark, sf).select("doc_id", "composite", E.grade(c).alias("grade"), E.letter(c).alias("letter"))


@query("rollup_scores", SCORES + f""", g AS (SELECT difficulty, domain, composite, entity, {GRADE} AS grade FROM s)
  SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS kind, coalesce(difficulty, domain, 'all') AS name, count(*) AS n, round(avg(composite), 6) AS mean,
  CAST(sum(entity) AS BIGINT) AS entity_ok, count(entity) AS entity_total, count(*) FILTER (grade = 'PASS') AS n_pass, count(*) FILTER (grade = 'PARTIAL') AS n_partial, count(*) FILTER (grade = 'FAIL') AS n_fail
  FROM g GROUP BY GROUPING SETS ((difficulty), (domain), ())""")
def _(spark, sf):
    return E.rollup(scores(spark, sf))


@query("rollup_evaluators", """WITH s AS (SELECT quality::DOUBLE AS quality_score, 1.0::DOUBLE - toxic AS safety, least(1.0, n_chars / 3000.0)::DOUBLE AS length_score, (d.doc_id % 5) / 4.0::DOUBLE AS grounding FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  u AS (UNPIVOT s ON quality_score, safety, length_score, grounding INTO NAME evaluator VALUE score) SELECT evaluator, count(*) AS n, round(avg(score), 6) AS mean FROM u GROUP BY evaluator""")
def _(spark, sf):
    return E.rollup_evaluators(scores(spark, sf), ["quality_score", "safety", "length_score", "grounding"])


@query("failures", SCORES + " SELECT doc_id, difficulty, composite FROM s WHERE composite < 0.65 OR difficulty = 'de' AND composite < 0.85")
def _(spark, sf):
    return E.failures(scores(spark, sf), ["de"]).select("doc_id", "difficulty", "composite")


@query("answer_heuristics", """WITH t AS (SELECT *, nullif(regexp_extract(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z]{4,}'), '') AS word FROM conversations),
  a AS (SELECT conv_id, coalesce(contains(lower(text), word), false) AS has, contains(lower(text), 'not') OR contains(lower(text), 'un') AS deflects, length(text) > 50 AND length(text) < 2000 AS fits FROM t WHERE role = 'assistant')
  SELECT conv_id, count(*) AS n, round(avg(has::INT), 6) AS expected_rate, round(avg((deflects AND has)::INT), 6) AS deflection_rate, round(avg(fits::INT), 6) AS length_rate FROM a GROUP BY conv_id""")
def _(spark, sf):
    """Expected of an answer is the first word of four letters of the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf, "conversations").withColumn("word", F.nullif(F.regexp_extract(F.lower(before), "[a-z]{4,}", 0), F.lit("")))
    return E.answer_heuristics(rows.where("role = 'assistant'"), ["conv_id"], F.col("text"), F.array("word"), ["not", "un"])


@query("latency_sla", "SELECT event_id, value, CASE event_type WHEN 'click' THEN 20.0 WHEN 'view' THEN 50.0 ELSE 100.0 END::DOUBLE AS bound, value <= CASE event_type WHEN 'click' THEN 20.0 WHEN 'view' THEN 50.0 ELSE 100.0 END AS ok FROM events")
def _(spark, sf):
    bounds = spark.createDataFrame([("click", 20.0), ("view", 50.0), ("purchase", 100.0), ("signup", 100.0), ("error", 100.0)], "event_type string, bound double")
    return E.within_bound(read(spark, sf, "events"), bounds, "event_type", "value").select("event_id", "value", "bound", "ok")


@query("paraphrase_consistency", JUDGED + ", h AS (SELECT query_id, coalesce(bool_or(hit), false) OR any_value(context) AS hit FROM j JOIN x USING (query_id) GROUP BY query_id) SELECT a.query_id, a.hit AND b.hit AS both_hit FROM h a JOIN h b ON b.query_id = a.query_id + 1 WHERE a.query_id % 2 = 0")
def _(spark, sf):
    """Neighbouring questions stand for two ways to put one."""
    hits = E.hit(*judged(spark, sf))
    pairs = questions(spark, sf).where("query_id % 2 = 0").select(F.col("query_id").alias("canonical"), (F.col("query_id") + 1).alias("paraphrase"))
    return E.consistent(hits, pairs).select(F.col("canonical").alias("query_id"), F.col("both").alias("both_hit"))
