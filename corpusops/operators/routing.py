"""Sending questions to sources: hybrid search per domain, routing by intent, and what is done where nothing is
found. All questions of a table are answered by the same jobs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusops.operators import lexical as L, ranking as R, vectors as V
from corpusops.operators.phrases import occurring
from corpusops.operators.rerank import rerank
from corpusops.sources.files import stored


def hybrid(questions: DataFrame, corpus: DataFrame, most: int, by: list[str] | None = None, least: float = 0.25, weights: tuple[float, float] = (0.6, 0.4), held: L.Counts | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): nearest vectors of at least that relevance and best documents by BM25, fused;
    `most` of each list and of the result, or the question's own n if that is less.

    questions: (query_id long, text, query vector[, n][, by]); corpus: (doc_id long, text, embedding[, by]). With `by`
    a question is asked of the documents of its own group only, with the statistics of that group. Blank questions find
    nothing; those without a vector are asked by their words alone. held: the documents' terms, if other searches share them."""
    by = by or []
    asked = questions.where(F.trim("text") != "")
    near = V.knn(asked.select("query_id", "query", *by), corpus.select(F.col("doc_id").alias("vec_id"), "embedding", *by), most, same=by)
    near = near.where(V.distance_to_score(F.col("distance")) >= least).select("query_id", F.lit(0).alias("list"), F.col("vec_id").alias("key"), "rank")
    words = L.search(asked.select("query_id", "text", *by), corpus, "doc_id", "text", most, by, held=held).select("query_id", F.lit(1).alias("list"), F.col("doc_id").alias("key"), "rank")
    fused = R.fuse(near.unionByName(words), list(weights)).withColumn("score", F.round("score", 9))
    ranked = R.top_k(fused, ["query_id"], [F.desc("score"), F.asc("first_list"), F.asc("first_rank")], most)
    if "n" in questions.columns:
        ranked = ranked.join(questions.select("query_id", "n"), "query_id").where("rank <= n")
    return ranked.select("query_id", F.col("key").alias("doc_id"), "score", "rank")


def fan_out(questions: DataFrame, corpus: DataFrame, active: DataFrame, domain: str, most: int, held: L.Counts | None = None) -> DataFrame:
    """(query_id, domain, doc_id, score, rank): hybrid search of each question in each of its active domains; a question
    that finds nothing there is asked of the whole corpus, where its domain is null.

    active: (query_id, domain, n), n being the most results of the question in the domain."""
    held = held or L.counts(questions, corpus, "doc_id", "text", [domain])
    pairs = questions.join(active, "query_id").withColumn("_ask", F.struct("query_id", domain))
    numbered = stored(pairs.select(F.monotonically_increasing_id().alias("_no"), "query_id", domain, "n", "text", "query"), "asked")
    found = hybrid(numbered.select(F.col("_no").alias("query_id"), domain, "n", "text", "query"), corpus, most, [domain], held=held)
    named = numbered.select(F.col("_no").alias("_of"), F.col("query_id").alias("_query"), domain)
    first = stored(found.join(named, F.col("query_id") == F.col("_of")).select(F.col("_query").alias("query_id"), domain, "doc_id", "score", "rank"), "found")
    open_ = questions.join(first, "query_id", "left_anti")
    most_of = active.groupBy("query_id").agg(F.max("n").alias("n"))
    again = open_.join(most_of, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(most)))
    rest = hybrid(again, corpus, most, held=held)
    return first.unionByName(rest.select("query_id", F.lit(None).cast(first.schema[domain].dataType).alias(domain), "doc_id", "score", "rank"))


def route(questions: DataFrame, corpus: DataFrame, table: DataFrame, active: DataFrame, domain: str, most: int) -> DataFrame:
    """(query_id, strategy, doc_id, score, rank): each question by the source that the routing table gives its intent,
    with the number of results of its scope; intents without a row, and questions of which the source has nothing,
    fan out over their active domains.

    questions: (query_id, intent, scope, text, query); table: (intent, domain, n_top, n_all)."""
    sent = questions.join(F.broadcast(table), "intent").withColumn("n", F.when(F.col("scope") == "complete_list", F.col("n_all")).otherwise(F.col("n_top")))  # a row per intent
    held = L.counts(questions, corpus, "doc_id", "text", [domain])
    direct = hybrid(sent.select("query_id", "text", "query", "n", domain), corpus, most, [domain], held=held)
    first = stored(direct.select("query_id", F.lit("source").alias("strategy"), "doc_id", "score", "rank"), "routed")
    open_ = questions.join(first, "query_id", "left_anti").select("query_id", "text", "query")
    rest = fan_out(open_, corpus, active.join(open_.select("query_id"), "query_id", "left_semi"), domain, most, held)
    order = [F.desc("score"), F.asc("doc_id")]
    # what several domains find is one list
    merged = R.top_k(rest.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), ["query_id"], order, most)
    return first.unionByName(merged.select("query_id", F.lit("fan_out").alias("strategy"), "doc_id", "score", "rank"))


Strategy = Callable[[DataFrame], DataFrame]


def dispatch(questions: DataFrame, chains: Mapping[str, Sequence[str]], strategies: Mapping[str, Strategy], otherwise: str) -> DataFrame:
    """(query_id, strategy, key, score, rank): each question by the strategies that chains names for its intent, one after the other until
    one of them answers it; questions that none answers, and those of other intents, go to the strategy `otherwise`.

    questions: (query_id, intent, ...); a strategy is a function of questions to (query_id, key string, score, rank). It is asked once a
    place in the chains, of all questions that come to it there; what it finds is stored, and only the rest goes on."""
    named = lambda name, asked: strategies[name](asked).select("query_id", F.lit(name).alias("strategy"), "key", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
    open_, every = questions, None
    for place in range(max(map(len, chains.values()), default=0)):
        here: dict[str, list[str]] = {}
        for intent, names in chains.items():
            if len(names) > place:
                here.setdefault(names[place], []).append(intent)
        found = stored(reduce(DataFrame.unionByName, [named(name, open_.where(F.col("intent").isin(intents))) for name, intents in here.items()]), "answered")
        every = found if every is None else every.unionByName(found)
        open_ = open_.join(found.select("query_id").distinct(), "query_id", "left_anti")
    rest = named(otherwise, open_)
    return rest if every is None else every.unionByName(rest)


def two_sources(questions: DataFrame, corpus: DataFrame, domain: str, domains: Sequence[str], each: int, most: int, scorer: Callable[[Column, Column], Column], held: L.Counts | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the `each` best of every domain, in one list by the scorer of question and passage, then by
    the order of domains and ranks; `most` stay. questions: (query_id, text, query vector)."""
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("_no"), F.lit(d).alias(domain)) for i, d in enumerate(domains)])).alias("_d")
    asked = questions.select("query_id", "text", "query", named).select((F.col("query_id") * len(domains) + F.col("_d._no")).alias("query_id"), "text", "query", F.lit(each).alias("n"), f"_d.{domain}")
    found = hybrid(asked, corpus, each, [domain], held=held).select(F.floor(F.col("query_id") / len(domains)).alias("query_id"), ((F.col("query_id") % len(domains)) * each + F.col("rank")).cast("int").alias("rank"), "doc_id")
    found = stored(found, "found")  # as a table of known size it goes to the texts, if it is small
    passages = found.join(corpus.select("doc_id", F.col("text").alias("passage")), "doc_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    return rerank(passages, scorer, most=len(domains) * each).where(F.col("rank") <= most).select("query_id", "doc_id", F.col("rerank_score").alias("score"), "rank")


def people_on(questions: DataFrame, staff: DataFrame, most: int, within: bool) -> DataFrame:
    """(query_id, key, score, rank): people whose research holds the question's topic, one of each name, the first by number; of
    the question's department only if `within`, where questions without one find nobody. questions: (query_id, department, topic)."""
    asked = questions.where(F.length("topic") > 0).select("query_id", "department", "topic")
    held = staff_holding(asked, staff, "topic", "research")
    held = held.where(F.col("department") == F.col("of")) if within else held
    named = R.keep_first(held.join(staff.select("person", "name"), "person"), [F.col("query_id"), F.lower("name")], [F.asc("person")])
    return R.top_k(named, ["query_id"], [F.asc("person")], most).select("query_id", F.col("person").cast("string").alias("key"), F.lit(1.0).alias("score"), "rank")


def people(questions: DataFrame, staff: DataFrame, few: int, many: int) -> DataFrame:
    """(query_id, person, strategy, score, rank) of questions (query_id, name, department, topic, complete, query).

    By name where only a name is given; all of a department where only that is asked for, completely; else the
    nearest by vector (in the department, if there is one), supplemented by those whose research holds a word of the
    topic, at score 0.5. Then one row stays per name, and rows are ordered by the share of the topic's words that the
    research has. staff: (person, name, department, research, embedding)."""
    most = F.when(F.col("complete"), many).otherwise(few)
    given = lambda c: F.col(c).isNotNull()
    named = questions.where(given("name") & ~given("department") & ~given("topic"))
    listed = questions.where(given("department") & ~given("topic") & F.col("complete"))
    other = questions.join(named.select("query_id").unionByName(listed.select("query_id")), "query_id", "left_anti")

    by_name = staff_holding(named, staff, "name", "name").select("query_id", "person", F.lit("name").alias("strategy"), F.lit(1.0).alias("score"))
    by_group = listed.select("query_id", "department").join(staff, "department").select("query_id", "person", F.lit("department").alias("strategy"), F.lit(1.0).alias("score"))
    vectors = staff.select(F.col("person").alias("vec_id"), "embedding", F.lit("").alias("department")).unionByName(staff.select(F.col("person").alias("vec_id"), "embedding", "department"))
    near = V.knn(other.select("query_id", "query", F.coalesce("department", F.lit("")).alias("department")), vectors, many, same=["department"])
    near = near.join(other.select("query_id", most.alias("n")), "query_id").where("rank <= n").select("query_id", F.col("vec_id").alias("person"), F.lit("vector").alias("strategy"), V.distance_to_score(F.col("distance")).alias("score"))
    words = other.where(given("topic")).select("query_id", "department", F.explode(F.array_distinct(F.filter(F.split(F.lower("topic"), r"[\s/]+"), lambda t: F.length(t) > 2))).alias("word"))
    holds = staff_holding(words, staff, "word", "research").where(F.col("department").isNull() | (F.col("department") == F.col("of")))
    more = R.top_k(holds.select("query_id", "person").distinct(), ["query_id"], [F.asc("person")], 10).select("query_id", "person", F.lit("supplement").alias("strategy"), F.lit(0.5).alias("score"))
    every = by_name.unionByName(by_group).unionByName(near).unionByName(more).join(staff.select("person", "name", "research"), "person")
    first = R.keep_first(every.withColumn("_late", F.col("strategy") == "supplement"), [F.col("query_id"), F.lower("name")], [F.asc("_late"), F.desc("score"), F.asc("person")])
    topic = first.join(questions.select("query_id", "topic", most.alias("n")), "query_id")
    asked = F.array_distinct(F.split(F.lower("topic"), r"[\s/]+"))
    share = F.when(given("topic"), F.size(F.array_intersect(asked, F.split(F.lower("research"), r"[^a-z]+"))) / F.size(asked))
    ranked = R.top_k(topic.withColumn("share", F.round(share, 6)), ["query_id"], [F.desc_nulls_last("share"), F.desc("score"), F.asc("person")], many)
    return ranked.where("rank <= n").select("query_id", "person", "strategy", F.round("score", 6).alias("score"), "rank")


def staff_holding(asked: DataFrame, staff: DataFrame, term: str, field: str) -> DataFrame:
    """asked (query_id, term, ...) with the person, and the person's department as `of`, whose field holds the term."""
    rows = staff.select("person", F.col("department").alias("of"), F.lower(field).alias("_value"))
    low = asked.withColumn("_term", F.lower(term))
    return low.join(occurring(rows, low, "_value", "_term", ["person", "of"]), "_term").drop("_term")
