"""What the findings of round 3 were about, on small tables that hold it."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusops.operators import catalog, lexical, ranking, scoring, standing
from corpusops.plans import streams
from corpusops.queries import ORACLE, QUERIES
from corpusops.sources import files, html
from corpusops.streaming import admission, ordered
from tests.test_oracle import rows
from tests.test_states_and_indexes import FEW, at, plain_gate, stream_of


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL agree on given tables: name to rows and schema."""

    def check(name, **tables):
        db = duckdb.connect()
        for table, (values, schema) in tables.items():
            spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)), db.execute(ORACLE[name])
        found = got.collect()
        assert rows(got.columns, found) == rows([c[0] for c in want.description], want.fetchall())
        return found

    return check


DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["failures", "grade_scores", "rollup_scores"])
def test_documents_of_any_length_have_scores(same, name):
    docs = [(i, "x" * n, "de", "web", n) for i, n in enumerate([12, 13, 14, 4000])]
    assert same(name, documents=(docs, DOCUMENTS), labels=([(i, 1, 0) for i in range(4)], LABELS))


def test_entities_without_semicolon_are_resolved(same):
    pages = [(1, "u", "<body><article><h1>a&amp;&amp</h1><p>b &amp;lt c&nbsp&copy d&am</p></article></body>")]
    same("main_text", pages=(pages, "page_id long, url string, html string"))


def test_items_keep_the_digit_of_their_place(spark, same):
    text = F.lit("at 100 words and more\nat 101 words and more 1\n22 words and many more 2")
    assert [r.x for r in spark.range(1).select(F.explode(html.outcome_items(text)).alias("x")).collect()] == ["at 100 words and more", "at 101 words and more 1", "22 words and many more 2"]
    same("outcome_items", documents=([(1, "0 first item of the list 0\n1 second item of the list 1", "en", "web", 9), (2, "first item of some list 0\nsecond item of some list 1", "en", "web", 9)], DOCUMENTS))


@pytest.fixture
def met(monkeypatch):
    """Rows that catalogue searches rank."""
    counts, rank = [], catalog.top_k

    def counted(df, *rest, **more):
        counts.append(df.count())
        return rank(df, *rest, **more)

    monkeypatch.setattr(catalog, "top_k", counted)
    return counts


def test_equal_questions_and_programs_meet_once(spark, met):
    programs = spark.range(900).selectExpr("id AS key", "concat('Steel Work ', id % 3) AS name", "'masters' AS level", "if(id % 2 = 0, 'Applied Metal', 'Other') AS outcomes")
    asked = spark.range(600).selectExpr("id AS query_id", "element_at(array('steel work 1', 'Steel-Work-2', 'work', 'applied steel?'), cast(id % 4 AS int) + 1) AS text")
    also = programs.selectExpr("replace(name, ' ', '-') AS alias", "name")
    found = catalog.search_programs(asked, programs, also, "key", 2, {"masters": ((), ("ms",))}, {"steel": (("steel",), ())}).collect()
    want = {0: [(898, 0)], 1: [(899, 1)], 2: [(0, 2)], 3: [(0, 3), (2, 3)]}
    assert sorted((r.query_id, r.rank, r.key, r.stage) for r in found) == [(q, i + 1, key, stage) for q in range(600) for i, (key, stage) in enumerate(want[q % 4])]
    assert max(met) <= 900  # pairs of questions and programs before: 150 questions of points meet 900 programs


def test_equal_rows_are_scored_once(spark, met):
    courses = spark.range(3000).selectExpr("id AS key", "concat('Title ', id % 3) AS title", "3 AS credits", "'graduate' AS level")
    asked = spark.createDataFrame([(1, "title 2 graduate"), (2, "3"), (3, "grad level")], "query_id int, text string")
    found = catalog.field_weighted_score(asked, courses, "key", {"title": 8}, 4, "credits", "level").collect()
    got = {q: [(r.key, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert got == {1: [(2, 29), (5, 29), (8, 29), (11, 29)], 2: [(0, 5), (1, 5), (2, 5), (3, 5)], 3: [(0, 5), (1, 5), (2, 5), (3, 5)]}
    assert sum(met) - 3000 < 100  # all 3000 rows are read to find equal ones, and only to that end


@pytest.fixture
def ranked(monkeypatch):
    """Rows that searches by words rank at last."""
    counts, rank = [], ranking.top_k

    def counted(df, *rest, **more):
        counts.append(df.count())
        return rank(df, *rest, **more)

    monkeypatch.setattr(lexical, "top_k", counted)
    monkeypatch.setattr(standing, "top_k", counted)
    return counts


@pytest.mark.parametrize("at_once", [scoring.AT_ONCE, 20])
def test_searches_shuffle_the_best_of_each_task_only(spark, tmp_path, monkeypatch, ranked, at_once):
    """Every question meets every document, and copies tie; several passes of questions find the same."""
    monkeypatch.setattr(scoring, "AT_ONCE", at_once)
    docs = spark.range(0, 2000, 1, 2).selectExpr("id AS doc_id", "concat('word term', id % 7, ' term', id % 3, repeat(' more', cast(id % 4 AS int))) AS text")
    asked = spark.range(40).selectExpr("struct(id AS a, 0 AS b) AS query_id", "concat('word term', id % 7) AS text")
    every = lexical.bm25(asked, docs, "doc_id", "text").withColumn("score", F.round("score", 6))
    want = sorted(map(str, ranking.top_k(every, ["query_id"], [F.desc("score"), F.asc("doc_id")], 3).select("query_id", "doc_id", "score", "rank").collect()))
    index = standing.Index.build(docs, "doc_id", "text", str(tmp_path / "index"), folders=2)
    for found in (lexical.search(asked, docs, "doc_id", "text", 3), index.search(asked, 3)):
        assert sorted(map(str, found.select("query_id", "doc_id", "score", "rank").collect())) == want
    assert len(want) == 120 and max(ranked) <= 120 * 8  # 80,000 pairs before


def test_plain_pages_are_read_as_the_parser_reads_them():
    class Parser(html.Reader):
        def plain(self, page):
            return False

    rng, taken = random.Random(3), 0
    bits = ["<p>", "</p>", "<BR>", "<td class='a&amp;b'>", '<A HREF="x" title="">', "</td>", "text &amp b", " ", "&lt;x&#62; y", "\n", "<br/>", "a > b", "<!-- c -->", "<script>", "</script>", "<title>", "</p x='1'>", "<1", "<p\tx='1'>", "&", "<p x='1'y='2'>", "</ p>"]
    for i in range(4000):
        page = "".join(rng.choices(bits[:10] if i % 2 else bits, k=rng.randrange(12)))
        got, want = html.Reader(page), Parser(page)
        assert got.events == want.events, page
        taken += not got.rawdata and html.Reader.plain(html.Reader(""), page)
    assert taken >= 2000


def test_stream_state_is_that_of_parcels(spark, tmp_path, monkeypatch):
    """What a batch asks of the state store, and the stores it opens, grow neither with keys nor with the session's partitions."""
    monkeypatch.setattr(ordered, "PARCELS", 3, raising=False)
    rng = random.Random(1)
    batches = [[(rng.randrange(n * 3000, n * 3000 + 3000), f"u{rng.randrange(150)}", n * 1000 + i) for i in range(400)] for n in range(3)]
    stream = stream_of(spark, tmp_path, [[(at(t), k, i) for t, k, i in batch] for batch in [*batches, [(90_000, None, -1)]]])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        query = ordered.to_files(admission.stream_admit(stream, "who", "ts", "id", FEW, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination(300)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: r.reason for r in got} == plain_gate([(t, k, i, 0) for batch in batches for t, k, i in batch]) and len(got) == 1200
    state = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(s["customMetrics"]["rocksdbPutCount"] for s in state) < 100
    assert {s["numShufflePartitions"] for s in state} == {12}


def test_searches_of_one_router_count_documents_once(spark, monkeypatch):
    calls, count = [], lexical.counted
    monkeypatch.setattr(lexical, "counted", lambda *a: calls.append(a) or count(*a))
    got = QUERIES["route_all"](spark, "/root/testdata/sf0.001").collect()
    assert {r.strategy for r in got} >= {"two_sources", "source", "fan_out"}
    assert len(calls) == 1


def test_searches_of_shared_counts_find_the_same(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, f"w{i % 5} w{i % 3} tail" if i % 4 else None) for i in range(40)], "doc_id long, lang string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w1", "a"), (2, "tail none", "b"), (3, "", "a"), (4, None, "b")], "query_id long, text string, lang string")
    held = lexical.counts(asked, docs, "doc_id", "text", ["lang"])
    for some, by in ((asked.where("query_id < 2"), ["lang"]), (asked, ["lang"]), (asked.drop("lang"), ["lang"]), (asked.drop("lang"), [])):
        alone, shared = (sorted(map(str, lexical.search(some, docs, "doc_id", "text", 4, by, held=h).collect())) for h in (None, held))
        assert alone == shared and alone
    with pytest.raises(ValueError, match="not counted"):
        lexical.search(asked.withColumn("text", F.lit("other")), docs, "doc_id", "text", 4, held=held)
    assert lexical.counts(asked.where("query_id > 2"), docs, "doc_id", "text") is None


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_batches_are_read_one_by_one_however_few_rows_they_have(same):
    """Ten requests on days 0 to 29, so that some batches have fewer rows than files, or none."""
    days = [0, 7, 13, 1, 5, 27, 2, 29, 28, 9]
    events = [(i, at(-60 * 86_400 + d * 86_400 + i), i % 2, "view", 1.0, None) for i, d in enumerate(days)]
    assert any(r.late for r in same("stream_admit_late", events=(events, EVENTS)))
    assert all(r.allowed is not None for r in same("stream_admit", events=(events, EVENTS)))


def test_large_batches_come_in_as_many_files_as_cores(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILES", 1)
    monkeypatch.setattr(streams, "ROWS", 10, raising=False)
    rows = spark.range(600).selectExpr("id AS event_id", "id % 9 AS user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts")
    stream = streams.arriving(rows, F.pmod("event_id", F.lit(6)), streams.end(13))
    query = stream.writeStream.format("noop").option("checkpointLocation", files.shared_folder(spark, "noop")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    sizes = [p["numInputRows"] for p in query.recentProgress]
    assert sizes == [104] * 6 + [1]  # in four files, each with a row of its own
