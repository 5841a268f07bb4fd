"""Units of the library against plain restatements and literal cases."""

import collections
import datetime
import hashlib
import json
import math
import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusops.functions import decompose, text as T
from corpusops.operators import catalog, evaluation, lexical, limits, preprocessing, ranking, relations, vectors
from corpusops.queries import QUERIES
from corpusops.sources import files, html
from corpusops.streaming import admission

CORPUS = ["machine learning course", "deep learning and machine vision", "the history of music", "", "machine machine machine"]


def test_bm25_matches_a_restatement(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "machine learning"), (1, "music machine machine"), (2, "the of")], "query_id long, text string")
    tokens = [[t for t in re.findall("[a-z0-9]+", d) if t not in T.STOPWORDS and len(t) > 1] for d in CORPUS]
    mean = sum(map(len, tokens)) / len(tokens)
    df = collections.Counter(t for d in tokens for t in set(d))
    want = {}
    for q, text in ((0, "machine learning"), (1, "music machine machine")):
        for i, d in enumerate(tokens):
            score = sum(math.log((5 - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in text.split())
            if score > 0:
                want[q, i] = score
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(asked, docs, "doc_id", "text").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fusion_adds_repeats_and_breaks_ties_by_first_place(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "z", 1)], "query_id int, key string, rank int")
    got = {r.key: (r.score, r.first_list, r.first_rank) for r in ranking.reciprocal_rank_fusion([a, b], [0.6, 0.4]).collect()}
    assert got["x"][0] == pytest.approx(0.6 / 61 + 0.6 / 63) and got["x"][1:] == (0, 1)
    assert got["z"] == (pytest.approx(0.4 / 61), 1, 1)


def test_measures_with_contexts(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (3, 1, False), (3, 2, False)]
    df = spark.createDataFrame(rows, "query_id int, rank int, hit boolean")
    contexts = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "query_id int, hit boolean")
    ndcg = {r.query_id: r.ndcg for r in evaluation.ndcg_at_k(df, contexts, 5).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert ndcg == {1: pytest.approx((1 / math.log2(3) + 0.5) / ideal, abs=1e-6), 2: 0.0, 3: 0.5}
    assert {r.query_id: r.mrr for r in evaluation.reciprocal_rank(df, contexts).collect()} == {1: 0.5, 2: 0.0, 3: pytest.approx(1 / 3, abs=1e-6), 4: 1.0}
    assert {r.query_id: r.hit for r in evaluation.hit(df, contexts).collect()} == {1: True, 2: False, 3: True, 4: True}
    texts = spark.createDataFrame([(1, "An Apple"), (2, "pear"), (3, None)], "query_id int, text string")
    wanted = spark.createDataFrame([(1, ["fig", "APPLE"]), (2, ["fig"]), (3, ["fig"])], "query_id int, tokens array<string>")
    assert {r.query_id: r.hit for r in evaluation.judge(texts, wanted, "text").collect()} == {1: True, 2: False, 3: False}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools_accumulate(row, x, b)]
    return row[-1]


def itertools_accumulate(before, x, b):
    done = 0
    for i, y in enumerate(b):
        done = before[i] + 1 if x == y else max(before[i + 1], done)
        yield done


def test_similarity_and_correction(spark):
    pairs = [("machien", "machine"), ("lerning", "learning"), ("abc", "xyz"), ("", "a"), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", T.lcs_ratio(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[a, b] == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0) for a, b in pairs)
    words = spark.createDataFrame([("machien",), ("lerning",), ("qqqqq",), ("data",)], "w string")
    known = spark.createDataFrame([("machine",), ("learning",), ("data",)], "w string")
    assert {r.word: r.correction for r in preprocessing.correct(words, known, "w").collect()} == {"machien": "machine", "lerning": "learning"}


def test_phrases_are_expanded_once_from_the_left(spark):
    df = spark.createDataFrame([(["poli", "sci", "ml", "sci"],), (["ml"],), ([],), (["a", "b", "c"],)], "t array<string>")
    forms = {"poli sci": "political science", "ml": "machine learning", "a b": "AB", "b c": "BC"}
    got = [r.x for r in df.select(T.expand_phrases(F.col("t"), forms).alias("x")).collect()]
    assert got == [["political science", "machine learning", "sci"], ["machine learning"], [], ["AB", "c"]]


def test_codes_and_decomposition(spark):
    cases = {
        "compare EECS 168 and EECS 268 credits?": ["EECS 168 credits", "EECS 268 credits"],
        "difference between cats and dogs?": ["cats information", "dogs information"],
        "short": ["short"],
        "tell me about cats, dogs, and birds?": ["cats", "dogs", "birds"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "query_id int, text string")
    got = collections.defaultdict(list)
    for r in decompose.decompose(df).orderBy("query_id", "sub_no").collect():
        got[r.query_id].append(r.text)
    assert list(got.values()) == list(cases.values())
    df = spark.createDataFrame([("compare cats and dogs",), ("which is better tea or coffee?",), ("credits for A, B, C and D?",), ("vs. nothing",), ("what is up",)], "text string")
    assert [r.x for r in df.select(decompose.sub_questions(F.col("text")).alias("x")).collect()] == [["cats information", "dogs information"], ["tea", "coffee"], ["credits for A", "credits for B, C", "credits for D"], ["vs. nothing"], ["what is up"]]


def test_codes_synonyms_and_spelling_by_the_rules(spark):
    subjects = spark.createDataFrame([("EECS",), ("MATH",), ("PHYS",)], "subject string")
    asked = spark.createDataFrame([(1, ["EECS168", "and", "math", "127", "phys"]), (2, ["mth", "101", "zz99", "Eecs"]), (3, [])], "query_id int, tokens array<string>")
    got = {r.query_id: (r.tokens, r.codes) for r in preprocessing.detect_codes(asked, subjects).collect()}
    assert got == {1: (["EECS 168", "and", "MATH 127", "PHYS"], ["EECS 168", "MATH", "MATH 127", "PHYS"]), 2: (["MATH", "101", "zz99", "EECS"], ["MATH", "EECS"]), 3: ([], [])}
    forms = {"poli sci": "political science", "ml": "machine learning", "a b": "AB", "b c": "BC", "math": "mathematics"}
    df = spark.createDataFrame([(["Poli", "Sci", "ml", "sci"],), (["ML"],), ([],), (["a", "b", "c"],), (["math"],)], "t array<string>")
    got = [(r.e.tokens, [c.original for c in r.e.corrections]) for r in df.select(preprocessing.expand(F.col("t"), forms, ["MATH"]).alias("e")).collect()]
    assert got == [(["political", "science", "machine", "learning", "sci"], ["poli sci", "ml"]), (["ML"], []), ([], []), (["AB", "c"], ["a b"]), (["MATH"], [])]
    typed = spark.createDataFrame([(1, ["machien", "lerning", "MACHIEN", "12345", "ab", "keepme", "data"]), (2, [])], "query_id int, tokens array<string>")
    known = spark.createDataFrame([("machine",), ("learning",), ("data",), ("keeper",)], "word string")
    got = {r.query_id: (r.tokens, [c.corrected for c in r.corrections]) for r in preprocessing.correct_typos(typed, known, ["keepme"]).collect()}
    assert got == {1: (["machine", "learning", "MACHIEN", "12345", "ab", "keepme", "data"], ["machine", "learning"]), 2: ([], [])}


def test_pairs_of_letters_lose_no_similar_word(spark):
    rng = random.Random(12)
    known = sorted({"".join(rng.choices("abcd", k=rng.randrange(2, 9))) for _ in range(150)})
    typed = sorted({"".join(rng.choices("abcd", k=rng.randrange(2, 9))) for _ in range(150)} - set(known))
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "w string")
    for least in (80.0, 85.0):
        want = {}
        for a in typed:
            best = min((-200 * lcs(a, b) / (len(a) + len(b)), b) for b in known)
            if -best[0] >= least:
                want[a] = best[1]
        assert {r.word: r.correction for r in preprocessing.correct(frame(typed), frame(known), "w", least, 2).collect()} == want


def replay(rows, few):
    """A literal restatement of the limiter."""
    held, out = collections.defaultdict(list), {}
    for key, t, i in sorted(rows):
        reason = next((name for name, s, most in few if sum(x > t - s * 1_000_000 for x in held[key]) >= most), None)
        if reason is None:
            held[key].append(t)
        out[i] = reason
    return out


FEW = (("minute", 60, 2), ("hour", 3600, 5))


def requests(spark, n=600):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(0, 20_000_000_000, 5_000_000), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "who string, micros long, id int").select("who", F.timestamp_micros("micros").alias("ts"), "id")


def test_admission_equals_a_replay(spark):
    rows, df = requests(spark)
    got = {r.id: r.reason for r in limits.admit(df, "who", "ts", "id", FEW).collect()}
    assert got == replay(rows, FEW)


def test_stream_counts_equal_the_rows(spark, tmp_path):
    _, df = requests(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = admission.stream_counts(stream, "ts", "who").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 600


PAGE = """<html><head><title>T</title><script>x()</script></head><body><nav>Menu</nav><main><h1>Ann Lee</h1><p>Intro</p>
<h2>Research Interests</h2><p>graphs, logic; proofs</p><h2>Bio</h2><p>Long life.</p><a href="mailto:ann@x.edu">mail</a> 785-111-2222</main></body></html>"""
PLAN = "<table><tr><td>First Year</td></tr><tr><td>CS 1</td><td>3</td><td>CS 2</td></tr><tr><td>MA 1</td><td>3</td><td>MA 2</td></tr></table>"
SECTIONS = "<table><tr><td>LEC</td><td>Lee</td><td>123</td><td>4</td></tr><tr><td>12 students enrolled out of 30 MWF 10:00 - 10:50 AM</td></tr><tr><td>LAB</td><td>Kim</td><td>124</td><td>Full</td></tr></table>"


def test_html_extractors(spark):
    assert "Menu" not in html.main_text(PAGE) and html.main_text(PAGE).startswith("Ann Lee\nIntro")
    assert dict(html.heading_sections(PAGE))["Bio"].startswith("Long life.")
    assert html.person(PAGE) == {"name": "Ann Lee", "title": None, "email": "ann@x.edu", "phone": "785-111-2222", "office": None, "research": "graphs; logic; proofs", "biography": dict(html.heading_sections(PAGE))["Bio"]}
    assert html.person("<p>no name</p>") is None
    assert [r["fall"] for r in html.plan_rows(PLAN)] == ["CS 1", "MA 1"] and html.plan_rows(PLAN)[1]["spring"] == "MA 2"
    one, two = html.section_rows(SECTIONS)
    assert (one["seats_status"], one["enrolled"], one["most"], one["days"]) == ("open", 12, 30, "MWF") and two["seats_status"] == "full"
    assert html.cards("<div><div>Ann<br>Chair <a href='mailto:a@x.edu'>m</a></div><div>none</div></div>") == [{"name": "Ann", "title": "Chair", "email": "a@x.edu"}]
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    assert html.extract(pages, "page_id", "html", lambda h: [{"text": html.main_text(h)}], "text string").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"total": 2, "courses": [{"course_code": "A 1", "title": "x"}, {"course_code": "A 2"}]}))
    assert [r.course_code for r in files.read_wrapped_json(spark, str(tmp_path / "c.json"), "courses").collect()] == ["A 1", "A 2"]
    (tmp_path / "f.json").write_text(json.dumps({"cs": {"name": "Computing", "faculty": [{"name": "Ann"}, {"name": "Bo"}]}, "ma": {"faculty": [{"name": "Cy"}]}}))
    people = files.flatten_keyed_groups(files.read_keyed_groups(spark, str(tmp_path / "f.json")), "faculty")
    assert sorted((r.key, r.group_name, r.name) for r in people.collect()) == [("cs", "Computing", "Ann"), ("cs", "Computing", "Bo"), ("ma", "ma", "Cy")]
    for name, body in {
        "routes": "route_id,route_short_name,route_long_name,route_desc,route_color,route_url\n1,11,\"Main\",d,FF0000,u\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,0,1,0,1,0,0,20240101,20241231\n",
        "trips": "route_id,service_id\n1,s\n", "stops": "stop_id,stop_name,stop_lat,stop_lon\na,Hall,38.9,x\n",
    }.items():
        (tmp_path / f"{name}.txt").write_text(body)
    feed = files.read_gtfs(spark, str(tmp_path))
    assert feed["routes"].first().route_color == "#FF0000" and feed["calendar"].first().monday is True and feed["calendar"].first().tuesday is False
    assert (feed["stops"].first().stop_lat, feed["stops"].first().stop_lon) == (38.9, None)
    for name, n in (("s_20240101.json", 1), ("s_20240201.json", 2)):
        (tmp_path / "snap").mkdir(exist_ok=True)
        (tmp_path / "snap" / name).write_text(json.dumps({"v": n}))
    assert [r.v for r in files.latest_file(spark, str(tmp_path / "snap"), "v int").collect()] == [2]
    df = spark.range(3)
    files.rebuild_corpus(df, str(tmp_path / "corpus"))
    files.rebuild_corpus(spark.range(9), str(tmp_path / "corpus"), replace=False)
    assert files.Corpus(spark, str(tmp_path / "corpus")).read().count() == 3


def test_nearest_neighbours_of_few_and_of_many_questions(spark):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((200, 8))
    points[50:60] = points[50]
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)] + [(900, None, 0), (901, [0.0] * 8, 0)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int")
    asked = corpus.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "kind")
    vectors_of = {i: np.array(v) for i, v, _ in rows if v is not None}
    for metric, same in (("cosine", []), ("l2", []), ("cosine", ["kind"])):
        want = []
        for q in range(0, 200, 10):
            away = []
            for i, v in vectors_of.items():
                size = np.linalg.norm(v) * np.linalg.norm(vectors_of[q])
                d = ((v - vectors_of[q]) ** 2).sum() if metric == "l2" else 1 - (v @ vectors_of[q] / size if size else 0)
                if not same or q % 3 == (i % 3 if i < 900 else 0):
                    away.append((round(float(d), 6), i))
            want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(away)[:5])]
        for few, part in ((100, 50), (3, 50), (3, 7)):
            got = vectors.knn(asked.where("query_id < 200"), corpus, 5, metric, same, few, part).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    assert vectors.knn(asked.where("false"), corpus, 5).count() == 0 and vectors.knn(asked, corpus.where("false"), 5).count() == 0


def test_terms_meet_the_values_that_hold_them(spark):
    rng = random.Random(5)
    values = sorted({"".join(rng.choices("ab c", k=rng.randrange(0, 9))) for _ in range(120)})
    terms = sorted({"".join(rng.choices("ab c", k=rng.randrange(0, 6))) for _ in range(80)})
    got = catalog.holding(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted((r.value, r.term) for r in got) == sorted((v, t) for v in values for t in terms if t in v)


def test_levels_and_credits_count_in_scores(spark):
    rows = [(i, "music" if i == 7 else "art", 3 if i == 8 else 4, "Graduate" if i % 2 else "Undergraduate") for i in range(30)]
    courses = spark.createDataFrame(rows, "key int, title string, credits int, level string")
    asked = spark.createDataFrame([(1, "undergraduate music 3"), (2, "grad music"), (3, "music")], "query_id int, text string")
    got = collections.defaultdict(list)
    for r in catalog.field_weighted_score(asked, courses, "key", {"title": 8}, 4, "credits", "level").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.key, r.score))
    # "undergraduate" asks for both levels, as it holds "graduate"
    assert got == {1: [(7, 17), (8, 15), (0, 10), (2, 10)], 2: [(7, 17), (1, 5), (3, 5), (5, 5)], 3: [(7, 12)]}


def test_row_index_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 501,) for i in range(501)], "k long").repartition(5)
    assert {r.k: r.row_index for r in files.row_index(df, [F.col("k")]).collect()} == {i: i for i in range(501)}


def test_few_and_many_asked_terms_score_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(CORPUS)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(0, "machine learning", "a"), (1, "music machine machine", "b")], "query_id long, text string, source string")
    key = lambda df: sorted(map(str, df.select("query_id", "doc_id", F.round("score", 9)).collect()))
    kinds = lambda: [key(lexical.bm25(q, docs, "doc_id", "text", by)) for q, by in ((asked.drop("source"), None), (asked.drop("source"), ["source"]), (asked, ["source"]))]
    few = kinds()
    monkeypatch.setattr(lexical, "FEW", 0)
    assert kinds() == few and len(few[2]) < len(few[1])


def lines(page: str) -> list[str]:
    """Texts of a page outside what is skipped, by patterns alone."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?s)<(script|style|nav|header|footer|aside|form)\b.*?</\1>", "", page)
    return [x for part in re.split(r"<[^>]*>", page) if (x := " ".join(unescape(part).split()))]


def test_page_queries_against_patterns(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want, profiles, people = set(), {}, {}
    for i, page in sorted(pages.items()):
        head, rest = re.search(r"(?s)<h1>(.*?)</h1>(.*)", page).groups()
        if body := lines(rest):
            want.add((i, lines(head)[-1], "\n".join(body)))
        whole = lines(page)
        email = re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "\n".join(whole))
        phone = re.search(r"\d{3}-\d{3}-\d{4}", "\n".join(whole).replace("+1-", ""))
        profiles[i] = (lines(head)[0], email and email[0], phone and phone[0])
        for tag, inner in re.findall(r"(?s)<(div|li|article)\b[^>]*>((?:(?!<(?:div|li|article)\b).)*?)</\1>", re.sub(r"(?s)<(script|style)\b.*?</\1>", "", page)):
            texts = [x for part in re.split(r"<[^>]*>", inner) if (x := " ".join(unescape(part).split()))]
            if mail := next((m[0] for t in texts if (m := re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t))), None):
                people.setdefault(mail.lower(), (i, texts[0], mail))
    assert {(r.page_id, r.heading, r.body) for r in QUERIES["heading_sections"](spark, sf).collect()} == want
    assert {r.page_id: (r.name, r.email, r.phone) for r in QUERIES["person_profile"](spark, sf).collect()} == profiles
    assert {r.email.lower(): (r.page_id, r.name, r.email) for r in QUERIES["people_cards"](spark, sf).collect()} == people


def test_hashed_vectors_weigh_and_have_length_one(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: [float(x) for x in r.embedding.split(",")] for r in QUERIES["hashed_tfidf"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = {i: [t for t in re.findall("[a-z0-9]+", x.lower()) if len(t) > 1 and t not in T.STOPWORDS] for i, x in texts.items()}
    assert rows.keys() == texts.keys()
    for i, v in rows.items():
        assert math.hypot(*v) == pytest.approx(1 if tokens[i] else 0, abs=2e-3)
    same = collections.defaultdict(set)
    for i, t in tokens.items():
        same[tuple(sorted(t))].add(tuple(rows[i]))
    assert all(len(v) == 1 for v in same.values())  # the same tokens, the same vector


def test_contacts_links_and_offices(spark):
    rows = [("see <a href='MAILTO:a@x.org'>b@y.org</a>, 785-111-2222, 12B Main Hall",), ("c@z.org in 7 X",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(html.contacts(F.col("t")).alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [("a@x.org", "785-111-2222", "12B", "Main Hall"), ("c@z.org", None, None, None), (None, None, None, None)]
    page = "<a href='/p/1'>One <b>x</b></a><a href=\"//c.org/q\">Q</a><a href='#top'>t</a><a href='http://s.org/p/1'>again</a>"
    pages = spark.createDataFrame([(1, "https://s.org/dir/x", page), (2, "http://s.org/", page)], "page_id int, url string, html string")
    got = sorted((r.page_id, r.place, r.text, r.href) for r in html.outbound_links(pages, "page_id", "html", "url").collect())
    assert got == [(1, 0, "One x", "https://s.org/p/1"), (1, 1, "Q", "https://c.org/q"), (1, 3, "again", "http://s.org/p/1"), (2, 0, "One x", "http://s.org/p/1"), (2, 1, "Q", "http://c.org/q")]
    assert html.office_of({"Office": "12 Some Hall\nmore"}, "") == "12 Some Hall" and html.office_of({}, "Box 5 Box Hall, 33 Box Hall or 44 Fine Center") == "44 Fine Center"


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda minute, i: (datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=minute), "a", i)
    schema = "ts timestamp, who string, id int"
    for rows in [[at(0, 1), at(5, 2)], [at(90, 3)], [at(95, 4)], [at(1, 5), at(96, 6)], [at(200, 7)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = admission.stream_counts(stream, "ts", "who", "10 minutes", "10 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    query = counts.trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("late").agg(F.sum("n")).first()[0]
    assert admission.late_rows(query) == 1 and got == 5


def test_precision_and_recall_count_documents_of_high_ids(spark, tmp_path):
    spark.createDataFrame([(i, "apple" if i == 441 else "pear") for i in range(600)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "apple"), (2, "plum")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.query_id: (r.precision, r.recall, r.f1) for r in QUERIES["precision_recall_f1"](spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, round(1 / 15, 6), 0.125), 2: (0.0, 0.0, 0.0)}


def test_every_order_is_a_service_and_one_may_miss_its_calendar(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (127,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 1, "O"), (2, 2, "P"), (127, 127, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.route_id: r.label for r in QUERIES["day_label"](spark, str(tmp_path)).collect()}
    assert got == {1: "Mon", 2: "Special schedule", 127: "Daily"}
    routes, trips = spark.createDataFrame([(1,)], "route_id long"), spark.createDataFrame([(1, 9)], "route_id long, service_id long")
    calendar = spark.createDataFrame([(8, *[True] * 7)], "service_id long, " + ", ".join(f"{d} boolean" for d in relations.DAYS))
    assert not any(relations.route_service_days(routes, trips, calendar).drop("route_id").first())


def test_day_labels_of_all_patterns(spark):
    def label(days):
        week, thursday, friday, saturday, sunday = days[0] and days[4], days[3], days[4], days[5], days[6]
        if week and not sunday:
            return "Monday-Saturday" if saturday else "Monday-Friday"
        if days[0] and thursday and not friday:
            return "Monday-Thursday"
        return "Daily" if all(days) else ", ".join(n for n, d in zip("Mon Tue Wed Thu Fri Sat Sun".split(), days) if d) or "Special schedule"

    rows = [tuple(bool(i >> d & 1) for d in range(7)) for i in range(128)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} boolean" for d in relations.DAYS))
    assert all(r.label == label(tuple(r)[:7]) for r in df.withColumn("label", relations.day_label()).collect())


def test_hybrid_search_asks_words_after_character_200(spark, tmp_path):
    texts = {0: "the " * 60 + "zebra", 1: "zebra zebra", 2: "music"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.key for r in QUERIES["hybrid_search"](spark, str(tmp_path)).collect()} == {0, 1}


def test_sub_queries_after_the_second_are_searched_and_merged(spark, tmp_path):
    spark.createDataFrame([(1, "apple", "a"), (2, "pear", "b"), (3, "plum", "c")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "apple. nothing. plum. pear")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["sub_query_fanout"](spark, str(tmp_path)).collect()
    want = hashlib.md5(b"apple\n---\nplum\n---\npear").hexdigest()
    assert [(r.query_id, r.n_results, r.context, r.sources) for r in got] == [(7, 3, want, "a,b,c")]
