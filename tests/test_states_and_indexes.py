"""Streams in time order, the coupled budget, the standing index, terms in texts, rule tables, trees and corpus versions against plain
restatements."""

import datetime
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusops.functions import rules
from corpusops.operators import documents, lexical, limits, phrases, rerank, rule_tables
from corpusops.operators.standing import Index
from corpusops.sources import files
from corpusops.streaming import admission, ordered

FEW = (("minute", 60, 2), ("hour", 3600, 5))
START = datetime.datetime(2024, 3, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_gate(rows, few=FEW, most=float("inf")):
    """(seconds, key, id, cost) in order: id to the reason it is refused for, or None."""
    held, spent, out = {}, {}, {}
    for t, key, i, cost in sorted(rows, key=lambda r: (r[0], r[2])):
        mine, day = held.setdefault(key, []), t // 86_400
        reason = next((name for name, s, n in few if sum(x > t - s for x in mine) >= n), None)
        if reason is None and round(spent.get(day, 0.0), 6) >= most:
            reason = "budget"
        if reason is None:
            mine.append(t)
            spent[day] = spent.get(day, 0.0) + cost
        out[i] = reason
    return out


# --- streams ------------------------------------------------------------------------------------------

SCHEMA = "ts timestamp, who string, id int"


def stream_of(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, out, path):
    query = ordered.to_files(out, f"{path}/out", f"{path}/state")
    query.awaitTermination(300)
    return spark.read.schema(out.schema).parquet(f"{path}/out").collect()


def test_stream_folds_rows_in_time_order(spark, tmp_path):
    """Rows up to an hour out of order are decided as by the batch; later ones leave no trace; a null key only moves time."""
    rng, batches, rows, newest, late = random.Random(5), [], [], 0, set()
    for n in range(5):
        batch = [(rng.randrange(max(0, n * 3000 - 3000), n * 3000 + 3000), rng.choice("aab"), n * 100 + i) for i in range(60)]
        if n == 3:
            batch += [(newest - 3600 - d, "a", 1000 + d) for d in (1, 500, 3000)]  # behind the watermark of the batches before
            late = {1001, 1500, 4000}
        rows += batch
        batches.append([(at(t), k, i) for t, k, i in batch])
        newest = max(newest, *(t for t, *_ in batch))
    assert all(t >= max([0, *(x for b in range(n) for x in [max((r[0] - START).total_seconds() for r in batches[b])])]) - 3600 or i in late for n, b in enumerate(batches) for t, i in [((r[0] - START).total_seconds(), r[2]) for r in b])
    batches.append([(at(newest + 3 * 3600), None, -1)])
    got = run(spark, admission.stream_admit(stream_of(spark, tmp_path, batches), "who", "ts", "id", FEW, "1 hour"), tmp_path)
    assert {r.id for r in got if r.late} == late and all(r.allowed is None for r in got if r.late)
    want = plain_gate([(t, k, i, 0) for t, k, i in rows if i not in late])
    assert {r.id: r.reason for r in got if not r.late} == want and all(r.allowed == (r.reason is None) for r in got if not r.late)
    assert len(got) == len(rows)


def test_stream_waits_for_the_watermark(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(at(0), "a", 1), (at(10), "a", 2)], [(at(3599), "a", 3)]])
    assert run(spark, admission.stream_admit(stream, "who", "ts", "id", FEW, "1 hour"), tmp_path) == []


def test_sessions_are_renewed_and_expire(spark, tmp_path):
    batches = [[(at(0), "a", 1), (at(100), "b", 2)], [(at(50), "a", 3), (at(400), "a", 4)], [(at(130), "b", 5), (at(1000), "b", 6)], [(at(700), "a", 7)], [(at(4000), None, 0)]]
    out = admission.stream_sessions(stream_of(spark, tmp_path, batches), "who", "ts", "id", 300, "10 minutes")
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    got = sorted((r.who, (r.first - base) // 1_000_000, (r.last - base) // 1_000_000, r.n, r.late) for r in run(spark, out, tmp_path))
    # a at 700 renews the session of 400 just in time; b at 1000 starts anew
    assert got == [("a", 0, 50, 2, False), ("a", 400, 700, 2, False), ("b", 100, 130, 2, False), ("b", 1000, 1000, 1, False)]


# --- the coupled budget ---------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0.0, 7.0, 30.0, 1e9])
def test_coupled_budget_equals_a_replay(spark, most):
    rng = random.Random(most)
    few = (("hour", 3600, 2), ("three days", 259_200, 12))
    rows = [(rng.randrange(0, 9 * 86_400), rng.choice("aabcd"), i, rng.choice([0.0, 0.5, 1.0, 2.5])) for i in range(400)]
    df = spark.createDataFrame([(k, at(t), i, c) for t, k, i, c in rows], "who string, ts timestamp, id int, cost double")
    got = limits.coupled(df, "who", "ts", "id", F.col("cost"), most, few)
    assert got.columns == [*df.columns, "allowed", "reason"]
    want = plain_gate(rows, few, most)
    assert {r.id: r.reason for r in got.collect()} == want
    assert ("budget" in want.values()) == (most < 1e9)


def test_coupled_budget_of_no_requests(spark):
    none = spark.createDataFrame([], "who string, ts timestamp, id int")
    assert limits.coupled(none, "who", "ts", "id", F.lit(1.0), 5.0, FEW).count() == 0


# --- terms in texts -------------------------------------------------------------------------------------


def test_terms_in_texts_by_all_ways(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "abc", "xabcabc", "日本語 é😀", "a" * 5000] + ["".join(rng.choice("abcé 😀") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    terms = ["", "a", "ab", "abc", "bca", "é😀", "本", "zz", "a" * 4000, None] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    parts = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, x in enumerate(texts) if x is not None for t in {t for t in terms if t is not None} if t in x)
    ways = []
    for first, chars, passes in ((20_000, 10**6, 16), (3, 1000, 16), (3, 1000, 1)):
        monkeypatch.setattr(phrases, "FIRST", first)
        monkeypatch.setattr(phrases, "MOST_CHARS", chars)
        monkeypatch.setattr(phrases, "MOST_PASSES", passes)
        ways.append(sorted((r.id, r.term) for r in phrases.occurring(df, parts, "text", keep=["id"]).collect()))
    assert ways == [want] * 3
    assert phrases.occurring(df, parts.where("false"), "text").count() == 0 and phrases.occurring(df.where("false"), parts, "text").columns == ["id", "text", "term"]


def test_required_literals_are_required():
    cases = {
        r"\b(the|a|an)\b": ["a", "an", "the"], r"tion\b": ["tion"], "(foo)?bar+": ["ba"], "x*": None, "[ab]c": ["c"], "(?=look)ahead": ["ahead"], "Foo(Bar|Bazz)": ["foo"],
        "(?:abcd|efgh)x": ["abcd", "efgh"], r"\d+": None, "a|": None, r"\p{L}": None, "é+": None, "(ab){2,}": ["ab"],
    }
    for pattern, want in cases.items():
        assert rule_tables.required(pattern) == want, pattern
    rng = random.Random(1)
    for pattern in cases:
        literals = rule_tables.required(pattern)
        for _ in range(300):
            text = "".join(rng.choice(["the", "foo", "bar", "a", "ab", "c", "tion", "x", " ", "look", "ahead", "bazz"]) for _ in range(4))
            if literals and "\\p" not in pattern and re.search(pattern.lower() if "\\b" not in pattern else pattern, text):
                assert any(x in text for x in literals)


def test_rule_tables_equal_rules_in_the_plan(spark):
    rng = random.Random(3)
    part = lambda: rng.choice([rf"\bw{rng.randrange(300)}\b", f"(x{rng.randrange(50)}|y{rng.randrange(50)})", r"[0-9]{4}", f"w{rng.randrange(30)}0", rf"^w{rng.randrange(99)}"])
    table = {f"intent{i}": sorted({part() for _ in range(60)}) for i in range(40)}
    texts = [" ".join(rng.choice([f"w{rng.randrange(300)}", f"X{rng.randrange(50)}", f"y{rng.randrange(50)}", "AB 123", "12345"]) for _ in range(rng.randrange(0, 6))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seed = ("intent7", r"\b[A-Z]{2} [0-9]{3}\b", 3)
    as_rows = spark.createDataFrame([(n, i, p) for i, (n, ps) in enumerate(table.items()) for p in ps], "intent string, place int, pattern string")
    got = {r.id: (r.intent, r.score, r.confidence) for r in rule_tables.intents_by_table(df, as_rows, ["id"], seed=seed).collect()}
    # a rule in the plan is a column of its own; so many at once are compiled in parts
    want = {}
    for i, text in enumerate(texts):
        best = (0, 0, "general")
        for place, (name, patterns) in enumerate(table.items()):
            points = sum(re.search(p, (text or "").lower()) is not None for p in patterns)
            hit = name == seed[0] and re.search(seed[1], text or "")
            best = max(best, (points + (3 if hit else 0), 1 if hit else -place, name)) if points or hit else best
        want[i] = (best[2], best[0], round(min(0.95, 0.6 + 0.15 * best[0]), 6) if best[0] else 0.3)
    assert got == want
    few = dict(list(table.items())[:3])
    small = as_rows.where("place < 3")
    column = df.select("id", rules.score_intents(F.coalesce("text", F.lit("")), {k: v for k, v in few.items()}).alias("c")).select("id", "c.intent", "c.score", "c.confidence")
    assert sorted(map(str, rule_tables.intents_by_table(df, small, ["id"]).collect())) == sorted(map(str, column.collect()))


# --- trees, names and versions --------------------------------------------------------------------------


def test_json_trees_of_any_depth(spark):
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([1, 2.5, "text", True, None, "é\"x"])
        if rng.random() < 0.5:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "c", "source", "d e"]) + str(k): tree(depth - 1) for k in range(rng.randrange(4))}

    def plain(value, category=""):
        if isinstance(value, dict):
            for key, inner in value.items():
                if key == "source1":
                    continue
                if isinstance(inner, (dict, list)):
                    yield from plain(inner, key)
                else:
                    yield category, key, None if inner is None else {True: "true", False: "false"}[inner] if isinstance(inner, bool) else str(inner)
        elif isinstance(value, list):
            for inner in value:
                if isinstance(inner, (dict, list)):
                    yield from plain(inner, category)

    trees = [tree(6) for _ in range(150)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(900, None), (901, "{broken"), (902, "[]"), (903, "7")]
    got = documents.flatten_json(spark.createDataFrame(rows, "id int, j string"), ["id"], "j", ["source1"]).collect()
    assert sorted((r.id, r.category, r.item, str(r.value)) for r in got) == sorted((i, c, k, str(v)) for i, t in enumerate(trees) for c, k, v in plain(t))


def test_dropped_rows_are_counted_by_the_write(spark, tmp_path):
    df = spark.createDataFrame([("Ann",), ("",), (None,), ("SSO login",), (" ",), ("Bo",)], "name string")
    kept, counted = documents.searchable_text_counted(df, "name", ["name"])
    kept.write.parquet(str(tmp_path / "out"))
    assert counted.get == {"seen": 6, "no_name": 3, "invalid_name": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert {r.reason: r.n for r in documents.dropped_names(df, "name").collect()} == {"no name": 3, "invalid name": 1}


def test_a_failed_rebuild_leaves_the_corpus_as_it_was(spark, tmp_path):
    corpus = files.Corpus(spark, str(tmp_path / "corpus"))
    with pytest.raises(FileNotFoundError):
        corpus.read()
    corpus.rebuild(spark.range(5))
    reader = corpus.read()
    with pytest.raises(Exception):
        corpus.rebuild(spark.range(100, numPartitions=4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("midway"))).cast("long").alias("id")))
    assert corpus.versions() == [1] and corpus.read().count() == 5
    corpus.rebuild(spark.range(7))
    assert corpus.read().count() == 7 and reader.count() == 5  # who reads the version before still can
    corpus.rebuild(spark.range(2), replace=False)
    corpus.rebuild(spark.range(3))
    assert corpus.versions() == [2, 3] and corpus.read(2).count() == 7
    with pytest.raises(FileNotFoundError):
        corpus.read(1)


def test_upsert_makes_only_what_has_changed(spark, tmp_path):
    corpus, made = files.Corpus(spark, str(tmp_path / "corpus")), spark.sparkContext.accumulator(0)

    def make(rows):
        count = F.udf(lambda t: made.add(1) or t.upper(), "string").asNondeterministic()
        return rows.withColumn("loud", count("text"))

    corpus.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string"), "id", ["text"], make)
    assert made.value == 3
    corpus.upsert(spark.createDataFrame([(2, "b"), (3, "C"), (4, "d")], "id int, text string"), "id", ["text"], make)
    assert made.value == 5
    assert sorted((r.id, r.text, r.loud) for r in corpus.read().collect()) == [(1, "a", "A"), (2, "b", "B"), (3, "C", "C"), (4, "d", "D")]


def test_only_the_newest_snapshot_is_read(spark, tmp_path):
    for name, v in (("20240101_x", 1), ("20240301_a", 3), ("20240201_z", 2)):
        (tmp_path / f"snap_{name}.json").write_text('{"v": %d}\n' % v)
    got = files.latest_file(spark, str(tmp_path / "snap_*.json"), "v int")
    assert [(r.v, r.file_name) for r in got.collect()] == [(3, "snap_20240301_a.json")] and len(got.inputFiles()) == 1


def test_batch_scorer_loads_its_model_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda asked, passages: [float(len(p)) if p else 0.0 for p in passages]

    rows = [(q, r, f"q{q}", "x" * ((q * r) % 7)) for q in range(40) for r in range(1, 26)]
    df = spark.createDataFrame(rows, "query_id int, rank int, question string, passage string").repartition(8)
    got = rerank.rerank(df, rerank.batch_scorer("length", load), 20, 800).collect()
    for q in range(40):
        mine = [r for _, r in sorted((r["rank"], r) for r in got if r.query_id == q)]
        head = sorted((-((q * r) % 7), r) for r in range(1, 21))
        assert [r.rerank_score for r in mine] == [float(-s) for s, _ in head] + [None] * 5
    assert 1 <= len(list(tmp_path.iterdir())) <= spark.sparkContext.defaultParallelism + 1


# --- the standing index -----------------------------------------------------------------------------------


def corpus_rows(n, seed):
    rng = random.Random(seed)
    text = lambda: " ".join(f"t{int(1.3 ** rng.uniform(0, 24))}" for _ in range(rng.choice([0, 3, 12, 60])))
    same = text()
    return [(i, same if i % 5 == 0 else text(), rng.choice(["x", "y", None])) for i in range(n)] + [(n, None, "x")]


@pytest.mark.parametrize("prune", [False, True])
@pytest.mark.parametrize("by", [[], ["source"]])
def test_index_answers_as_a_scan_does(spark, tmp_path, by, prune):
    docs = spark.createDataFrame(corpus_rows(1500, 1), "doc_id long, text string, source string")
    rng = random.Random(2)
    asked = spark.createDataFrame([(q, " ".join(f"t{int(1.3 ** rng.uniform(0, 24))}" for _ in range(rng.randrange(0, 9)))) for q in range(60)], "query_id int, text string")
    if by:
        docs = docs.where("source IS NOT NULL")
    index = Index.build(docs, "doc_id", "text", str(tmp_path / "index"), by, folders=4, shard=32)
    got, want = index.search(asked, 7, prune), lexical.search(asked, docs, "doc_id", "text", 7, by)
    columns = ["query_id", *by, "doc_id", "score", "rank"]
    # sums in another order may differ in the last digit that scores are rounded to
    key = lambda r: tuple(r[c] for c in columns if c != "score")
    mine, theirs = sorted(got.select(columns).collect(), key=lambda r: str(key(r))), sorted(want.select(columns).collect(), key=lambda r: str(key(r)))
    assert [key(r) for r in mine] == [key(r) for r in theirs]
    assert [r.score for r in mine] == pytest.approx([r.score for r in theirs], abs=2e-6)


def test_index_leaves_blocks_closed_and_reads_no_documents(spark, tmp_path):
    """One rare term decides; blocks of the common ones in other shards stay closed."""
    rows = [(i, "common words here " * 3 + (" rare" * 4 if i % 997 == 0 else ""), "x") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "docs"))
    index = Index.build(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text", str(tmp_path / "index"), shard=64)
    asked = spark.createDataFrame([(1, "common rare"), (2, "nothing")], "query_id int, text string")
    (row,) = index.skipped(asked, 3).collect()
    assert row.n_opened < row.n_blocks / 4
    found = index.search(asked, 3, prune=True)
    assert not any("/docs/" in f for f in found.inputFiles())
    assert [r.doc_id for r in sorted(found.collect(), key=lambda r: r["rank"])] == [0, 997, 1994]
    again = Index(spark, str(tmp_path / "index"), "doc_id")
    assert sorted(map(str, again.search(asked, 3).collect())) == sorted(map(str, found.collect()))


def test_index_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "the of")], "doc_id long, text string")
    index = Index.build(docs, "doc_id", "text", str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([(1, "word")], "query_id int, text string"), 3).count() == 0
