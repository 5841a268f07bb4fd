"""The pipeline against its operators applied one after the other to collected rows."""

import hashlib

import corpus_pipeline
from corpusops.llm import minhash_dedup, rank_bpe, source_mix

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0


def test_run_matches_brute_force_after_the_classifier(spark):
    good = corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).toPandas()
    good["key"] = [t.translate({ord(c): None for c in " \t\n\r\x0b\x0c"}) for t in good["text"]]
    good["order"] = [(-len(t), i) for t, i in zip(good["text"], good["doc_id"])]
    exact = good.sort_values("order").drop_duplicates("key").sort_values("doc_id")
    sets = {i: set(minhash_dedup.shingles(t).tolist()) for i, t in zip(exact["doc_id"], exact["text"])}
    kept = []
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i for i in ids if find(i) == i}
    near = spark.createDataFrame(exact[exact["doc_id"].isin(kept)].drop(columns=["key", "order"]))
    copies = {r.doc_id: round(r.taken / r.size) for r in source_mix.source_mix(near).collect() if r.size}
    enc = rank_bpe.encoding(rank_bpe.RANKS)
    want = sorted((r.doc_id, len(e := enc.encode_ordinary(r.text)), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()) for r in near.collect() for _ in range(copies.get(r.doc_id, 0)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want


def test_dedup_stages_keep_one_row_of_null_and_repeated_ids(spark):
    text = lambda seed: " ".join(f"t{seed}w{i}" for i in range(40))
    rows = [
        (None, text(1)), (None, text(1)), (None, text(1) + " more"),  # null ids alone: exact and near copies
        (None, text(2)),  # unique, of a null id
        (None, " "), (None, None),  # no words
        (3, text(3)), (None, text(3)), (None, text(3).upper()),
        (4, text(4)), (4, text(5)), (2, text(5)), (4, text(5) + " more"),  # an id of two texts; 2 is the smaller in the second group
        (6, text(6)), (6, text(6)), (6, text(6) + "\n"), (6, text(6) + " more"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.exact(spark, docs, SF)
    bare = lambda t: "".join((t or "").split())
    assert sorted(bare(r.text) for r in exact.collect()) == sorted({bare(t) for _, t in rows})
    for given in (exact, docs):
        near = corpus_pipeline.near(spark, given, SF)
        assert near.columns == ["doc_id", "text"]
        got = [(r.doc_id, r.text.split()[0].lower()[:2]) for r in near.collect() if bare(r.text)]
        assert sorted(got, key=lambda x: x[1]) == [(None, "t1"), (None, "t2"), (3, "t3"), (4, "t4"), (2, "t5"), (6, "t6")]
    assert sum(not bare(r.text) for r in corpus_pipeline.near(spark, docs, SF).collect()) == 2


def test_stages_with_clashing_names_do_the_same(spark):
    """Columns named as the stages' own helpers come through unchanged and change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    names = ["_row", "_ROW_", "_copy", "_copies", "_id", "_place", "print", "run", "node", "root", "size", "n_shingles", "times"]
    more = docs.selectExpr("*", *[f"doc_id * {k} AS `{n}`" for k, n in enumerate(names, 2)])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got, want = stage(spark, more, SF), stage(spark, docs, SF)
        assert got.columns == more.columns
        rows = got.collect()
        assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, want.collect()))
        for r in rows:
            assert [r[n] for n in names] == [r.doc_id * k for k in range(2, 2 + len(names))]


def test_the_kept_row_does_not_depend_on_the_order_of_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, lang) for lang in ("en", "de", None, "fr")] + [(None, text + " x", "it"), (None, text + " x", "es")]
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        kept = {str(sorted(map(str, stage(spark, spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(n), SF).collect()))) for order in (rows, rows[::-1]) for n in (1, 3)}
        assert len(kept) == 1
