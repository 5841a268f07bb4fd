"""The training-data operators against brute force, the public libraries and exact round trips, and on
nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusops.llm import arc_to_warc as arc, exact_dedup, kd_shards, minhash_dedup as near, packed_ids, quality_pu, rank_bpe, source_mix, stable_ann as ann, token_counts
from corpusops.llm.common import running, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, run int, print string, rank int, row long, node long, keep_id long, u long, chunk int"


def words(n, seed, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def edge_rows():
    base = words(60, 1)
    swapped = base.split()
    swapped[30] = "changed"
    texts = [
        None, "", "   ", "one two", "One  TWO", "two one", base, base, base.upper(), " ".join(swapped), base + " and more", words(60, 2),
        words(5000, 3), "ünï cödé 日本 語 <|endoftext|> x", "a  b \n c\t\td  ", "don't I'll 12345 !!??", "x" * 3000,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [(5, "two one", "en", "s1", None), (6, base, None, "s2", None), (None, base, "en", "s0", None), (None, None, None, None, None)]
    return [(*r, 7, 7, "p", 7, 7, 7, 7, 7, 7) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"


def test_running_sums_match_a_single_window(spark):
    rows = [(g, i, random.Random(i).randrange(9) if i % 7 else None) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("b", F.floor(F.col("i") / 20))
    got = {(r.g, r.i): r.s for r in running(df, ["g"], "b", [F.col("i")], {"s": F.col("v")}).collect()}
    for g in "ab":
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == g):
            assert got[g, i] == total
            total += v or 0


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    rows = edge_rows()
    key = lambda t: (t or "").translate({ord(c): None for c in " \t\n\r\x0b\x0c"})
    assert len(got) == len(rows)
    for r in got:
        same = [x for x in rows if hashlib.sha256(key(x[1]).encode()).hexdigest() == r.text_sha256]
        best = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size, r.kept) == (best[0], len(same), r.doc_id == best[0])
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({key(x[1]) for x in rows})


def test_exact_dedup_of_a_hot_text_over_many_partitions(spark):
    """A third of the rows are one text; runs of 40 partitions merge in four levels."""
    rows = [(i, "one text" if i % 3 else f"text {i}", "en", "s", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(40)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, fan_in=3).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert (r.keep_id, r.group_size, r.kept) == ((1, 400, i == 1) if i % 3 else (i, 1, True))


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    return sets, [min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))]


def check_components(rows, got):
    sets, component = brute_components(rows)
    want = sorted((str(r[0]), len(s), str(c), (r[0] is not None and r[0] == c) or not s) for r, s, c in zip(rows, sets, component))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want


def test_near_duplicates_on_edges(docs, none):
    check_components(edge_rows(), near.near_duplicates(docs).collect())
    assert near.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    """Copies with one to many edits: neighbours are linked, far ones only through others."""
    monkeypatch.setattr(near, "CHUNK", 16)
    monkeypatch.setattr(near, "SIDE", 8)
    base, rng, rows = words(80, 5).split(), random.Random(6), []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            text[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(1000 + i, words(50, 100 + i), "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_components(rows, near.near_duplicates(df).collect())


def test_bayes_bound_and_exact_test():
    least = near.least_matches(0.75, 1e-5)
    assert 0 <= least[40] < 30 and 110 < least[200] < 150
    a, b = np.arange(100, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)
    assert near.SetTest(75)(a, [b, b[:60]]).tolist() == [True, False]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    found = {r.node: r.root for r in near.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}
    assert near.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, [1.0], 0), (None, v[0].tolist(), 0), (7, v[8].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, leaf=64).collect()
    every, ids = np.vstack([v, v[8:9]]).astype(float), np.append(np.arange(900), 7)
    hit = total = 0
    for q in range(0, 900, 50):
        away = np.sqrt(((every - every[q]) ** 2).sum(1))
        away[ids == q] = np.inf
        best = np.lexsort((ids, away))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 11))
        hit, total = hit + len({i for _, i, _ in mine} & set(ids[best].tolist())), total + 10
    assert hit / total >= 0.95
    crowd = df.where("vec_id < 900").unionByName(spark.createDataFrame([(5000 + i, v[100].tolist(), 0) for i in range(600)], df.schema))
    same = ann.nearest(crowd, F.col("vec_id").isin(100, 5100), leaf=64).collect()
    for q in (100, 5100):
        assert [(r.vec_id, r.score) for r in sorted((r for r in same if r.query_id == q), key=lambda r: r.rank)] == [(i, 0.0) for i in range(100, 111) if i != q][:10]
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)]
    assert ties == list(range(101, 111))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_nearest_neighbours_verify_few_vectors(spark):
    """Recall, and the share of vectors that are verified, with the parameters of the query on sf0.1."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    matrix, limit = ann.directions(v.shape[1], 48), ann.chi_square_limit(0.12, 48)
    assert v.shape[1] == 64 and np.isfinite(v).all()
    got = {}
    for r in ann.op3_stable_ann(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    projected = v @ matrix
    planes = ann.Planes(projected, 1)
    leaf = planes.leaf(projected)
    parts = [(ann.Local(projected[leaf == x]), v[leaf == x], ids[leaf == x]) for x in (0, 1)]
    hit = verified = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        away = np.sqrt(((v - v[q]) ** 2).sum(1))
        away[ids == ids[q]] = np.inf
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, away))[:10]].tolist()))
        home = parts[leaf[q]]
        _, found, first = ann.search(*home, v[q], projected[q], ids[q], np.inf, 10, limit)
        *_, second = ann.search(*parts[1 - leaf[q]], v[q], projected[q], ids[q], found[-1], 10, limit)
        verified += first + second
    assert hit / (10 * len(asked)) >= 0.9
    assert verified / (len(v) * len(asked)) < 0.3


def test_source_mix(spark, docs, none):
    rows = [(i, words(1 + i % 40, i), "en", [None, "a", "b", "c"][i % 4] if i % 3 else "a", 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = source_mix.source_mix(df).collect()
    again = source_mix.source_mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), taken in by.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= max(0.03 * target, 256)
    assert source_mix.source_mix(docs).count() == len(edge_rows())
    assert source_mix.source_mix(none).count() == 0
    copies = source_mix.mixed(df)
    assert copies.columns == df.columns and copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_golden_points_reach_every_source_in_proportion(spark):
    sources = spark.createDataFrame([(0, 500.0), (1, 300.0), (2, 0.0), (3, 200.0)], "no int, target double")
    got = source_mix.schedule(spark, sources, 1000).collect()
    n = {s: sum(r.no == s for r in got) for s in range(4)}
    assert abs(n[0] - 500) < 6 and abs(n[1] - 300) < 6 and n[2] == 0 and sum(n.values()) == 1000
    assert sorted(r["rank"] for r in got if r.no == 3) == list(range(n[3]))


PAGES = "page_id long, url string, html string, payload_digest string, block string"


def test_arc_and_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "x\r\n\r\ny\n\n", "", ""), (2, None, None, "", ""), (3, "http://c", "", "", ""), (4, "http://d", "x\r\n\r\ny\n\n", "", ""), (4, "http://d", "x\r\n\r\ny\n\n", "", ""), (None, "http://e", "é" * 5000, "", ""), (9, "http://f", "WARC/1.0\r\nContent-Length: 5\r\n\r\n", "", "")]
    a, w = shared_dir(spark), shared_dir(spark)
    arc.write_arc(spark.createDataFrame(rows, PAGES).repartition(2), a)
    arc.convert(spark, a, w)
    got = arc.read_warc(spark, w).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((x[2] or "").encode() for x in rows if x[0] == r.page_id)
        same = [x[0] for x in rows if (x[2] or "").encode() == html and x[0] is not None]
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        first = max(same, default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.date == "2024-01-01T00:00:00Z"
    a, w = shared_dir(spark), shared_dir(spark)
    arc.write_arc(spark.createDataFrame([], PAGES), a)
    arc.convert(spark, a, w)
    assert arc.read_warc(spark, w).count() == 0


def test_warc_files_are_cut_by_bytes(spark):
    """Each file starts with its own description and holds few small chunks; nothing is lost at the cuts."""
    rows = [(i, f"http://a/{i}", f"{i} " * (i % 50), "", "") for i in range(300)]
    a, w = shared_dir(spark), shared_dir(spark)
    arc.write_arc(spark.createDataFrame(rows, PAGES).repartition(2), a)
    arc.convert(spark, a, w, chunk=3000, file_chunks=4)
    files = spark.read.format("binaryFile").load(w).collect()
    assert len(files) > 10
    for f in files:
        kinds = [fields["WARC-Type"] for fields, _ in arc.warc_records(gzip.GzipFile(fileobj=io.BytesIO(f.content)))]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1 and len(kinds) > 1
        assert len(gzip.decompress(f.content)) < 4 * (3000 + 1500)
    assert sorted(r.page_id for r in arc.read_warc(spark, w).collect()) == list(range(300))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = arc.http_block(5, b"hello")
    data = arc.arc_version_block(version, "f.arc") + b"\n" + arc.arc_line(version, "http://x", "1.2.3.4", "20200102030405", "text/html", body, "f.arc") + body + b"\n"
    ((fields, got),) = arc.arc_records(io.BytesIO(data))
    assert got == body and fields["Archive-date"] == "20200102030405" and ("Checksum" in fields) == (version == 2)
    with pytest.raises(ValueError):
        list(arc.arc_records(io.BytesIO(data[:-4])))
    with pytest.raises(ValueError):
        list(arc.arc_records(io.BytesIO(data.replace(b"URL IP", b"URI IP"))))
    assert gzip.decompress(gzip.compress(data)) == data


def test_kd_shards(spark, docs, none):
    rows = [(i, "same" if i % 3 == 0 else words(1 + i % 90, i), ["en", "de"][i % 2], f"s{i % 5}", 0) for i in range(2000)]
    got = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 24).collect()
    assert len(got) == 2000
    size = [0] * 24
    slots = [[] for _ in size]
    for r in got:
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size) - min(size) <= 1200
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    few = kd_shards.kd_shards(docs, 24).collect()
    assert len(few) == len(edge_rows()) and all(0 <= r.shard < 24 for r in few)
    assert kd_shards.kd_shards(none, 24).count() == 0


def brute_shards(rows, shards, snap):
    """The tree by sorting: rows are (id, size, source code, language code, crc)."""
    spans = [max(1, max(r[k] for r in rows) - min(r[k] for r in rows)) for k in (1, 2, 3)]
    allowed = snap * sum(r[1] for r in rows) / shards
    out = {}

    def split(part, first, k):
        if k == 1 or not part:
            out.update({r[0]: first for r in part})
            return
        wide = [(max(r[d] for r in part) - min(r[d] for r in part)) / s for d, s in zip((1, 2, 3), spans)]
        dim = 1 + wide.index(max(wide))
        part = sorted(part, key=lambda r: (r[dim], r[4], r[0]))
        goal, below = sum(r[1] for r in part) * (k // 2) / k, 0
        for i, r in enumerate(part):
            if below + r[1] >= goal:
                break
            below += r[1]
        same = [j for j, x in enumerate(part) if (x[dim], x[4]) == (r[dim], r[4])]
        heavy = sum(part[j][1] for j in same)
        lo, hi = (same[0], same[-1] + 1) if heavy <= allowed else (i, i + 1)
        before = sum(x[1] for x in part[:lo])
        cut = hi if before + sum(x[1] for x in part[lo:hi]) - goal <= goal - before else lo
        split(part[:cut], first, k // 2)
        split(part[cut:], first + k // 2, k - k // 2)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [5, 24])
def test_kd_shards_equal_a_tree_by_sorting(spark, shards):
    rng = random.Random(3)
    rows = [(i, "same text" if i % 7 == 0 else words(1 + rng.randrange(80), i), rng.choice(["en", "de", None]), f"s{rng.randrange(6)}", 0) for i in range(700)]
    got = {r.doc_id: r.shard for r in kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards, snap=0.05).collect()}
    code = lambda x: -1 if x is None else zlib.crc32(x.encode())
    assert got == brute_shards([(i, len(t.encode()) + 8, code(s), code(x), zlib.crc32(t.encode())) for i, t, x, s, _ in rows], shards, 0.05)


def test_packed_ids(spark, docs, none):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = shared_dir(spark)
    packed_ids.write_packed(docs, path, ranges=4, block_ids=50, file_blocks=2)
    got = sorted(packed_ids.read_packed(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    want = sorted((str(r[0]), len(ids := [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    path = shared_dir(spark)
    packed_ids.write_packed(none, path)
    assert packed_ids.read_packed(spark, path).count() == 0


def test_packed_ids_where_a_third_of_the_ids_are_null(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 and i < 150 else i, words(1 + i % 40, i)) for i in range(600)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shared_dir(spark)
    packed_ids.write_packed(df, path, ranges=8, block_ids=500, file_blocks=1)
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    assert len({f.path.split("part-")[1][:5] for f in files}) >= 6 and max(f.length for f in files) < 5000  # nulls are in more than one task
    got = sorted(packed_ids.read_packed(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)


def test_files_are_ordered_by_number(spark):
    """From 100,000 tasks and 1,000 files a task on, names no longer sort as their numbers."""
    names = [f"file:/x/part-{task:05d}-5c1f-9-c{n:03d}.txt" for task in (0, 7, 99_999, 100_000, 1_000_001) for n in (0, 999, 1000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    assert [r.i for r in df.orderBy(packed_ids.file_number(F.col("path"))).collect()] == list(range(len(names)))
    assert names != sorted(names)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (packed_ids.unpack(data, 1001, bits) == ids).all() and (packed_ids.unpack(data, 77, bits, 501) == ids[501:578]).all()


def odd_texts():
    rng = random.Random(8)
    out = ["", " ", "a ", " a", "a  b", "a\n b \n c", "x\n \ny", "a<|endoftext|> b", "ΑΣ ς İ ǅ ﬁ 日本 é", "\x1c!\x1d!", "<|startoftext|><|endoftext|>", "y" * 700]
    out += ["".join(rng.choice("aab 's\n\t 0é,!  日ßΣ") for _ in range(rng.randrange(1, 50))) for _ in range(800)]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(1, 25))) for _ in range(500)]


def test_encoder_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), odd_texts()
    got = packed_ids.Encoder(path).encode(texts, 0)
    assert got == [np.array([*e.ids, 0], "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets_words_without_changing_ids(monkeypatch):
    monkeypatch.setattr(packed_ids, "REMEMBERED", 8)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), odd_texts() + [words(300, i) + ",\nLine. \"Said\" she's" for i in range(5)]
    got = packed_ids.Encoder(path).encode(texts, 7)
    assert got == [np.array([*e.ids, 7], "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]


LONG_TEXTS = {
    "spaces": " " * 1_000_000,
    "line feeds": "\n" * 1_000_001,
    "mixed white space": "x" + " \n\t" * 400_000 + "y",
    "one word": "".join(random.Random(9).choices("abcdefghij", k=300_000)),
    "a run between words": "ab cd" * 20_000 + " " * 1_100_000 + "ef gh" * 20_000,
    "signs": "!?" * 100_000,
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_very_long_texts_in_ids(name):
    """Against the pattern's matches, found by another library and encoded one by one."""
    text, enc = LONG_TEXTS[name], rank_bpe.encoding(rank_bpe.RANKS)
    want = [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m)]
    assert rank_bpe.encode(text, enc) == want
    assert rank_bpe.decode(want, enc) == text.encode()
    packed = packed_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode([text], 0)[0]
    assert packed == np.array([*want, 0], "<u4").tobytes()


def test_very_long_texts_in_counts():
    lib, counter = Tokenizer.from_file(token_counts.VOCABULARY), token_counts.Merger(token_counts.VOCABULARY)
    texts = [t[:120_000] if name == "one word" else t for name, t in LONG_TEXTS.items()]
    assert counter.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark, docs, none):
    lib, texts = Tokenizer.from_file(token_counts.VOCABULARY), odd_texts()
    assert token_counts.Merger(token_counts.VOCABULARY).count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.token_counts(docs).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in edge_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(none).count() == 0


def test_rank_bpe(docs, none):
    enc = rank_bpe.encoding(rank_bpe.RANKS)
    for text in [*odd_texts(), "w " * 5000, "  x" * 3000, "a" + " " * 90 + "b\n" + "\n" * 70]:
        ids = rank_bpe.encode(text, enc, 40)
        assert ids == enc.encode_ordinary(text) and rank_bpe.decode(ids, enc) == text.encode()
    got = rank_bpe.encoded_digests(docs).collect()
    want = sorted((str(r[0]), len(ids := enc.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in edge_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert rank_bpe.encoded_digests(none).count() == 0 and rank_bpe.encoded(docs).count() == len(edge_rows())


def test_quality_features_against_a_plain_restatement():
    text = "The cat SAT. the cat sat!\n\nThe end \u00e9 42\nThe end \u00e9 42"
    raw = text.encode()
    got, words = quality_pu.features(text), raw.split()
    share = lambda test: sum(test(x) for x in raw) / len(raw)
    assert got[:5] == pytest.approx([share(lambda x: 97 <= x <= 122), share(lambda x: 65 <= x <= 90), share(lambda x: 48 <= x <= 57), share(lambda x: x == 32), share(lambda x: x == 10)])
    assert got[5 + quality_pu.SIGNS.index(ord("."))] == pytest.approx((1 / len(raw)) ** 0.5)
    stats = got[5 + len(quality_pu.SIGNS) :]
    pairs = list(zip(words, words[1:]))
    assert stats[:4] == pytest.approx([len(set(words)) / len(words), len(set(pairs)) / len(pairs), sum(a == b for a, b in pairs) / len(words), np.log(1 + len(words))])
    assert stats[9:12] == pytest.approx([2 / 3 + 0, np.log(len(raw) / 3), 2 / len(words)], abs=0.4)
    assert len(got) == quality_pu.N_FEATURES and quality_pu.features("")[-1] == 1 and not quality_pu.features("")[:-1].any()


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_gradient_equals_differences(prior):
    """prior 0.95 takes the risk on negatives below zero, where the step goes up that risk alone."""
    rng = np.random.default_rng(4)
    a, b, w = rng.normal(1, 1, (60, 4)), rng.normal(-0.5, 1, (80, 4)), rng.normal(0, 1, 4)
    loss = lambda z: np.log1p(np.exp(z))
    on_pos = lambda w: prior * loss(-(a @ w)).mean()
    rest = lambda w: loss(b @ w).mean() - prior * loss(a @ w).mean()
    p, r, g = quality_pu.step(w, a, b, prior)
    assert (p, r) == (pytest.approx(on_pos(w)), pytest.approx(rest(w)))
    target = (lambda w: on_pos(w) + rest(w)) if r >= 0 else (lambda w: -rest(w))
    diff = [(target(w + 1e-6 * e) - target(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    assert g == pytest.approx(diff, abs=1e-6)
    assert (r < 0) == (prior == 0.95)


def test_quality_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_pu.op1_quality_pu(spark, d)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in test) / len(test) >= 0.95
    assert all(p for y, p in test if y == 1)


def test_quality_classifier_on_edges(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, 1, 0), (None, 1, 0), (99, 1, 0), (7, None, 0)], LABELS)
    assert quality_pu.scored(docs, quality_pu.train(docs, labels)).where("score BETWEEN 0 AND 1").count() == len(edge_rows())
    assert quality_pu.scored(docs, quality_pu.train(docs, labels.where("false"))).count() == len(edge_rows())
    assert quality_pu.scored(none, quality_pu.train(none, labels)).count() == 0
    assert quality_pu.keep_good(docs, labels).columns == docs.columns


def test_negative_risk_is_not_fitted_below_zero():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1, 1, (300, 5)), rng.normal(-1, 1, (100, 5))
    scorer = quality_pu.fit(pos[:200], np.vstack([pos[200:], neg]), 0.5, steps=400)
    assert scorer(pos).mean() > 0.7 and scorer(neg).mean() < 0.3
