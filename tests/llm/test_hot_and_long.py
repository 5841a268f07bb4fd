"""Hot groups and very long texts in the operators: a third of the rows alike, texts of millions of characters."""

import base64
import hashlib
import zlib

import numpy as np

from corpusops.llm import arc_to_warc as arc, exact_dedup, kd_shards, minhash_dedup as near, quality_pu, source_mix
from corpusops.llm.common import shared_dir
from test_llm_operators import check_components, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_where_a_third_of_the_rows_are_copies(spark):
    same = words(80, 1)
    rows = [(i, same if i % 3 == 0 else words(40 + i % 30, i), "en", "s", 1) for i in range(300)] + [(1000, same + " with an end", "en", "s", 1)]
    check_components(rows, near.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(7)).collect())


def long_rows():
    long = " ".join(f"w{i % 9973}" for i in range(400_000))
    return [(1, long, "en", "a", 0), (2, long + " more", "de", "b", 0), (3, "x" * 2_000_000, "en", "a", 0), (4, long, "fr", None, 0), (5, "short text of a few words", "en", "b", 0)]


def test_very_long_texts_are_read_whole(spark):
    rows = long_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in near.near_duplicates(df).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 1, 5] and got[1].n_shingles == 9973 and got[3].n_shingles == 1
    exact = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(df).collect()}
    assert exact[4][:2] == exact[1][:2] == (1, 2) and exact[3][2] == hashlib.sha256(b"x" * 2_000_000).hexdigest()
    shards = {r.doc_id: r for r in kd_shards.kd_shards(df, 3).collect()}
    assert all(shards[i].size == len(t) + 8 and shards[i].text_crc32 == zlib.crc32(t.encode()) for i, t, *_ in rows)
    mix = {r.doc_id: r for r in source_mix.source_mix(df).collect()}
    assert [mix[i].size for i in (1, 2, 3)] == [400_000, 400_001, 1] and all(0 <= r.taken <= 2 * r.size for r in mix.values())
    values = [quality_pu.features(t) for _, t, *_ in rows]
    assert all(np.isfinite(v).all() and len(v) == quality_pu.N_FEATURES for v in values)
    # what stands behind the first megabyte counts
    assert not np.array_equal(quality_pu.features("word " * 300_000), quality_pu.features("word " * 299_999 + "OTHER "))


def test_archives_of_hot_and_very_long_payloads(spark):
    """A third of the payloads are one; some are many times longer than a chunk, one more than the usual chunk."""
    pay = lambda i: "same payload" if i % 3 == 0 else f"{i} " * (7000 if i % 40 == 1 else i % 60) if i != 200 else "long é" * 1_500_000
    rows = [(i, f"http://a/{i}", pay(i), "", "") for i in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, block string").repartition(5)
    for sizes in ({"chunk": 3000, "file_chunks": 4}, {}):
        a, w = shared_dir(spark), shared_dir(spark)
        arc.write_arc(df, a)
        arc.convert(spark, a, w, **sizes)
        got = {r.page_id: r for r in arc.read_warc(spark, w).collect()}
        assert len(got) == 240
        last = {}
        for i, _, html, *_ in rows:
            last[html] = max(last.get(html, -1), i)
        for i, _, html, *_ in rows:
            raw, r = html.encode(), got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if last[html] == i else ("revisit", last[html]))


def test_a_source_that_holds_nearly_all_words(spark):
    rows = [(i, words(200 if i % 4 else 3, i), "en", "hot" if i % 4 else f"s{i % 12}", 0) for i in range(400)]
    got = source_mix.source_mix(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(taken) - target) <= max(0.05 * target, 256) for (_, target), taken in by.items())
