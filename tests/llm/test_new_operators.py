"""Multiset fingerprints, tokenizer links and ranked search against brute force, and on nulls, empty and very long
texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusops.llm import multiset_print as mp, term_at_a_time as taat, token_links as tl

SCHEMA = "doc_id long, text string, lang string, source string, part int, head boolean, id long, print long, row long, pairs long, key long, `group` int, rank int, item_id long"
PAD = ("en", "s", 7, True, 7, 7, 7, 7, 7, 7, 7, 7)


def words(n, seed, kinds=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" + rng.choice(["", "", ".\n", ","]) for _ in range(n))


def edge_texts():
    texts = [
        None, "", " ", "a", "ab", "one two", "One  TWO ", "two one", "x\n\ny\n", words(60, 1), words(60, 1), words(60, 1).upper(), words(3000, 3),
        "ünï cödé 日本 語 <|endoftext|> x", "▁mark", "a  b \n c\t\td  ", "don't I'll 12345 !!??", "x" * 3000, "<s> </s> <unk> \x00", "same w1 w2", "same w1 w2",
    ]
    rows = list(enumerate(texts)) + [(5, "one two"), (5, "another text of one id"), (None, words(60, 1)), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *PAD) for i, t in edge_texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- fingerprints -----------------------------------------------------------------------------------


def plain_print(text):
    """The lanes by integers, a paragraph and a run of bytes at a time."""
    strong, soft, mask = [0] * mp.STRONG, [0] * mp.SOFT, (1 << 64) - 1
    for paragraph in text.split("\n"):
        raw = paragraph.encode()
        first = hashlib.blake2b(raw).digest()
        both = first + hashlib.blake2b(first).digest()
        for k in range(mp.STRONG):
            strong[k] = (strong[k] + int.from_bytes(both[8 * k : 8 * k + 8], "little")) & mask
        hashes = [int.from_bytes(first[:8], "little")] if 0 < len(raw) < mp.GRAM else []
        for k in range(len(raw) - mp.GRAM + 1):
            h = int.from_bytes(raw[k : k + 8], "little") * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            hashes.append(h * 0xC2B2AE3D27D4EB4F & mask)
        for h in hashes:
            lane = h >> 56
            soft[lane] = (soft[lane] + (-1 if h >> 55 & 1 else 1)) & 0xFFFF
    return b"".join(x.to_bytes(8, "little") for x in strong).hex() + b"".join(x.to_bytes(2, "little") for x in soft).hex()


def test_fingerprint_equals_a_plain_restatement():
    for text in ["", "a", "ab\ncd", words(80, 2), "é" * 50 + "\n\n"]:
        assert mp.print_of(mp.paragraphs(text)).hex() == plain_print(text)


def test_fingerprint_ignores_order_and_takes_edits():
    parts = [words(20, i) for i in range(12)] + ["", "x", "x"]
    whole = mp.print_of(parts)
    assert mp.print_of(reversed(parts)).hex() == whole.hex()
    assert mp.with_edit(whole, parts[3:5], ["new", "x"]).hex() == mp.print_of([*parts[:3], *parts[5:], "new", "x"]).hex()
    assert mp.with_edit(mp.with_edit(whole, parts[:2]), (), parts[:2]).hex() == whole.hex()
    assert mp.print_of([*parts, "x"]).hex() != whole.hex()  # a multiset: how often counts
    assert (mp.print_of(parts[:5]) + mp.print_of(parts[5:])).hex() == whole.hex() == mp.Print.from_hex(whole.hex()).hex()


def test_likeness_follows_what_is_shared():
    parts = [words(40, i, 10_000).replace("\n", " ") for i in range(40)]
    prints = [mp.print_of(parts[:20]), mp.print_of(parts[10:30]), mp.print_of(parts[20:])]
    assert mp.likeness(prints[0], prints[0]) == 1.0
    assert mp.likeness(prints[0], prints[1]) == pytest.approx(0.5, abs=0.15)
    assert mp.likeness(prints[0], prints[2]) < 0.2
    assert mp.likeness(mp.print_of([""]), mp.print_of(["", ""])) == 0.0


def check_fingerprints(rows, got):
    """Rows of one doc_id follow one another in the order of a hash; the multiset of results has to fit one such order."""
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0))
    for k, i in enumerate(ids):
        mine, after = [t or "" for d, t in rows if d == i], [t or "" for d, t in rows if d == ids[(k + 1) % len(ids)]]
        have = Counter((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got if r.doc_id == i)
        fits = False
        for order in itertools.permutations(mine):
            for last in set(after):
                want = Counter()
                for text, following in zip(order, [*order[1:], last]):
                    n = len(text)
                    edited = text[: n - n // 2] + following[: n // 2]
                    a, b, c = (mp.print_of(x.split("\n")) for x in (text, edited, following))
                    want[n, hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), mp.likeness(a, b), mp.likeness(a, c)] += 1
                fits |= want == have
        assert fits, i


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_fingerprints_of_edges(docs, ranges):
    check_fingerprints(edge_texts(), mp.fingerprints(docs, ranges).collect())


def test_fingerprints_of_empty_tables_and_single_rows(spark, none):
    assert mp.fingerprints(none).count() == 0
    row = mp.fingerprints(spark.createDataFrame([(3, "abcd", *PAD)], SCHEMA)).first()
    assert (row.doc_id, row.edited_sha256, row.near_next) == (3, hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_fingerprints_where_a_third_of_the_rows_have_one_id(spark):
    rows = [(7 if i % 3 == 0 else i, f"text {i} " + words(12, i)) for i in range(300)]
    got = mp.fingerprints(spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(9), 12).collect()
    assert len(got) == 300 and Counter(r.doc_id for r in got)[7] == 101
    assert Counter(r.fingerprint for r in got) == Counter(mp.print_of(t.split("\n")).hex() for _, t in rows)
    # every row but one is followed by another: each text's first half occurs once as a replacement
    texts = [t for _, t in rows]
    possible = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest(): u for t in texts for u in texts}
    assert len({possible[r.edited_sha256] for r in got}) >= 290


def test_fingerprint_of_a_very_long_text(spark):
    rows = [(1, words(200_000, 1)), (2, "y" * 2_000_000), (3, "\n" * 1_000_000)]
    check_fingerprints(rows, mp.fingerprints(spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA)).collect())


# --- tokenizer links --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tl.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tl.PIECES)


def plain_tokens(libraries, text):
    """(id, start, end) of both tokenizers, or none."""
    a, b = libraries
    if not text:
        return [], []
    letters = {x: i for i, x in enumerate(tl.byte_letters())}
    raw = [
        [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]],
    ]
    if any(b"".join(t for _, t in x) != (" " + text).encode() for x in raw):
        return [], []
    ends = [np.cumsum([len(t) for _, t in x]).tolist() for x in raw]
    return [[(i, e - len(t), e) for (i, t), e in zip(x, ee)] for x, ee in zip(raw, ends)]


def odd_texts():
    rng = random.Random(8)
    out = [t for _, t in edge_texts()]
    out += ["".join(rng.choice("aab 's\n\t 0é,!  日ßΣ<>0x4s") for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(1, 25))) for _ in range(200)]


def test_ids_equal_the_libraries(libraries):
    both, texts = tl.Aligner(tl.BYTE_LEVEL, tl.PIECES), [t for t in odd_texts() if t]
    a, b = libraries
    assert [x.tolist() for x in both.a.ids(texts)] == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in both.b.ids(texts)] == b.encode(texts)


def test_pieces_forget_words_without_changing_ids(libraries, monkeypatch):
    monkeypatch.setattr(tl, "REMEMBERED", 8)
    pieces = tl.Pieces(tl.PIECES)
    for t in [words(200, i) + "  " for i in range(5)]:
        assert pieces.ids([t])[0].tolist() == libraries[1].encode(t)


@pytest.mark.parametrize("kind", ["ends", "overlap", "groups"])
def test_links_equal_all_pairs(libraries, kind):
    both = tl.Aligner(tl.BYTE_LEVEL, tl.PIECES)
    for text in ["Hello world, unbelievable tokenization!", "ünï cödé 日本 語", words(30, 4)]:
        a, b = plain_tokens(libraries, text)
        at = both.batch([text])
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        group = lambda end: sum(c < end for c in common)
        weight = {
            "ends": lambda x, y: int(x[2] == y[2]),
            "overlap": lambda x, y: max(0, min(x[2], y[2]) - max(x[1], y[1])),
            "groups": lambda x, y: int(group(x[2]) == group(y[2])),
        }[kind]
        want = [(i, j, w) for i, x in enumerate(a) for j, y in enumerate(b) if (w := weight(x, y))]
        assert list(zip(*(x.tolist() for x in tl.links(at.a_ends, at.b_ends, kind)))) == want


def test_product_of_random_matrices():
    rng = np.random.default_rng(5)
    for _ in range(20):
        dense = [rng.random((rng.integers(1, 9), 12)) < 0.3 for _ in range(2)]
        csr = [tl.Csr(np.append(0, np.cumsum(d.sum(1))), np.nonzero(d)[1], 12) for d in dense]
        rows, cols, values = tl.product(csr[0], csr[1].transposed())
        out = np.zeros((len(dense[0]), len(dense[1])), int)
        out[rows, cols] = values
        assert (out == dense[0].astype(int) @ dense[1].T.astype(int)).all() and (values > 0).all()


def plain_digests(libraries, rows):
    tokens = [plain_tokens(libraries, t) for _, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if a else [] for a, b in tokens]
    count = Counter(itertools.chain.from_iterable(links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for (doc_id, _), (a, b), mine in zip(rows, tokens, links):
        cuts = [0, *sorted({e for *_, e in a} & {e for *_, e in b})]
        groups = ["|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip(cuts, cuts[1:])]
        yield (
            str(doc_id), len(a), len(b), len(groups), len(mine), sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )


def test_link_digests_equal_all_pairs(spark, libraries):
    rows = [*edge_texts(), *enumerate([t if len(t or "") < 4000 else "" for t in odd_texts()], 100)]
    rows = [(i, t if len(t or "") < 4000 else t[:1500]) for i, t in rows]
    got = tl.link_digests(spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(3)).collect()
    mine = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert mine == sorted(plain_digests(libraries, rows))


def test_link_digests_do_not_depend_on_the_join(docs, monkeypatch):
    want = sorted(map(str, tl.link_digests(docs).collect()))
    monkeypatch.setattr(tl, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(tl, "BATCH_BYTES", 50)
    assert sorted(map(str, tl.link_digests(docs).collect())) == want


@pytest.mark.parametrize("kind", ["overlap", "groups"])
def test_other_links_by_document(docs, libraries, kind):
    got = {r.text_row: r for r in tl.aligned(docs, kind).withColumnRenamed("doc_id", "text_row").collect() if r.text_row in (5, 9, 13)}
    for i in (9, 13):
        a, b = plain_tokens(libraries, dict(edge_texts())[i])
        if kind == "overlap":
            want = Counter(x[0] * 32000 + y[0] for x in a for y in b if min(x[2], y[2]) > max(x[1], y[1]))
            assert dict(zip(got[i].pairs, got[i].times)) == want
        assert sum(got[i].times) == got[i].n_links >= got[i].n_groups


def test_links_of_empty_tables_and_very_long_texts(spark, none, libraries):
    assert tl.link_digests(none).count() == 0
    text = words(150_000, 6)
    row = tl.link_digests(spark.createDataFrame([(1, text, *PAD)], SCHEMA)).first()
    assert (row.n_a, row.n_b) == (len(libraries[0].encode(" " + text, add_special_tokens=False).ids), len(libraries[1].encode(text)))
    assert row.n_links == row.n_groups > 100_000


def test_bound_on_pairs_that_end_together():
    tokens = [[b"ab", b"b", b"a", b"b"], [b"b", b"cab", b""]]
    a, b = tokens
    ends = sum(x.endswith(y) or y.endswith(x) for x in a for y in b if x and y)
    assert tl.pair_bound(a, b[:2]) == ends


# --- ranked search ----------------------------------------------------------------------------------


def plain_search(rows, items, k=10):
    term = re.compile(taat.TERM)
    fold = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in term.findall(t or "")]
    docs = [(i, Counter(w), len(w)) for i, t in rows if (w := fold(t))]
    n, length, df = len(docs), sum(x[2] for x in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c, size in docs:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in fold(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(str(item_id), r, str(x[3]), -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def items_table(spark, items):
    return spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, `key` string, rank int")


def found(df):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())


ITEMS = [(1, "w1 w2 w2 W3 same"), (2, ""), (3, None), (4, "nothing holds these"), (1, "one two"), (None, "ünï 日本 w9"), (5, words(400, 77)), (6, "x y é!"), (7, "same same")]


@pytest.mark.parametrize("item_terms", [taat.ITEM_TERMS, 40])
def test_search_of_edges(spark, docs, item_terms):
    assert found(taat.search(docs, items_table(spark, ITEMS), item_terms=item_terms)) == plain_search(edge_texts(), ITEMS)


def test_search_of_empty_tables(spark, docs, none):
    assert taat.search(none, items_table(spark, ITEMS)).count() == 0
    assert taat.search(docs, items_table(spark, ITEMS).where("false")).count() == 0


def corpus(n, seed):
    """Zipf-like words, a third of the rows one text, some long texts."""
    rng = random.Random(seed)
    text = lambda size: " ".join(f"t{int(1.12 ** rng.uniform(0, 60))}" for _ in range(size))
    same = text(30)
    return [(i, same if i % 3 == 0 else text(rng.choice([3, 20, 60, 900]))) for i in range(n)]


def test_search_in_small_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(taat.index, "__defaults__", (2000,))
    rows = corpus(900, 3)
    items = [(q, " ".join(f"t{int(1.12 ** random.Random(q * 99 + j).uniform(0, 60))}" for j in range(1 + q % 30))) for q in range(40)]
    df = spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(7)
    assert found(taat.search(df, items_table(spark, items))) == plain_search(rows, items)


def test_accumulators_are_limited_and_scores_exact():
    rows = corpus(3000, 5)
    import pyarrow as pa

    terms = [t.decode() for t in sorted({w for _, t in rows for w in taat.terms_of(t)})]
    numbers = {t.encode(): i for i, t in enumerate(terms, 1)}
    row = taat.block_of(pa.array([i for i, _ in rows], pa.int64()), [t for _, t in rows], numbers)
    names = [c.split()[0] for c in taat.INDEX.split(", ")]
    block_row = {n: pa.array(v) for n, v in zip(names[2:], row[2:])}
    df = dict(zip(row[4].tolist(), row[5].tolist()))
    weight = np.array([0] + [math.floor(1000 * math.log((2 * 3000 + 2) / (2 * df[i] + 1))) for i in range(1, len(terms) + 1)])
    block = taat.weighted(block_row, weight, row[0], row[1])
    rare = sorted(df, key=df.get)
    item = taat.Item(0, 0, sorted([(t, 1) for t in [*rare[:3], *rare[-12:]]], key=lambda x: (df[x[0]], x[0])))
    sums, has = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), bool)
    docs, made = taat.accumulate(block, item, 10, 0, sums, has)
    assert made < 15 and len(docs) < len(block.ids)  # it stopped making accumulators
    exact = np.zeros(len(block.ids), np.int64)
    for t, _ in item.terms:
        lo, hi = block.starts[block.asked[t]], block.starts[block.asked[t] + 1]
        np.add.at(exact, block.postings[lo:hi], block.gives[lo:hi])
    assert (sums[docs] == exact[docs]).all()
    assert set(taat.best_of(exact, block.no_id, block.ids, 10).tolist()) <= set(docs.tolist())
    none, made = taat.accumulate(block, item, 10, int(exact.max()) * 100, np.zeros_like(sums), np.zeros_like(has))
    assert len(none) == made == 0  # a block that can't give enough is skipped


def test_search_of_a_very_long_text(spark):
    rows = [(1, "rare " + "word " * 800_000), (2, "rare word"), (3, "é" * 500_000)]
    items = [(1, "rare word"), (2, "é" * 500_000)]
    df = spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA)
    assert found(taat.search(df, items_table(spark, items))) == plain_search(rows, items)
