"""Joins and removal of repeated text against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcat.llm import fm_index, ngram_join, repeats, rolling, substring, suffix_dedup
from snapcat.llm.shared import components, numbered
from tests.llm import brute


def near_group(n=120, seed=5):
    """A group of near copies, most of them below the similarity of each other but some of them chained."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    out = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"e{k}-{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out + [f"common line of many words here {k} tail {k * 7} end {k * 3}" for k in range(60)]


def rows_by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("texts", [brute.awkward_texts(), near_group(), near_group(40, 9) * 2], ids=["awkward", "near", "copies"])
@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_join(spark, monkeypatch, texts, k, percent):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    want, sizes = brute.component_ids(texts, k, percent)
    got = rows_by_id(ngram_join.join(brute.documents(spark, texts), k, percent), "n_shingles", "component_id")
    assert got == {i: (sizes[i], want[i]) for i in range(len(texts))}


def test_join_without_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 0)
    texts = near_group(60)
    want, sizes = brute.component_ids(texts)
    got = rows_by_id(ngram_join.join(brute.documents(spark, texts)), "n_shingles", "component_id")
    assert got == {i: (sizes[i], want[i]) for i in range(len(texts))}


def parity_words(n: int) -> list[str]:
    """Two words of n letters with few equal places: the parity of the ones of each place, and its complement. Every
    polynomial modulo 2^64 gives them one hash from n = 1024 on."""
    ones = [bin(k).count("1") % 2 for k in range(n)]
    return ["".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)]


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_that_polynomials_confuse(spark, n):
    one, two = parity_words(n)
    texts = [one, two, f"{one} a b c d", f"{two} a b c d", f"{one} a b c d"]
    for join in (lambda d: ngram_join.join(d), lambda d: ngram_join.join(d, 5, 80)):
        got = rows_by_id(join(brute.documents(spark, texts)), "component_id")
        assert got == {0: (0,), 1: (1,), 2: (2,), 3: (3,), 4: (2,)}
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    hashes = rolling.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]


def test_word_hashes_depend_on_bytes_only():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    where = {}
    for shuffled in (words, words[::-1]):
        data = np.frombuffer(b"".join(shuffled), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in shuffled])
        for w, h in zip(shuffled, rolling.word_hashes(data, ends - [len(w) for w in shuffled], ends).tolist(), strict=True):
            assert where.setdefault(w, h) == h
    assert len(set(where.values())) == len(where)


def test_join_of_messy_rows(spark):
    docs = brute.documents(spark, messy=True)
    got = ngram_join.join(docs).collect()
    assert len(got) == docs.count()
    taken = [r for r in got if r["doc_id"] == 7]
    assert len(taken) == 2 and len({r["component"] for r in taken}) == 2
    assert len({r["component"] for r in got if r["doc_id"] == 3}) <= 1 + (brute.words(brute.awkward_texts()[3]) == [])
    assert ngram_join.join(brute.empty(spark)).count() == 0


def test_representatives_keep_columns(spark):
    texts = near_group(30)
    docs = brute.documents(spark, texts)
    want, _ = brute.component_ids(texts, 5, 80)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert ngram_join.representatives(brute.empty(spark)).count() == 0


def test_pivots_do_not_see_the_square_of_a_group(spark):
    """Candidates of a group of near copies: pairs with a pivot, not all pairs."""
    texts = near_group(400, 11)
    docs = repeats.identified(brute.documents(spark, texts))
    sets = ngram_join.prefixes(docs, 4, 85)
    rows = ngram_join.bucketed(sets)
    star = rows.where("rid <> pivot").select("rid", "pivot").distinct().count()
    assert star < 400 * 399 / 20


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1], ids=["sorted", "rows"])
def test_suffix_dedup(spark, most):
    texts = brute.awkward_texts()
    got = rows_by_id(
        suffix_dedup.dedup(brute.documents(spark, texts), most=most), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"
    )
    want = brute.suffix_rows(texts)
    assert {k: v[:4] for k, v in got.items()} == dict(enumerate(want))
    assert all(hashlib.sha256(v[4]).hexdigest() == v[3] for v in got.values())


def test_suffix_dedup_of_messy_rows(spark):
    docs = brute.documents(spark, messy=True)
    got = suffix_dedup.dedup(docs, with_text=False).collect()
    assert len(got) == docs.count()
    first = [r for r in got if r["doc_id"] is None]
    assert all(r["n_removed"] == 0 or r["n_bytes"] for r in first)
    again = sorted(r["n_removed"] for r in got if r["doc_id"] == 3)
    size = len((brute.awkward_texts()[3] or "").encode())
    assert again[1:] == ([size] * 2 if size >= 100 else [0] * 2)
    assert suffix_dedup.dedup(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("most", [substring.MOST, 1], ids=["index", "rows"])
def test_substring_dedup(spark, most):
    texts = brute.awkward_texts()
    got = rows_by_id(
        substring.dedup(brute.documents(spark, texts), most=most), "n_words", "n_removed", "kept_sha256", "cut"
    )
    for k, (text, gone) in enumerate(zip(texts, brute.window_mask(texts), strict=True)):
        left = [w for w, g in zip(brute.words(text), gone, strict=True) if not g]
        assert got[k][:3] == (len(gone), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
        assert brute.words(got[k][3]) == left
        if not sum(gone):
            assert got[k][3] == text


def test_cut_documents(spark):
    docs = brute.documents(spark, messy=True)
    out = substring.cut_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert substring.cut_documents(brute.empty(spark)).count() == 0
    assert substring.dedup(brute.empty(spark)).count() == 0


def test_line_breaks_beside_cuts_stay():
    raw = b"a b\nc d e\nf"
    found = list(substring.WORD.finditer(raw))
    assert substring.without(raw, found, [False, False, True, True, True, False]) == b"a b\nf"
    assert substring.without(raw, found, [False, True, False, False, False, False]) == b"a\nc d e\nf"
    assert substring.without(raw, found, [True, False, False, True, False, True]) == b"b\nc e"
    assert substring.without(raw, found, [True] * 6) == b""


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 300)
    index = fm_index.Index(text, np.array([120, 300]))
    for width in (1, 2, 3):
        for at in range(0, 290, 7):
            word = text[at : at + width]
            low, high = np.array([0]), np.array([index.size])
            for symbol in word[::-1]:
                low, high = index.extend(np.searchsorted(index.names, [symbol]), low, high)
            parts = (text[:120], text[120:])
            count = sum((p[i : i + width] == word).all() for p in parts for i in range(len(p) - width + 1))
            if at + width <= 120 or at >= 120:
                assert high[0] - low[0] == count


def test_runs_of_equal_windows_share_keys():
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.integers(97, 100, 400).tolist()) + b"abcabcabc" * 30, np.uint8)
    bounds = np.array([0, 10, 10, 200, len(data)])
    doc, first, count, key = rolling.runs(data, bounds, 4, 12)
    at = {}
    for d, f, n, k in zip(doc, first, count, key, strict=True):
        for i in range(n):
            at[int(bounds[d] + f + i)] = int(k)
    assert sorted(at) == [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - 11)]
    by_text = {}
    for i, k in at.items():
        assert by_text.setdefault(data[i : i + 12].tobytes(), k) == k


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = dict(components(spark, spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect())
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark, spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = numbered(df, "g", "v", into="n", name="t").collect()
    for g in range(3):
        rows = sorted((r["v"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in rows] == list(range(len(rows)))


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for size, changed in ((1, 0), (4, 1), (60, 9), (60, 40), (900, 30), (900, 800)):
        x = rng.choice(pool, size, replace=False)
        y = np.concatenate([x[changed:], rng.integers(0, 1 << 64, changed, dtype=np.uint64)])
        both = ngram_join.parities(np.concatenate([x, y]), np.array([0, len(x), len(x), len(x) + len(y)]))
        differing = sum(int(np.bitwise_count((p[0] ^ p[2]).view(np.uint64))) for p in both)
        assert [int(p[1]) for p in both] == [0, 0, 0, 0]
        assert differing <= len(np.setxor1d(x, y))
        if not changed:
            assert differing == 0


@pytest.mark.parametrize("unit", [repeats.Bytes(5, 3), repeats.Words(3, 2)])
def test_cuts_of_many_texts_at_once(unit):
    """All cuts of a batch are one array, equal to those of each text by itself."""
    texts = [b"", b"one two  three\tfour five", b" a b c d\n", b"x", "né né né né".encode(), b"last words of this"]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = [len(t.split()) if isinstance(unit, repeats.Words) else len(t) for t in texts]
    places = [(d, s, n) for d, size in enumerate(sizes) for s in range(size) for n in range(1, size - s - unit.window + 2)]
    text, starts, counts = map(np.array, zip(*places, strict=True))
    want = []
    for d, s, n in places:
        end = s + n + unit.window - 1
        want.append(b" ".join(texts[d].split()[s:end]) if isinstance(unit, repeats.Words) else texts[d][s:end])
    assert unit.cuts(data, offsets, text, starts.astype(np.int32), counts.astype(np.int32)).to_pylist() == want


def test_buckets_of_the_same_sets_are_compared_once(spark):
    buckets = {1: "ab", 2: "ab", 3: "abc", 4: "cb", 5: "ab", 6: "bc", 7: "dd", 8: "de"}
    rows = [(key, key == 5, ord(x), ord("d" if x == "e" else x)) for key, sets in buckets.items() for x in dict.fromkeys(sets)]
    got = ngram_join.open_buckets(spark.createDataFrame(rows, "key BIGINT, pairs BOOLEAN, rid BIGINT, c BIGINT"))
    assert sorted(map(tuple, got.collect())) == [(1, False), (3, False), (4, False), (5, True)]
