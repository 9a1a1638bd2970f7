"""Sharding, archives, tokens, quality, packing, neighbours and the pipeline against plain versions."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from snapcat.llm import ann, bpe, packing, quality, repair, sharding, token_files, tokens, warc
from snapcat.llm.queries import QUERIES
from tests.llm import brute

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE_JSON)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


# sharding


def test_shards_hold_the_law_and_groups(spark):
    rng = random.Random(2)
    texts = [f"text {k}" for k in range(300)] + [f"copy {k % 30}" for k in range(150)] + ["hot"] * 260 + [None, "", None]
    rng.shuffle(texts)
    rows = sharding.shard_documents(brute.documents(spark, texts), 8).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    where = defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for k, v in where.items() if (k or "").startswith("copy")) <= 8  # a quota's edge may part one
    assert len(where["hot"]) <= 5  # three shards' worth, and what was full before


@pytest.mark.parametrize("copies", [2, 5, 100])
def test_shards_where_every_row_has_a_copy(spark, copies):
    texts = [f"text {k // copies}" for k in range(800)]
    random.Random(5).shuffle(texts)
    rows = sharding.shard_documents(brute.documents(spark, texts), 8).collect()
    assert set(Counter(r["shard"] for r in rows).values()) == {100}
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_full_shards_exchange_rows(spark):
    rng = random.Random(8)
    shard = [k % 4 for k in range(240)]
    rng.shuffle(shard)
    links = [(k, f"{j}-{rng.randrange(3)}-{k // 30}") for k in range(240) for j in range(4)]  # eight groups without free room
    links = spark.createDataFrame(links, "rid BIGINT, key STRING").distinct()
    labels = spark.createDataFrame(list(enumerate(shard)), "rid BIGINT, shard INT")
    got = dict(map(tuple, sharding.propagate(links, 4, 60, labels).collect()))
    assert set(Counter(got.values()).values()) == {60}
    near = lambda s: np.mean([s[a] == s[b] for a in range(240) for b in range(240) if a < b and a // 30 == b // 30])
    assert near(shard) < 0.3 and near(got) > 0.6


def test_grants_keep_shards_within_room():
    assert sharding.grants({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding.grants({(0, 1): 5, (1, 2): 4, (2, 0): 2}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert sharding.grants({(0, 1): 5, (1, 2): 4}, [0, 0, 3]) == {(0, 1): 3, (1, 2): 3}
    assert sharding.grants({(0, 1): 5}, [0, 0]) == {}


def test_shards_of_messy_and_empty_tables(spark):
    docs = brute.documents(spark, messy=True)
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == docs.count() and {r["shard"] for r in got} == {0, 1, 2}
    assert sharding.shard_documents(brute.empty(spark), 3).count() == 0


# archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, digest STRING, payload STRING, response STRING")


def test_archives_round_trip(spark):
    long, other = "é" * 700, "x" * 5000
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://c/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "")]
    rows += [(7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", "only " * 400)]
    manifest = warc.write_archives(pages(spark, [(*r, "c", "c", "c") for r in rows]), archive_bytes=2000)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        refers = {1: 2, None: 7 if html == other else None}.get(page_id)
        kind = "revisit" if refers is not None else "response"
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), kind, refers, None if kind == "revisit" else raw))
    key = lambda r: str(r)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted([tuple(r[c] if c != "payload" or r[c] is None else bytes(r[c]) for c in columns) for r in got], key=key) == sorted(
        want, key=key
    )
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_archives_are_gzip_members_of_one_record():
    data = [warc.record(k, "u", bytes([65 + k]) * 3000, None, "d") for k in range(3)]
    assert all(gzip.decompress(d).startswith(b"WARC/1.1\r\n") for d in data)
    found = list(warc.Records(io.BytesIO(b"".join(data))))
    assert [warc.parsed(*r)[0] for r in found] == [0, 1, 2] and all(warc.parsed(*r)[-1] for r in found)
    damaged = gzip.decompress(data[0]).replace(b"A" * 3000, b"A" * 2999 + b"B")
    assert not warc.parsed(*next(iter(warc.Records(io.BytesIO(gzip.compress(damaged))))))[-1]
    for broken in (data[0][:-20], gzip.compress(gzip.decompress(data[0]) * 2), gzip.compress(b"no record"), gzip.compress(b"x\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error, KeyError)):
            list(warc.Records(io.BytesIO(broken)))


# tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n\t.,'"), max_size=40), max_size=4))
def test_pieces_equal_the_library(texts):
    codec = tokens.encoder(BPE_JSON)
    assert codec.encode(texts) == [codec.wholes([t])[0] if t else b"" for t in texts]


def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = brute.documents(spark, messy=True)
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for (doc_id, text), n in texts.items():
        raw = np.array(want.encode_ordinary(text or ""), dtype="<u4").tobytes()
        row = (doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), raw)
        expected[row] += n
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == expected
    assert bpe.encode_documents(brute.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def long_words() -> list[str]:
    rng = random.Random(7)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=499))
    return [
        (letters * 2005)[:1_000_000],
        "".join(rng.choices("eeettaaooinshr", k=5000)),
        "a" * 777 + "".join(rng.choices("ab", k=3000)) + "abc" * 999,
        *[(unit * 5000)[:5000] for unit in ("=", "ab", "aab", "the", "хорошо", "日本", "\n")],
    ]


def test_long_words_equal_tiktoken():
    library = tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(RANKS), special_tokens={}
    )
    coder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for word in long_words():
        assert np.frombuffer(coder.encode([word])[0], "<u4").tolist() == library.encode_ordinary(word)


def test_blocks_that_never_meet_end_as_the_whole_word(monkeypatch):
    coder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    word = "".join(random.Random(3).choices("abcdefgh", k=900)).encode()
    whole = coder.contract([word])[0]
    assert coder.contract_long([word]) == [whole]
    joined, sizes = coder.joined, []

    def never(word, size, blocks):
        sizes.append(size)
        return joined(word, size, blocks) if size >= len(word) else None

    monkeypatch.setattr(coder, "joined", never)
    assert coder.contract_long([word]) == [whole] and sizes == [bpe.BLOCK, 2 * bpe.BLOCK, 4 * bpe.BLOCK]



@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=12), st.integers(2, 5))
def test_repair_round_trip(docs, least):
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    shard = repair.Shard(repair.to_bytes(flat, np.array([len(d) for d in docs], dtype=np.int64), 6, least))
    assert [d.tolist() for d in shard.documents(16)] == docs
    for start in range(0, len(flat), 7):
        assert shard.read(start, 5).tolist() == flat[start : start + 5].tolist()
    if len(shard.symbols) > 1:
        assert len(shard.symbols) <= len(flat)


def test_repair_leaves_no_frequent_pair():
    flat = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3] * 50, dtype=np.uint32)
    rules, seq = repair.compress(flat, 10, 8)
    assert max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)).values()) < 8 and len(rules)
    assert repair.expand(seq, rules, 10).tolist() == flat.tolist()


def test_repair_goes_on_until_no_pair_pays(spark):
    rng = random.Random(6)
    phrases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rng.choice(phrases) for _ in range(40)) for _ in range(100)]  # each phrase about ten times
    manifest = token_files.write_shards(brute.documents(spark, texts).coalesce(1), BPE_JSON)
    assert sorted(r["doc_id"] for r in token_files.read_shards(manifest).collect()) == list(range(100))
    written = 0
    for r in manifest.collect():
        written += len(data := token_files.files.read_bytes(r["path"]))
        symbols = repair.Shard(data).symbols.tolist()
        assert max(Counter(zip(symbols[:-1], symbols[1:], strict=True)).values()) < 3
    assert written < manifest.agg(F.sum("n_ids")).first()[0]  # before: above two bytes an id


def test_pieces_met_again_are_kept_when_memory_is_full(monkeypatch, library):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdegiklmnorstuäé") for _ in range(9))
    common = [word() for _ in range(30)]
    texts = [" ".join(["x", *common, *(word() + rng.choice([",", "", ".", "\nÄ"]) for _ in range(20))]) for _ in range(12)]
    texts[5:5] = [None, "", "two  spaces", common[0], "tail "]
    codec, learned = tokens.Encoder(BPE_JSON), []
    learn = codec.learn_words
    codec.learn_words = lambda pieces: (learned.extend(pieces), learn(pieces))[1]
    want = [library(t).tobytes() for t in texts]
    assert [codec.encode([t])[0] for t in texts] == want
    assert max(Counter(learned).values()) == 1  # before: all anew
    monkeypatch.setattr(tokens, "TURN", 100)
    assert tokens.Encoder(BPE_JSON).encode(texts) == want


def test_repair_counts_only_what_can_be_frequent(monkeypatch):
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 900, rng.integers(1, 7)) for _ in range(3000)]
    flat = np.concatenate([words[min(int(rng.zipf(1.2)), 3000) - 1] for _ in range(20000)]).astype(np.uint32)
    looked = []
    for name in ("bincount", "unique"):
        whole = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *rest, f=whole, **more: (looked.append(len(a)), f(a, *rest, **more))[1])
    rules, seq = repair.compress(flat, 900, 3)
    monkeypatch.undo()
    assert repair.expand(seq, rules, 900).tolist() == flat.tolist()
    assert max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)).values()) < 3
    assert sum(looked) < 6 * len(flat)  # before: every pair in every round


@pytest.mark.parametrize("ids", [[7] * 5000, [1, 2] * 4000, [1, 2, 1, 1] * 3000, list(range(4)) * 20000])
def test_repair_writes_out_long_rules(ids):
    lengths = np.array([0, len(ids) // 3, 0, len(ids) - len(ids) // 3])
    shard = repair.Shard(repair.to_bytes(np.array(ids, dtype=np.uint32), lengths, 10, 3))
    assert shard.sizes.max() > repair.FLAT
    got = [d.tolist() for d in shard.documents(1000)]
    assert list(map(len, got)) == lengths.tolist() and sum(got, []) == ids
    assert shard.read(11, 90).tolist() == ids[11:101]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_values_in_bits(bits):
    values = np.array([0, 1, 2**bits - 1, 5 % 2**bits, 2 ** (bits - 1)], dtype=np.uint32)
    got, end = repair.unpacked(b"ab" + repair.packed(values, bits) + b"c", 2, 5, bits)
    assert got.tolist() == values.tolist() and end == 2 + (5 * bits + 7) // 8


def test_token_shards(spark, library):
    docs = brute.documents(spark, messy=True)
    manifest = token_files.write_shards(docs, BPE_JSON, shard_ids=2000)
    got = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 3 and len(got) == docs.count()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.append(library(r["text"]), 0).astype("<u4").tobytes())
    start = 0
    for r in got:
        raw = bytes(r["ids"])
        texts[r["doc_id"]].remove(raw)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(raw) // 4, zlib.crc32(raw))
        start += r["n_tokens"]
    first = manifest.orderBy("start").first()
    wanted = spark.createDataFrame([(first["path"], 5, 20)], "path STRING, skip BIGINT, length BIGINT")
    everything = b"".join(bytes(r["ids"]) for r in got)
    assert bytes(token_files.read_ids(spark, manifest, wanted).first()["ids"]) == everything[20:100]
    assert token_files.read_shards(token_files.write_shards(brute.empty(spark), BPE_JSON)).count() == 0


def test_queries_leave_special_tokens_to_the_library(spark, tmp_path):
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "plain words, and more.", " <|endoftext|>  two", None, "<|endof text|>"]
    plain = Tokenizer.from_file(BPE_JSON)
    ids = [np.append(plain.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4").tobytes() for t in texts]
    assert np.frombuffer(ids[0], "<u4").tolist() == [64, 220, 50256, 275, 0]
    docs = brute.documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: (len(raw) // 4, zlib.crc32(raw)) for k, raw in enumerate(ids)}
    shards = QUERIES["op7_token_shards"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in shards} == want
    pieces = QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    for r in pieces:
        piece = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["doc_tokens"] == want[r["doc_id"]][0] and r["ids_crc32"] == zlib.crc32(piece)
    packed_ids = corpus_pipeline.packing_stage(spark, docs, "").where("start = 0").collect()
    assert all(bytes(r["ids"]) == ids[r["doc_id"]][: 4 * r["length"]] for r in packed_ids)


# quality


def test_quality_equals_sql(spark):
    docs = brute.documents(spark, messy=True)
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toPandas())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = db.execute(quality.oracle_sql()).fetchall()
    got = [tuple(r) for r in quality.with_quality(docs.drop("n_words")).select(*columns).collect()]
    same = lambda rows: Counter(tuple(None if x != x else x for x in r) for r in rows)
    assert same(got) == same(want)
    assert quality.with_quality(brute.empty(spark).drop("n_words")).count() == 0


def test_line_rules(spark):
    lines = {"The end.": False, "He said “so.”": False, "no end": True, "Home | News | About | Contact.": True, "We use Cookies.": True}
    rows = spark.createDataFrame([(k,) for k in lines], "l STRING").select("l", quality.failing_line(F.col("l")).alias("f"))
    assert dict(map(tuple, rows.collect())) == lines


def test_long_lines_are_not_judged_by_a_part(spark):
    prose = " ".join(f"Sentence {k} of a paragraph that goes on for a while." for k in range(12))
    lines = {f"{prose} It was {phrase} at https://www.example.com/2024/05/x that day.": False for phrase in quality.BOILERPLATE}
    lines |= {f"Please, {phrase}!": True for phrase in quality.BOILERPLATE}
    lines |= {
        "See https://www.example.com/2024/05/x/y.": False,
        "The blog in the catalog index.": False,
        "A recipe for a cookie in javascript.": False,
        f"{prose} One | two | three | four.": False,
        "Début | Été | Hiver | Fin.": True,
        "Élog in.": False,
        "a | b | c | d | e and then a much longer tail that is no menu item at all, it only goes on and on, and on again.": False,
    }
    rows = spark.createDataFrame([(k,) for k in lines], "l STRING").select("l", quality.failing_line(F.col("l")).alias("f"))
    assert dict(map(tuple, rows.collect())) == lines
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id LONG, text STRING")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    got = quality.with_quality(docs).select("doc_id", "kept").collect()
    assert dict(map(tuple, got)) == {r[0]: r[-1] for r in db.execute(quality.oracle_sql()).fetchall()}


def test_rejected_documents_go_whole(spark):
    good = " ".join(f"word{k}." for k in range(30))
    texts = [good, good + "\n" + " ".join(f"m{k}" for k in range(200)), "short.", None, good.replace(".", ".\n")]
    docs = brute.documents(spark, texts)
    kept = quality.reject(docs)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == [0, 4]


# packing


def packed(rows, limit, library, texts):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    filled = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit
        filled.append(at)
    for doc_id, text in enumerate(texts):
        raw = np.append(library(text), 0).astype("<u4").tobytes()
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            piece = raw[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert r["start"] == at and bytes(r["ids"]) == piece and r["ids_crc32"] == zlib.crc32(piece)
            assert r["doc_tokens"] == len(raw) // 4
            at += r["length"]
        assert 4 * at == len(raw)
    return filled


@pytest.mark.parametrize("limits", [(1024, 64, 1024), (128, 4, 100), (64, 1, 64)])
def test_packing(spark, library, limits):
    texts = brute.awkward_texts()
    rows = packing.pack_documents(brute.documents(spark, texts).coalesce(2), BPE_JSON, *limits).collect()
    filled = packed(rows, limits[0], library, texts)
    padding = sum(limits[0] - n for n in filled if n & (n - 1))
    if limits[2] >= limits[0]:
        assert padding <= 0.01 * sum(filled) and max(filled) == limits[0]
    for n in Counter(r["sequence_id"] for r in rows).values():
        assert n <= limits[1]
    loss = Counter()
    for r in rows:
        loss[r["sequence_id"]] += r["loss_tokens"]
    assert max(loss.values()) <= limits[2]
    assert packing.pack_documents(brute.empty(spark), BPE_JSON).count() == 0


def test_examples_stay_whole(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 90), rng.randint(0, 60)) for k in range(500)] + [(500, 300, 10), (501, None, None), (502, 40, None)]
    df = spark.createDataFrame(rows, "example_id BIGINT, n_tokens BIGINT, n_prompt BIGINT")
    got = packing.pack_examples(df.coalesce(1), 128, 4, 60).collect()
    assert Counter(r["example_id"] for r in got if r["example_id"] < 500 and rows[r["example_id"]][1] <= 60).most_common(1)[0][1] == 1
    sums, loss, count = Counter(), Counter(), Counter()
    for r in got:
        sums[r["sequence_id"]] += r["length"]
        loss[r["sequence_id"]] += r["length"] - min(max((rows[r["example_id"]][2] or 0) - r["start"], 0), r["length"])
        count[r["sequence_id"]] += 1
    assert max(sums.values()) <= 128 and max(loss.values()) <= 60 and max(count.values()) <= 4
    total = Counter()
    for r in got:
        total[r["example_id"]] += r["length"]
    assert total == Counter({k: n for k, n, _ in rows if n})


# neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, list STRING, key STRING, score STRING")


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours(spark, unit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[:120] = x[0]  # a third of the queries' own vector
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist(), "c", "c", "c") for k, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0])]
    rows += [(*o, "c", "c", "c") for o in odd] + [rows[5], (None, x[3].tolist(), "c", "c", "c")]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    wide, recall = x.astype(np.float64), []
    for q, found in got.items():
        found.sort()
        score = np.array([ann.inner_products(wide[q : q + 1], v[None])[0] for v in wide])
        order = [k for k in np.lexsort((np.arange(900), -score)).tolist() if k != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and q not in [v for _, v, _ in found]
        recall.append(len({v for _, v, _ in found} & set(order)) / 20)
    assert np.mean(recall) >= 0.9


def test_one_longer_vector_hides_no_others(spark):
    rows = [(k, [float(k + 1), 1.0], "c", "c", "c") for k in range(30)] + [(40, [1.0, 2.0, 3.0], "c", "c", "c")]
    got = ann.nearest(vectors(spark, rows)).collect()
    assert {r["query_id"] for r in got} == {0, 20} and len(got) == 40 and 40 not in {r["vec_id"] for r in got}


def test_ties_at_the_cut_go_to_the_smallest_ids(spark):
    rng = random.Random(9)
    bits = [[1.0] + [float(k >> j & 1) for j in range(6)] for k in range(1, 61)]
    ids = list(range(1, 61))
    rng.shuffle(ids)
    ids = [k + (k >= 20) + (k >= 39) + (k >= 58) for k in ids]  # none asks
    rows = [(0, [1.0] + [0.0] * 6, "c", "c", "c")] + [(k, v, "c", "c", "c") for k, v in zip(ids, bits, strict=True)]
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in ann.nearest(vectors(spark, rows)).collect()}
    assert got == {n + 1: (k, 1.0) for n, k in enumerate(sorted(ids)[:20])}


def test_few_and_no_vectors(spark):
    rows = [(k, [float(k + 1), 1.0], "c", "c", "c") for k in (0, 1, 20)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(vectors(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 20, 22.0), (0, 2, 1, 3.0), (20, 1, 1, 43.0), (20, 2, 0, 22.0)]
    assert ann.nearest(vectors(spark, [])).count() == 0


# pipeline


def test_pipeline(spark, library):
    texts = brute.awkward_texts()
    docs = brute.documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], "").cache())
    assert all(f.columns == docs.columns for f in frames[:4])
    good = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality.with_quality(docs).collect()}
    assert set(good) == {k for k, v in verdicts.items() if v}
    ids = sorted(good)
    want, _ = brute.component_ids([good[k] for k in ids], 5, 80)
    one = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    assert one == {ids[k]: good[ids[k]] for k in set(want)}
    ids = sorted(one)
    cut = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    for k, gone in zip(ids, brute.window_mask([one[k] for k in ids]), strict=True):
        assert brute.words(cut[k]) == [w for w, g in zip(brute.words(one[k]), gone, strict=True) if not g]
    rows = frames[4].collect()
    again = [cut[k] for k in ids]
    number = {k: n for n, k in enumerate(ids)}
    plain = [r.asDict() | {"doc_id": number[r["doc_id"]]} for r in rows]
    packed(plain, 1024, library, again)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
