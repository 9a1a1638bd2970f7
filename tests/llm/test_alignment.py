"""Alignment of two tokenizers against a plain version by whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from snapcat.llm import alignment
from snapcat.llm.alignment import align_documents, byte_characters, pack, planes_of, presence, unpack, unpacked
from snapcat.llm.queries import QUERIES

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    to_byte = {c: i for i, c in enumerate(byte_characters())}
    return a, b, {i: bytes(to_byte.get(c, 0) for c in t) for t, i in a.get_vocab().items()}


def plain(libraries, texts):
    """Facts, digest and links of each text, then the counts of the corpus."""
    a, b, a_bytes = libraries
    found = []
    for text in texts:
        none = (0, 0, 0, 0, "", [])
        if not text:
            found.append(none)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb = [a_bytes[i] for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(xb) == b"".join(yb) == (" " + text).encode():
            found.append(none)
            continue
        ranges = lambda parts: list(zip(np.cumsum([0] + list(map(len, parts)))[:-1].tolist(), np.cumsum(list(map(len, parts))).tolist()))
        xr, yr = ranges(xb), ranges(yb)
        links, j0 = [], 0
        for i, (s, e) in enumerate(xr):
            while yr[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(yr) and yr[j][0] < e:
                links.append((x[i], y[j]))
                j += 1
        cuts = sorted({e for _, e in xr} & {e for _, e in yr})
        groups, p, q = [], 0, 0
        for c in cuts:
            i, j = p, q
            while p < len(xr) and xr[p][1] <= c:
                p += 1
            while q < len(yr) and yr[q][1] <= c:
                q += 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append((len(x), len(y), len(groups), len(links), digest, links))
    count = Counter(link for f in found for link in f[5])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    rows = [
        (*f[:4], sum(count[k] == best[k[1]] for k in f[5]), sum(count[k] for k in f[5]), f[4]) for f in found
    ]
    holds = Counter(link for f in found for link in set(f[5]))
    return rows, {k: (holds[k], n, n == best[k[1]]) for k, n in count.items()}


def texts_of_all_kinds():
    rng = random.Random(5)
    words = ["the", "tokenizer", "Straße", "naïve", "élan", "don't", "a_b", "x=1;", "12345", "日本", "🙂", "ß", "it's,", "end.", "\t"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    pieces = [" ", "  ", "\n", "\n ", " \n", " ", "　", "a", "bc", "é", "é", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "\0", ".", "​", "\x1c", "\r\n"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    texts += ["a▁b c", "▁", "ﬁn ﬁ", "a" * 3000, " ", "  ", " lead", "trail ", "\n", "\nx y", "one", "", None, "x  y z"]
    return texts + texts[:40] + ["the same text"] * 150


def result(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "s", "n") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, n_a STRING, source STRING")
    rows, pairs = align_documents(df.repartition(parts), A_FILE, B_FILE)
    assert rows.columns == ["doc_id", "source", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r)[2:] for r in rows.collect()}
    return [got[i] for i in range(len(texts))], {(r.a, r.b): (r.documents, r.links, r.best) for r in pairs.collect()}


def test_equals_plain_version(spark, libraries):
    texts = texts_of_all_kinds()
    assert result(spark, texts) == plain(libraries, texts)


def test_small_blocks_runs_and_memory(spark, libraries, monkeypatch):
    texts = texts_of_all_kinds()[:120]
    two = alignment.Aligner(A_FILE, B_FILE)
    want = [two.document(two.pieces(t)) for t in texts]
    monkeypatch.setattr(alignment, "RUN_PIECES", 3)
    monkeypatch.setattr(alignment, "MEMORY", 10)
    two = alignment.Aligner(A_FILE, B_FILE)
    for text, (*facts, codes, counts) in zip(texts, want):
        *f, c, n = two.document(two.pieces(text))
        assert f == facts and c.tolist() == codes.tolist() and n.tolist() == counts.tolist()
    block = alignment.Block(7)
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 5)
    for *_, codes, counts in want[:5]:
        block.add(codes, counts)
    assert block.full()
    for pair, documents, links, planes in block.lists():
        for p, d, n, bitmaps in zip(pair, documents, links, planes):
            held = {k: int(c[list(x).index(p)]) for k, (*_, x, c) in enumerate(want[:5]) if p in x.tolist()}
            assert (d, n) == (len(held), sum(held.values()))
            assert {k: sum(1 << i for i, b in enumerate(bitmaps) if k in unpack(b)) for k in held} == held


def test_empty_table_and_repeated_ids(spark, libraries):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id BIGINT, text STRING")
    rows, _ = align_documents(df, A_FILE, B_FILE)
    assert sorted((r.doc_id or 0, r.count_sum) for r in rows.collect()) == [(0, 0), (0, 6), (1, 6), (1, 6)]
    rows, pairs = align_documents(df.where("false"), A_FILE, B_FILE)
    assert rows.collect() == [] and pairs.collect() == []


def test_bitmaps():
    rng = np.random.default_rng(1)
    bitmaps = [np.flatnonzero(rng.random(1000) < share) for share in (0, 0.001, 0.01, 0.06, 0.5, 1) for _ in range(5)]
    packed = [pack(b, 1000) for b in bitmaps]
    assert all(unpack(p).tolist() == b.tolist() and len(p) <= 126 for p, b in zip(packed, bitmaps))
    array = pa.array([b"\0xx", *packed, b"\0yy"], pa.binary()).slice(1, len(packed))
    bits, weights = unpacked(array)
    assert bits.tolist() == np.concatenate(bitmaps).tolist() and weights.tolist() == list(map(len, bitmaps))
    slots, counts = np.array([1, 5, 9]), np.array([1, 6, 1000])
    planes = planes_of(slots, counts, 12)
    assert len(planes) == 10 and np.flatnonzero(presence(planes, 12)).tolist() == [1, 5, 9]


def test_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_pair_bitmaps"](spark, sf).collect()}
    assert [got[i] for i, _ in docs] == plain(libraries, [t for _, t in docs])[0]
