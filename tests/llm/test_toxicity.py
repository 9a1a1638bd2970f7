"""The clause grammar by worked clauses, composition against runs in a row, accuracy on held-out rows."""

import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from snapcat.llm import toxicity as tox
from snapcat.llm.queries import QUERIES
from snapcat.llm.transducers import compose, transducer

DOCS, LABELS = "doc_id BIGINT, text STRING, score STRING, note STRING", "doc_id BIGINT, toxic INT"


@pytest.mark.parametrize(
    "text, classes",
    [
        ("You idiot.", ["aimed"]),
        ("An idiot, truly", ["bare"]),
        ("Idiot you are", ["aimed"]),
        ("You are not an idiot.", ["denied"]),
        ("It is not warm in here today stupid", ["bare"]),  # the negation is too far away
        ("He said she is an idiot. You moron!", ["reported", "aimed"]),
        ('They wrote "you scum" here', ["reported"]),
        ('A "quote\nYou scum', ["aimed"]),  # an open quotation ends with its line
        ("I will kill you", ["threat"]),
        ("I kill time", []),
        ("They will not hurt you, loser", ["denied", "bare"]),
        ("idiot and you idiot", ["aimed"]),  # one class per clause, the strongest
        ("", []),
        ("no words of that kind here.", []),
    ],
)
def test_clauses(text, classes):
    n, matched, sums = tox.Reader({}).features(text)
    assert matched == len(classes)
    assert {c for c, s in zip(tox.CLASSES, sums) if s} == set(classes)
    assert sum(sums) == tox.GIVEN_WEIGHT * round(sum(sums) / tox.GIVEN_WEIGHT)


def test_learned_words_and_beginnings():
    reader = tox.Reader({"zorb": 2.0, "blanf*": 3.0, "blanfe*": 4.0, "idiot": 0.5})
    assert reader.features("you zorb")[2][1] == 2.0
    assert reader.features("zorbing. blanf")[1] == 0  # neither is the word, or longer than the beginning
    assert reader.features("blanfas")[2][2] == 3.0 and reader.features("blanfest")[2][2] == 4.0
    assert reader.features("an idiot")[2][2] == 0.5


def test_blocks_do_not_change_the_result(monkeypatch):
    rng = random.Random(1)
    words = ["you", "idiot", "not", "said", '"', ".", "\n", "x", "kill", "scum,", "blue"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    want = tox.Reader({}).features(text)
    monkeypatch.setattr(tox, "BLOCK", 50)
    assert tox.Reader({}).features(text) == want and want[1] > 100


def test_composition_equals_runs_in_a_row():
    parts = [tox.negation(), tox.reported_speech(), tox.target(), tox.strongest()]
    whole, rng = tox.grammar(), random.Random(4)
    for _ in range(500):
        symbols = [rng.choice(tox.SYMBOLS) for _ in range(rng.randrange(25))]
        written = symbols
        for part in parts:
            written = part.run(written)
        assert whole.run(symbols) == written
    double = transducer(0, "ab", lambda s, x: (s, (x, x)))
    parity = transducer(0, "ab", lambda s, x: (1 - s, (x,) if s else ()))
    for n in range(6):
        for symbols in itertools.product("ab", repeat=n):
            assert compose(double, parity).run(symbols) == list(symbols)


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(6)
    bad = ["you idiot", "zorbig scum", "kill you"]
    texts = [" ".join(rng.choice(["blue", "green", "tree,", "the.", *(bad if i % 5 == 0 else [])]) for _ in range(30)) for i in range(300)]
    texts += [None, "", "...", "x " * 70000, "you idiot " * 5000]
    docs = [(i, t, "s", "n") for i, t in enumerate(texts)] + [(3, texts[3], "s", "n"), (None, "idiot", "s", "n")]
    labels = [(i, int(i % 5 == 0)) for i in range(300)] + [(7, None), (None, 1), (10**9, 1), (20, 1), (20, 0)]
    d, l = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    words, weights = tox.learn(d, l)
    assert words and "zorbig" in words
    reader = tox.Reader(words)
    got = tox.score_documents(d, l)
    assert got.columns == ["doc_id", "note", "held_out", "score", "predicted", "n_clauses"]
    rows = got.collect()
    assert len(rows) == len(docs)
    text_of = dict((i, t) for i, t, _, _ in docs)
    for r in rows:
        n, clauses, sums = reader.features(text_of[r.doc_id])
        score = 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, tox.numbers(n, sums)))))
        assert (abs(r.score - score) < 1e-12, r.predicted, r.n_clauses) == (True, int(score >= 0.3), clauses)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and r.doc_id < 300)


def test_held_out_labels_do_not_teach(spark):
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "zorbig blue" if i % 2 else "green blue", "", "") for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], LABELS)
    flipped = spark.createDataFrame([(i, (i % 2) if i not in out else 1 - i % 2) for i in range(400)], LABELS)
    assert tox.learn(docs, labels) == tox.learn(docs, flipped)
    sampled = tox.teaching_sample(docs, labels, 50).collect()
    assert len(sampled) == 50 and not {r.doc_id for r in sampled} & set(out)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "You idiot.", "", ""), (2, "A tree.", "", "")], DOCS)
    for labels in ([], [(1, 1)], [(2, 0)], [(1, None)]):
        got = {r.doc_id: r.predicted for r in tox.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()}
        assert got == {1: 1, 2: 0}
    assert tox.score_documents(docs.where("false"), spark.createDataFrame([(1, 1)], LABELS)).collect() == []


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op11_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.9 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.99
