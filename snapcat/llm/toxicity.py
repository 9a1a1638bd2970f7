"""Toxicity by a weighted grammar of clauses.

A lexicon turns the words of a text into symbols: insults and threats with weights, words that name a target, negations,
verbs of speech, quotation marks, ends of clauses and of lines. Four transducers are composed into one table: negation marks
insults and threats up to three words behind it as denied, reported speech marks those in quotation marks or behind a verb
of speech, the target transducer tells aimed ones from bare ones, and the last writes one class per clause, the strongest
pattern in it. A clause's weight is the sum of the weights on its path; a document's score is a logistic function of the
weights of its clauses by class and of their share of the text. Isolated words count for what their clause makes of them.

Labels teach three things, from at most ``most_labels`` labelled rows (those with the smallest hash of their doc_id), none of
which is held out: which words and word beginnings are insults besides the given ones, their weights, and the weights of the
classes. Words are counted by Spark; only the lexicon (``MOST_ENTRIES``) and one row of numbers per sampled document reach the
driver.

* null and empty texts and texts without words: no clause, the score of that; never an error;
* no labels, or labels of one kind only: the given words and fixed weights;
* null doc_id: not held out, never learned from; repeated doc_id in documents: each row gets its score, the smallest text is
  learned from; repeated in labels: toxic if any row says so; null labels are no labels;
* very long texts: read in blocks of 2**20 characters (a little more, up to the next white space, where there is any);
* further columns of documents pass untouched, unless they bear a name of the result, which then wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcat.llm.shared import stored
from snapcat.llm.tokens import slices
from snapcat.llm.transducers import Transducer, compose, transducer

#: Labelled rows that teach, entries of the lexicon, and words and word beginnings that are considered for it.
MOST_LABELS, MOST_ENTRIES, MOST_CANDIDATES = 20_000, 500, 50_000
#: Toxic documents a learned entry must be in.
LEAST_DOCS = 5
#: A learned entry's log odds must be above zero by this many standard errors.
SURE = 3.0
#: Word beginnings that may be entries.
STEMS = range(4, 9)
THRESHOLD = 0.3
BLOCK = 1 << 20

# Words given to the grammar, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown coward liar fool "
    "imbecile filthy vermin bastard bitch asshole dickhead retard "
    "idiotin trottel dumm dummkopf abschaum versager wertlos erbärmlich widerlich arschloch schwein "
    "imbécile crétin débile ordure minable dégoûtant salaud connard connasse abruti "
    "imbécil estúpido estúpida basura escoria inútil patético asqueroso payaso cabrón"
).split()
THREATS = (
    "kill hurt destroy beat stab shoot burn crush töten umbringen vernichten verprügeln tuer détruire frapper écraser "
    "matar destruir golpear quemar"
).split()
TARGETS = (
    "you your he she they him her them this that these those du dich dir ihr euch er sie dieser diese dieses "
    "tu toi te vous il elle ils elles ce cet cette ces usted tú ti él ella ellos ellas este esta estos estas"
).split()
NEGATIONS = "not no never neither nor nicht kein keine nie pas jamais non nunca jamás ni".split()
SPEECH = (
    "said says say called calls wrote writes claimed quoted reported sagte sagt nannte schrieb dit disait appelait "
    "dijo dice llamó escribió"
).split()
GIVEN_WEIGHT = 1.5

INSULT, THREAT, TARGET, NEGATION, SPEECH_VERB, QUOTE, OTHER, CLAUSE, LINE = SYMBOLS = "IHTNRQOEP"
CLASSES = ("threat", "aimed", "bare", "reported", "denied")
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\"“”„«»\n]")
GAP = re.compile(r"\s")
QUOTES = set("\"“”„«»")

# --- the grammar ---------------------------------------------------------------------------------------------------


def negation(window: int = 3) -> Transducer:
    """Insults and threats within ``window`` words behind a negation become i and h; a clause ends its reach."""

    def arc(left, symbol):
        if symbol in (CLAUSE, LINE):
            return 0, (symbol,)
        if symbol == NEGATION:
            return window, ()
        if symbol == QUOTE:
            return left, (symbol,)
        return max(left - 1, 0), (symbol.lower(),) if left and symbol in (INSULT, THREAT) else (symbol,)

    return transducer(0, SYMBOLS, arc)


def reported_speech() -> Transducer:
    """Insults and threats behind a verb of speech, to the end of its clause, or in quotation marks become r."""

    def arc(state, symbol):
        said, quoted = state
        if symbol == LINE:
            return (False, False), (CLAUSE,)
        if symbol == CLAUSE:
            return (False, quoted), (CLAUSE,)
        if symbol == SPEECH_VERB:
            return (True, quoted), (OTHER,)
        if symbol == QUOTE:
            return (said, not quoted), ()
        return state, ("r",) if (said or quoted) and symbol in "IHih" else (symbol,)

    return transducer((False, False), "IHihTRQOEP", arc)


def target(window: int = 3) -> Transducer:
    """An insult becomes A if its clause named a target before or names one within ``window`` words behind it, else B; a
    threat becomes K if a target follows within the window."""

    def arc(state, symbol):
        named, waiting, left = state
        if symbol == CLAUSE:
            return (False, "", 0), ("B", CLAUSE) if waiting == INSULT else (CLAUSE,)
        if symbol == TARGET:
            return (True, "", 0), {INSULT: ("A",), THREAT: ("K",)}.get(waiting, ())
        before = ("B",) if waiting == INSULT else ()
        if symbol == INSULT:
            return ((named, "", 0), (*before, "A")) if named else ((named, INSULT, window), before)
        if symbol == THREAT:
            return (named, THREAT, window), before
        own = () if symbol == OTHER else (symbol,)
        if left > 1:
            return (named, waiting, left - 1), own
        return (named, "", 0), (*before, *own)

    return transducer((False, "", 0), "IHihrTOE", arc)


def strongest() -> Transducer:
    """Writes the strongest pattern of each clause at its end."""
    rank = {"K": 0, "A": 1, "B": 2, "r": 3, "i": 4, "h": 4}

    def arc(best, symbol):
        if symbol == CLAUSE:
            return len(CLASSES), (CLASSES[best],) if best < len(CLASSES) else ()
        return min(best, rank[symbol]), ()

    return transducer(len(CLASSES), "KABrihE", arc)


def grammar() -> Transducer:
    return compose(compose(compose(negation(), reported_speech()), target()), strongest())


# --- words to symbols, clauses to numbers --------------------------------------------------------------------------


class Reader:
    """Reads texts with a lexicon (word, or beginning followed by ``*``, to weight)."""

    def __init__(self, learned: dict[str, float]):
        self.table = grammar().numbered()
        self.words: dict[str, tuple[str, float]] = {w: (INSULT, GIVEN_WEIGHT) for w in INSULTS}
        self.words |= {w: (THREAT, GIVEN_WEIGHT) for w in THREATS}
        self.words |= {w: (INSULT, x) for w, x in learned.items() if not w.endswith("*")}
        self.stems = {w[:-1]: (INSULT, x) for w, x in learned.items() if w.endswith("*")}
        for symbol, given in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (SPEECH_VERB, SPEECH)):
            self.words |= {w: (symbol, 0.0) for w in given}
        self.words |= {c: (CLAUSE, 0.0) for c in ".!?;:,"} | {c: (QUOTE, 0.0) for c in QUOTES} | {"\n": (LINE, 0.0)}

    def symbol(self, token: str) -> tuple[str, float]:
        """By the whole word, else by its longest beginning in the lexicon."""
        found = self.words.get(token)
        if found is None and len(token) > STEMS[0]:
            for n in reversed(STEMS):
                if n < len(token) and (found := self.stems.get(token[:n])):
                    break
        return found or (OTHER, 0.0)

    def features(self, text: str | None) -> tuple[int, int, list[float]]:
        """(words, matched clauses, weight of the matched clauses by class)."""
        n_words, n_clauses, sums = 0, 0, dict.fromkeys(CLASSES, 0.0)
        state, weight = 0, 0.0
        for tokens in token_blocks((text or "").lower()):
            pairs = list(map(self.symbol, tokens))
            n_words += sum(1 for s, _ in pairs if s not in "EQP")
            if not state and not weight and not any(w for _, w in pairs) and QUOTES.isdisjoint(tokens):
                continue
            for symbol, w in pairs:
                weight += w
                state, out = self.table[state][symbol]
                if out:
                    sums[out[0]] += weight
                    n_clauses += 1
                if symbol in (CLAUSE, LINE):
                    weight = 0.0
        _, out = self.table[state][LINE]
        if out:
            sums[out[0]] += weight
            n_clauses += 1
        return n_words, n_clauses, list(sums.values())


def token_blocks(text: str) -> Iterator[list[str]]:
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + BLOCK) if len(text) - start > BLOCK else None
        end = gap.start() if gap else len(text)
        yield TOKEN.findall(text, start, end)
        start = end


def numbers(n_words: int, sums: list[float]) -> list[float]:
    """What the logistic function reads: clause weights by class, their total, and that per hundred words."""
    total = sum(sums)
    return [1.0, *map(math.log1p, sums), math.log1p(total), math.log1p(100 * total / max(n_words, 1))]


#: Used where labels cannot teach: a clause with an aimed insult or a threat is above the threshold.
FIXED = [-3.0, 2.0, 1.5, 0.5, -0.5, -1.0, 1.0, 0.5]


def logistic(rows: np.ndarray, toxic: np.ndarray, decay: float = 1.0, steps: int = 30) -> list[float]:
    """Weights by Newton steps on the regularised likelihood."""
    weights = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], decay)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (toxic - p) - penalty * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty)
        weights = weights + np.clip(np.linalg.solve(curve, gradient), -3, 3)
    return weights.tolist()


# --- learning --------------------------------------------------------------------------------------------------------


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def entries(text: str | None) -> set[str]:
    """Distinct words of a text, and beginnings of words marked by ``*``."""
    found: set[str] = set()
    for tokens in token_blocks((text or "").lower()):
        words = {w for w in tokens if 2 < len(w) < 25}
        found |= words
        found.update(w[:n] + "*" for w in words for n in STEMS if n < len(w))
    return found


def count_entries(wanted: set[str] | None):
    """Per task: (entry, documents that hold it); only those of ``wanted`` where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             ["entry", "n"])
            counts.clear()
            return out

        for batch in batches:
            for (texts,) in slices(batch, ("text",)):
                for text in texts:
                    found = entries(text)
                    counts.update(found if wanted is None else found & wanted)
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    return run


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries that labels show to be toxic, with their log odds less the doubt about them."""
    counted = (
        lambda toxic, wanted: sample.where(F.col("toxic") == toxic)
        .select("text")
        .mapInArrow(count_entries(wanted), "entry string, n bigint")
        .groupBy("entry")
        .agg(F.sum("n").alias("n"))
    )
    often = counted(1, None).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "entry").limit(MOST_CANDIDATES)
    toxic = {r.entry: r.n for r in often.collect()}
    clean = {r.entry: r.n for r in counted(0, set(toxic)).collect()}
    odds = {}
    for entry, n in toxic.items():
        m = clean.get(entry, 0)
        doubt = math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        sure = math.log((n + 0.5) / (n_toxic + 1)) - math.log((m + 0.5) / (n_clean + 1)) - SURE * doubt
        if sure > 0:
            odds[entry] = (sure * n, sure)
    for entry, n in toxic.items():  # a beginning that is mostly the beginning of one longer entry says nothing more
        word = entry.rstrip("*")
        shorter = [word[:k] + "*" for k in STEMS if k < len(word)] if entry == word else [word[:-1] + "*"]
        for s in shorter:
            if n >= 0.8 * toxic.get(s, math.inf):
                odds.pop(s, None)
    best = sorted(odds, key=lambda e: (-odds[e][0], e))[:MOST_ENTRIES]
    return {e: odds[e][1] for e in best}


def teaching_sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder() != 2)).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a top-k; bounded, so it may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity")


def read_with(reader: Reader, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [reader.features(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                numbered = pa.array([numbers(n, s) for n, _, s in rows], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([c for _, c, _ in rows], pa.int64()), numbered], [*names, "n_clauses", "numbers"]
                )

    return run


def learn(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[dict[str, float], list[float]]:
    """(lexicon, weights of the logistic function)."""
    sample = teaching_sample(documents, labels, most_labels)
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return {}, FIXED
    words = lexicon(sample, kinds[1], kinds[0])
    read = sample.mapInArrow(
        read_with(Reader(words), ["doc_id", "toxic"]), "doc_id bigint, toxic int, n_clauses bigint, numbers array<double>"
    )
    rows = sorted((r.doc_id, r.toxic, r.numbers) for r in read.collect())  # at most most_labels rows
    return words, logistic(np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows]))


def score_documents(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """documents without their text, with held_out, score, predicted and n_clauses (matched clauses)."""
    added = ["held_out", "score", "predicted", "n_clauses"]
    words, weights = learn(documents, labels, most_labels)
    names = [c for c in documents.columns if c != "text" and c.lower() not in added and c != "numbers"]
    schema = T.StructType([documents.schema[c] for c in names])
    schema = schema.add("n_clauses", T.LongType()).add("numbers", T.ArrayType(T.DoubleType()))
    read = documents.select(*names, "text").mapInArrow(read_with(Reader(words), names), schema)
    logit = sum((F.col("numbers")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    return (
        read.withColumn("score", 1 / (1 + F.exp(-logit)))
        .withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        .select(*names, *added)
    )
