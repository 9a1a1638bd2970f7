"""Byte-level BPE encoding and decoding with recursive queries of DuckDB inside each task.

A word is rows of (position, id); positions run on over the words of a query. A step joins each row and its successor with the
merge table, takes the leftmost pair of minimum rank of each word and contracts it; words without a pair leave the recursion. Decoding joins ids with the vocabulary
and aggregates the bytes of a document in order. Only words that a worker has not seen yet go through the recursion.

* null and empty texts: no ids, digests of nothing. Repeated rows are encoded each on its own; other columns are not read.
* a step costs all rows of a word, so a long word goes through the recursion in blocks that overlap. Where two blocks hold
  the same token, the first is followed up to it and the second from it. The result is that of the whole word: a step of
  the whole word that stays inside a run of tokens is a step of that run alone, so a merge across a border would also be
  made in the run of the two tokens beside it; each such run lies in one block, whose recursion left the border.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm.tokens import MEMORY, Pieces, slices

#: Steps of a recursive query before its rows are dropped, bytes of words and rows of all steps in one query, ids decoded in
#: one query.
BURST = 48
WORD_BYTES = 1 << 19
STEP_ROWS = 1 << 23
DECODE_IDS = 1 << 19
#: Bytes from which a word goes in blocks, and of a block, of which a third is shared with the next one.
LONG = 2048
BLOCK = 384

CONTRACT = f"""
WITH RECURSIVE t AS (
    SELECT 0 AS step, w, pos, id FROM letters
    UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT step, w, pos, id, lead(w) OVER o AS following, lead(id) OVER o AS nxt, lag(pos) OVER o AS prv
            FROM t WHERE step < {BURST} WINDOW o AS (ORDER BY pos)
        ), least AS (
            SELECT w, min((c << 32) + pos) AS best FROM pairs JOIN merges ON a = id AND b = nxt WHERE following = w GROUP BY w
        )
        SELECT step + 1, w, pos, CASE WHEN pos = best & 4294967295 THEN best >> 32 ELSE id END
        FROM pairs JOIN least USING (w)
        WHERE prv IS NULL OR prv <> best & 4294967295
    )
)
SELECT w, step, id FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY pos
"""

DECODE = """
SELECT doc, sha256(unhex(string_agg(piece, '' ORDER BY pos))) AS digest
FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


class DuckBpe(Pieces):
    """The encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import duckdb
        import pyarrow as pa
        import regex

        with open(path, "rb") as source:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in source if line.strip())}
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        merges = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        a, b, c = (pa.array(x, pa.int64()) for x in zip(*merges, strict=True))
        self.put("merge_rows", a=a, b=b, c=c)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.put("vocabulary_rows", id=pa.array(ranks.values(), pa.int64()), piece=pa.array(t.hex() for t in ranks))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")

    def put(self, name: str, **columns) -> None:
        import pyarrow as pa

        self.db.register(name, pa.table(columns))

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each by its own recursion; shorter words first, so that those of a query end together."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found = self.contract_sorted([words[i] for i in order])
        return [ids for _, ids in sorted(zip(order, found, strict=True))]

    def contract_sorted(self, words: list[bytes]) -> list[bytes]:
        found: list[bytes] = [b""] * len(words)
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size < min(WORD_BYTES, STEP_ROWS // min(BURST, len(words[end]) or 1))):
                size += len(words[end])
                end += 1
            lengths = np.array([len(w) for w in words[at:end]])
            raw = np.frombuffer(b"".join(words[at:end]), np.uint8)
            w, ids = np.repeat(np.arange(at, end), lengths), self.single[raw]
            while len(w):
                self.put("letters", w=w, pos=np.arange(len(w)), id=ids)
                out = self.db.execute(CONTRACT).to_arrow_table()
                w, step, ids = (out.column(c).to_numpy() for c in ("w", "step", "id"))
                done = step < BURST
                ends = np.flatnonzero(np.r_[w[1:] != w[:-1], True]) + 1
                packed, start = ids.astype("<u4").tobytes(), 0
                for end_at in ends.tolist():
                    if done[start]:
                        found[int(w[start])] = packed[4 * start : 4 * end_at]
                    start = end_at
                w, ids = w[~done], ids[~done]
            at = end
        return found

    def contract_long(self, words: list[bytes]) -> list[bytes]:
        """Ids of words from blocks; blocks that do not meet in a token are made longer, at last as long as the word."""
        found: dict[bytes, bytes] = {}
        size = BLOCK
        while open_words := [w for w in words if w not in found]:
            starts = {w: range(0, max(len(w) - size // 3, 1), size - size // 3) for w in open_words}
            blocks = list({w[s : s + size] for w in open_words for s in starts[w]})
            known = dict(zip(blocks, self.contract(blocks), strict=True))
            met = {w: self.joined(w, size, known) for w in open_words}
            found.update((w, ids) for w, ids in met.items() if ids is not None)
            size *= 2
        return [found[w] for w in words]

    def joined(self, word: bytes, size: int, blocks: dict[bytes, bytes]) -> bytes | None:
        def tokens(start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            block = word[start : start + size]
            if block not in blocks:
                blocks[block] = self.contract([block])[0]
            ids = np.frombuffer(blocks[block], "<u4")
            ends = start + np.cumsum(self.sizes[ids])
            return ids, ends - self.sizes[ids], ends

        parts, start = [], 0
        ids, begins, ends = tokens(0)
        while start + size < len(word):
            stop = start + size
            for following in (stop - size // 3, *begins[(begins > stop - size // 3) & (begins < stop)][:1].tolist()):
                # The second try begins where the first block has a border: repetitive words are in step from there.
                other = tokens(following)
                _, mine, theirs = np.intersect1d(begins << 32 | ends, other[1] << 32 | other[2], return_indices=True)
                if len(mine):
                    break
            else:
                return None
            parts.append(ids[: mine[-1]])
            ids, begins, ends = (column[theirs[-1] :] for column in other)
            start = following
        return np.concatenate([*parts, ids]).astype("<u4").tobytes()

    def learn_words(self, words: set[str]) -> None:
        if len(self.words) > MEMORY:
            self.words = {}
        new = {w: w.encode() for w in words.difference(self.words)}
        short = [w for w, raw in new.items() if len(raw) <= LONG]
        long = [w for w, raw in new.items() if len(raw) > LONG]
        self.words.update(zip(short, self.contract([new[w] for w in short]), strict=True))
        self.words.update(zip(long, self.contract_long([new[w] for w in long]), strict=True))

    def learn(self, pieces: set[str]) -> None:
        parts = {p: self.split(" " + p) for p in pieces}
        self.learn_words({w for words in parts.values() for w in words})
        for p, words in parts.items():
            self.known[p] = b"".join([self.words[w] for w in words])

    def wholes(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        self.learn_words({w for words in parts for w in words})
        return [b"".join([self.words[w] for w in words]) for words in parts]

    def decoded_digests(self, ids: list[bytes]) -> list[str]:
        """SHA-256 of the bytes that each list of ids decodes to."""
        found = [hashlib.sha256(b"").hexdigest()] * len(ids)
        at = 0
        while at < len(ids):
            size, end = 0, at
            while end < len(ids) and (size < DECODE_IDS or end == at):
                size += len(ids[end]) // 4
                end += 1
            lengths = np.array([len(x) // 4 for x in ids[at:end]])
            flat = np.frombuffer(b"".join(ids[at:end]), "<u4").astype(np.int64)
            self.put("tokens", doc=np.repeat(np.arange(at, end), lengths), pos=np.arange(len(flat)), id=flat)
            for doc, digest in self.db.execute(DECODE).fetchall():
                found[doc] = digest
            at = end
        return found


_CODECS: dict[tuple[str, str], DuckBpe] = {}


def codec(path: str, pattern: str) -> DuckBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = DuckBpe(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit; null without ``with_ids``)."""

    def run(batches):
        import pyarrow as pa

        bpe = codec(ranks, pattern)
        for batch in batches:
            for doc_ids, texts in slices(batch, ("doc_id", "text"), 512):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array(bpe.decoded_digests(ids), pa.string()),
                        pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    schema = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING, ids BINARY"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
