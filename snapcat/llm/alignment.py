"""Alignment of two tokenizers over a corpus by an inverted index of id pairs.

Both tokenizers cut the same bytes (a space and the text). Every cut of either bounds an interval that lies in one token of
each, so the links of a document are these intervals and its groups are bounded by the cuts both share.

Documents are read in blocks of bounded size. Within a block every id pair has an inverted list: bitmaps over the block's
documents, one per binary digit of the number of links (multiplicity planes), each kept as a list of slots where few bits
are set and as plain bits where many are. The presence of a pair is the OR of its planes, its documents in the corpus the sum
of the popcounts of that over blocks, its links the sum of popcounts weighted by plane. These counts are joined back to the
lists, and the lists return scores to the documents of their block; no row per link leaves a task.

A text is cut in front of single spaces, where neither tokenizer's tokens reach across (checked for the vocabulary of the
second one, else texts stay whole), and each distinct piece is encoded and aligned once per worker.

* null and empty texts, and texts whose joined token bytes of either side differ from space and text: zeros, no digest;
* repeated rows: each counts and gets its own row (documents are known by block and slot, not by doc_id); null doc_id too;
* very long texts: pieces go through in runs of ``RUN_PIECES``, so what is held at once is the text, its pieces and its
  distinct pairs; a run without single spaces is one piece, however long;
* empty table: no rows; further columns of the input pass untouched, unless they bear a name of the result, which then wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcat.llm.shared import stored
from snapcat.llm.tokens import RUN, Encoder, slices

#: A block ends at this many documents or pairs of documents and ids, whichever comes first.
BLOCK_DOCS, BLOCK_LINKS = 4096, 1 << 21
#: Pieces remembered by a worker, and pieces of one document handled at once.
MEMORY, RUN_PIECES = 300_000, 100_000
#: Space that neither follows a space nor stands before white space or the end.
CUT = re.compile("(?<=[^ ]) (?![\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\u2060\\ufeff]|\\Z)")

# --- bitmaps ---------------------------------------------------------------------------------------------------------


def pack(slots: np.ndarray, size: int) -> bytes:
    """A bitmap of ``size`` bits: two bytes per set bit, or all bits, whichever is shorter; the first byte tells."""
    if 2 * len(slots) <= (size + 7) // 8:
        return b"\0" + slots.astype("<u2").tobytes()
    bits = np.zeros(size, dtype=bool)
    bits[slots] = True
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """Set bits of a bitmap, ascending."""
    if packed[:1] == b"\0":
        return np.frombuffer(packed, dtype="<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8, offset=1), bitorder="little"))


def unpacked(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(set bits of all bitmaps one behind the other, number of bits of each)."""
    offsets = np.frombuffer(bitmaps.buffers()[1], dtype=np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1]
    data = np.frombuffer(bitmaps.buffers()[2], dtype=np.uint8)
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    plain = data[starts] == 1
    weights = (ends - starts - 1) // 2
    full = {k: unpack(data[starts[k] : ends[k]].tobytes()) for k in np.flatnonzero(plain).tolist()}
    for k, found in full.items():
        weights[k] = len(found)
    listed = np.ones(len(data), dtype=bool)
    listed[: offsets[0]] = listed[offsets[-1] :] = False
    listed[starts] = False
    for k in full:
        listed[starts[k] : ends[k]] = False
    result = np.empty(int(weights.sum()), dtype=np.int64)
    result[np.repeat(~plain, weights)] = np.frombuffer(data[listed].tobytes(), dtype="<u2")
    if full:
        result[np.repeat(plain, weights)] = np.concatenate(list(full.values()))
    return result, weights


def planes_of(slots: np.ndarray, counts: np.ndarray, size: int) -> list[bytes]:
    """Multiplicity planes: bit k of plane p tells whether digit p of document k's count is set."""
    return [pack(slots[(counts >> p) & 1 == 1], size) for p in range(int(counts.max()).bit_length())]


def presence(planes: list[bytes], size: int) -> np.ndarray:
    """OR of the planes."""
    bits = np.zeros(size, dtype=bool)
    for plane in planes:
        bits[unpack(plane)] = True
    return bits


# --- two tokenizers over the same bytes ------------------------------------------------------------------------------


class Aligner:
    """Ids and links of pieces by a byte-level BPE file and a sentencepiece model."""

    def __init__(self, json_path: str, model_path: str):
        import sentencepiece

        self.a = Encoder(json_path, plain=True)
        vocab = self.a.library.get_vocab()
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.whole = bool(self.a.uncut) or any(re.search("[^▁]▁", p) for p in pieces)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("a pair of ids is kept in 32 bits")
        self.a_lengths = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # ids as written in groups: inside a side, at the end of the A side, at the end of a group
        self.written = [b"%d%c" % (i, mark) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in b",|;"]
        self.written_lengths = np.array(list(map(len, self.written)), dtype=np.int64)
        #: piece -> (its groups, each with a mark behind it, codes of its links, number of its A tokens); None where bytes differ
        self.known: dict[str, tuple[bytes, bytes, int] | None] = {}
        self.older: dict[str, tuple[bytes, bytes, int] | None] = {}

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.whole or "▁" in text:
            return [text]
        return CUT.split(text) if RUN.search(" " + text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns pieces, each with a space in front."""
        self.a.known = {}
        self.a.learn(set(new))
        raw = [self.a.known[p] for p in new]
        self.a.known = {}
        a_ids = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
        a_counts = np.array([len(x) // 4 for x in raw], dtype=np.int64)
        found = self.b.encode(new, num_threads=1)
        b_counts = np.array(list(map(len, found)), dtype=np.int64)
        b_ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(b_counts.sum()))
        wanted = [b" " + p.encode() for p in new]
        good = self.equal(wanted, a_ids, a_counts, self.a_bytes) & self.equal(wanted, b_ids, b_counts, self.b_bytes)
        if not good.all():
            self.known.update(dict.fromkeys((p for p, ok in zip(new, good.tolist()) if not ok)))
            new = [p for p, ok in zip(new, good.tolist()) if ok]
            a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts[good], b_counts[good]
        if not new:
            return
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        cuts = np.union1d(a_ends, b_ends)
        codes = a_ids[np.searchsorted(a_ends, cuts)] << 16 | b_ids[np.searchsorted(b_ends, cuts)]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)  # ends of groups
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        # written in the order of groups, in each the A tokens before the B tokens, every token with the mark behind it
        last_a = np.append(a_group[1:] != a_group[:-1], True)
        last_b = np.append(b_group[1:] != b_group[:-1], True)
        keys = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        keys[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = 3 * a_ids + last_a
        keys[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = 3 * b_ids + 2 * last_b
        text = b"".join(map(self.written.__getitem__, keys.tolist()))
        a_at, b_at = np.cumsum(a_counts), np.cumsum(b_counts)
        text_at = np.cumsum(self.written_lengths[keys])[a_at + b_at - 1].tolist()
        # links of a run of tokens: its tokens of both kinds less its groups
        code_at = (4 * (a_at + b_at - a_group[a_at - 1] - 1)).tolist()
        raw = codes.astype("<u4").tobytes()
        entries = zip(
            map(text.__getitem__, map(slice, [0, *text_at[:-1]], text_at)),
            map(raw.__getitem__, map(slice, [0, *code_at[:-1]], code_at)),
            a_counts.tolist(),
        )
        self.known.update(zip(new, entries))

    @staticmethod
    def equal(wanted: list[bytes], ids: np.ndarray, counts: np.ndarray, token_bytes: list[bytes]) -> np.ndarray:
        """Whether the tokens of each piece join to its bytes."""
        tokens = list(map(token_bytes.__getitem__, ids.tolist()))
        at = np.cumsum(counts).tolist()
        joined = map(b"".join, map(tokens.__getitem__, map(slice, [0, *at[:-1]], at)))
        return np.array(list(map(bytes.__eq__, joined, wanted)), dtype=bool)

    def document(self, pieces: list[str]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(A tokens, groups, links, digest of the groups, distinct pair codes, links of each) of a text's pieces."""
        nothing = (0, 0, 0, "", np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        if not pieces:
            return nothing
        digest, codes, counts = hashlib.sha256(), [], []
        n_a = n_groups = n_links = 0
        for start in range(0, len(pieces), RUN_PIECES):
            run = pieces[start : start + RUN_PIECES]
            try:
                entries = list(map(self.known.__getitem__, run))
            except KeyError:
                self.remember(set(run))
                entries = list(map(self.known.__getitem__, run))
            if None in entries:
                return nothing
            groups = b"".join([e[0] for e in entries])
            if start:
                digest.update(b";")
            digest.update(memoryview(groups)[:-1])
            n_groups += groups.count(b";")
            n_a += sum([e[2] for e in entries])
            found = np.frombuffer(b"".join([e[1] for e in entries]), dtype="<u4")
            n_links += len(found)
            code, count = np.unique(found, return_counts=True)
            codes.append(code)
            counts.append(count)
        if len(codes) > 1:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            return n_a, n_groups, n_links, digest.hexdigest(), code, np.bincount(at, np.concatenate(counts)).astype(np.int64)
        return n_a, n_groups, n_links, digest.hexdigest(), codes[0], counts[0]

    def remember(self, pieces: set[str]) -> None:
        """Pieces in use stay when the memory is full: what was not asked for since the last time goes."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.older, self.known, new = self.known, {}, pieces
        again = [p for p in new if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        if len(new) > len(again):
            self.learn(list(new.difference(again)))


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where printable, else from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(json_path: str, model_path: str) -> Aligner:
    """One per pair of files and Python worker."""
    if (json_path, model_path) not in _ALIGNERS:
        _ALIGNERS[json_path, model_path] = Aligner(json_path, model_path)
    return _ALIGNERS[json_path, model_path]


# --- inverted index --------------------------------------------------------------------------------------------------

FACTS = ["n_a", "n_b", "n_groups", "n_links"]
SCORES = ["n_best", "count_sum"]


class Block:
    """Documents of a block and the pairs they hold."""

    def __init__(self, number: int):
        self.number, self.slot, self.links = number, 0, 0
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.slot += 1
        self.links += len(codes)

    def full(self) -> bool:
        return self.slot >= BLOCK_DOCS or self.links >= BLOCK_LINKS

    def lists(self) -> Iterator[tuple[list[int], list[int], list[int], list[list[bytes]]]]:
        """Columns (pair, documents, links, planes), some pairs at a time."""
        slots = np.repeat(np.arange(self.slot), [len(c) for c in self.codes])
        codes = np.concatenate([np.zeros(0, dtype=np.uint32), *self.codes])
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *self.counts])
        order = np.argsort(codes, kind="stable")
        codes, counts, slots = codes[order], counts[order], slots[order].astype("<u2")
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=int)
        ends = np.append(starts[1:], len(codes))
        sums = np.add.reduceat(counts, starts) if len(starts) else counts
        simple = (sums == ends - starts) & (2 * (ends - starts) <= (self.slot + 7) // 8)  # one plane, few bits
        raw = slots.tobytes()
        for at in range(0, len(starts), 1 << 16):
            part = slice(at, at + (1 << 16))
            planes = [
                [b"\0" + raw[2 * s : 2 * e]] if one else planes_of(slots[s:e], counts[s:e], self.slot)
                for s, e, one in zip(starts[part].tolist(), ends[part].tolist(), simple[part].tolist())
            ]
            documents = [
                e - s if one else int(presence(p, self.slot).sum())
                for s, e, one, p in zip(starts[part].tolist(), ends[part].tolist(), simple[part].tolist(), planes)
            ]
            yield codes[starts[part]].astype(np.int64).tolist(), documents, sums[part].tolist(), planes


def index(json_path: str, model_path: str, names: list[str], schema: pa.Schema):
    """Rows of two kinds: a document (its columns and facts), and a pair's inverted list in a block."""

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = [
            pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array)
            else columns.get(f.name, pa.nulls(n, f.type))
            for f in schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = aligner(json_path, model_path)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)

        def close() -> Iterator[pa.RecordBatch]:
            for pair, documents, links, planes in block.lists():
                yield rows(len(pair), block=[block.number] * len(pair), pair=pair, documents=documents, links=links, planes=planes)

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                blocks, slots, facts, digests = [], [], [], []
                for (texts,) in slices(part, ("text",)):
                    cut = list(map(two.pieces, texts))
                    two.remember({p for pieces in cut if len(pieces) < RUN_PIECES for p in pieces})
                    for pieces in cut:
                        n_a, n_groups, n_links, digest, codes, counts = two.document(pieces)
                        blocks.append(block.number)
                        slots.append(block.slot)
                        facts.append((n_a, n_links + n_groups - n_a, n_groups, n_links))
                        digests.append(digest)
                        block.add(codes, counts)
                        if block.full():
                            yield from close()
                            number += 1
                            block = Block(number)
                kept = {n: part.column(part.schema.get_field_index(n)) for n in names}
                columns = dict(zip(FACTS, map(list, zip(*facts))))
                yield rows(part.num_rows, block=blocks, slot=slots, groups_sha256=digests, **columns, **kept)
        yield from close()

    return run


def scores(key: tuple, table: pa.Table) -> pa.Table:
    """What the lists of a block return to its documents: (block, slot, n_best, count_sum)."""
    lists = table.column("planes").combine_chunks()
    per_list = np.asarray(lists.value_lengths())
    total, top = (np.repeat(np.asarray(table.column(c).to_numpy()), per_list) for c in ("total", "best"))
    place = np.arange(len(total)) - np.repeat(np.cumsum(per_list) - per_list, per_list)
    at, weights = unpacked(lists.flatten())
    sums, n = {}, int(at.max()) + 1
    for name, values in (("n_best", top.astype(np.int64) << place), ("count_sum", total << place)):
        sums[name] = np.zeros(n, dtype=np.int64)
        np.add.at(sums[name], at, np.repeat(values, weights))
    return pa.table(
        {"block": pa.array([key[0].as_py()] * n, pa.int64()), "slot": pa.array(np.arange(n), pa.int64())}
        | {k: pa.array(v) for k, v in sums.items()}
    )


def align_documents(documents: DataFrame, json_path: str, model_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents without their text, with facts, scores and digest of their alignment; the pairs of the corpus with their ids
    a and b, ``documents`` that hold them, ``links``, and whether a has the most links of its b)."""
    added = [*FACTS, *SCORES, "groups_sha256"]
    own = ["block", "slot", "pair", "documents", "links", "planes"]
    names = [c for c in documents.columns if c != "text" and c.lower() not in added]
    if any(n.lower() in own for n in names):
        raise ValueError(f"rename columns called {', '.join(own)} first")
    long = T.LongType()
    schema = T.StructType([documents.schema[c] for c in names])
    for name in ("block", "slot", *FACTS, "pair", "documents", "links"):
        schema = schema.add(name, long)
    schema = schema.add("groups_sha256", T.StringType()).add("planes", T.ArrayType(T.BinaryType()))
    run = index(json_path, model_path, names, to_arrow_schema(schema))
    written = stored(documents.select(*names, "text").mapInArrow(run, schema), "alignment")
    lists = written.where(F.col("pair").isNotNull()).select("block", "pair", "documents", "links", "planes")
    totals = lists.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    totals = totals.withColumn("a", F.shiftright("pair", 16)).withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    highest = totals.groupBy("b").agg(F.max("links").alias("highest"))
    pairs = stored(
        totals.join(highest, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("highest")).alias("best")),
        "alignment-pairs",
    )
    # merged at every size: the pairs have no bound that would allow a broadcast
    told = lists.select("block", "pair", "planes").join(
        pairs.select("pair", F.col("links").alias("total"), "best").hint("merge"), "pair"
    )
    returned = told.select("block", "total", "best", "planes").groupBy("block").applyInArrow(
        scores, "block bigint, slot bigint, n_best bigint, count_sum bigint"
    )
    facts = written.where(F.col("slot").isNotNull()).select(*names, "block", "slot", *FACTS, "groups_sha256")
    result = facts.join(returned, ["block", "slot"], "left").select(
        *names, *FACTS, *[F.coalesce(s, F.lit(0)).alias(s) for s in SCORES], "groups_sha256"
    )
    return result, pairs.drop("pair")
