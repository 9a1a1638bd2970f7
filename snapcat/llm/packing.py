"""Vector bin packing of examples into training sequences.

An example is a vector: its tokens, one segment, its loss-bearing tokens. A sequence has a limit for each. From a pool of
waiting examples the sequence takes the one with the largest dot product with what is left of its limits (each part over
its limit), as long as one fits; then an example is cut to fill the rest. One task packs the documents of its partition: no
shuffle, and a pool of bounded size. Equal input partitions give equal sequences, so a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm.tokens import encoder, slices

#: Examples that wait at once in a task.
POOL = 1024


class Packer:
    """Packs examples added one by one; yields sequences as lists of (example, start, length).

    Loss-bearing are all tokens but an example's first ``prompt`` ones. With ``cut`` an example may be spread over
    sequences; an example longer than a limit always is.
    """

    def __init__(self, tokens: int = 1024, segments: int = 64, loss: int = 1024, cut: bool = True):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.tokens, self.segments, self.loss, self.cut = tokens, segments, loss, cut
        self.size = 0
        self.start = np.zeros(POOL, dtype=np.int64)
        self.length = np.zeros(POOL, dtype=np.int64)
        self.prompt = np.zeros(POOL, dtype=np.int64)
        self.items: list[object] = [None] * POOL

    def bearing(self, start, length, prompt):
        """Loss-bearing tokens of a piece."""
        return length - np.clip(prompt - start, 0, length)

    def fitting(self, start: int, length: int, prompt: int, room: int, loss: int) -> int:
        """The longest front of a piece within ``room`` tokens and ``loss`` loss-bearing ones."""
        free = min(max(prompt - start, 0), length)
        return min(length, room, free + loss)

    def put(self, item: object, start: int, length: int, prompt: int) -> None:
        k = self.size
        self.start[k], self.length[k], self.prompt[k], self.items[k] = start, length, prompt, item
        self.size += 1

    def take(self, k: int) -> tuple[object, int, int, int]:
        item = self.items[k], int(self.start[k]), int(self.length[k]), int(self.prompt[k])
        last = self.size = self.size - 1
        self.start[k], self.length[k], self.prompt[k], self.items[k] = (
            self.start[last],
            self.length[last],
            self.prompt[last],
            self.items[last],
        )
        self.items[last] = None
        return item

    def add(self, item: object, length: int, prompt: int = 0) -> Iterator[list[tuple[object, int, int]]]:
        """Takes an example; yields the sequences that are complete."""
        start = 0
        while (front := self.fitting(start, length - start, prompt, self.tokens, self.loss)) < length - start or (
            self.cut and front == self.tokens
        ):
            yield [(item, start, front)]
            start += front
            if start == length:
                return
        self.put(item, start, length - start, prompt)
        while self.size >= POOL - self.segments:
            yield self.sequence()

    def sequence(self) -> list[tuple[object, int, int]]:
        room, left, loss = self.tokens, self.segments, self.loss
        placed: list[tuple[object, int, int, int]] = []
        while room and left and self.size:
            n = self.size
            length = self.length[:n]
            bearing = self.bearing(self.start[:n], length, self.prompt[:n])
            fits = (length <= room) & (bearing <= loss)
            if not fits.any():
                break
            rest = np.array([room, left, loss]) / self.limits / self.limits
            score = length * rest[0] + rest[1] + bearing * rest[2]
            item = self.take(int(np.argmax(np.where(fits, score, -1.0))))
            placed.append(item)
            room -= item[2]
            left -= 1
            loss -= int(self.bearing(item[1], item[2], item[3]))
        if self.cut and room and left and self.size:
            fronts = [
                self.fitting(int(self.start[k]), int(self.length[k]), int(self.prompt[k]), room, loss) for k in range(self.size)
            ]
            k = int(np.argmax(fronts))
            if fronts[k] > 0:
                item, start, length, prompt = self.take(k)
                placed.append((item, start, fronts[k], prompt))
                self.put(item, start + fronts[k], length - fronts[k], prompt)
                room -= fronts[k]
        if self.cut and room and self.size:  # a limit other than tokens binds: end at a power of two, which needs no padding
            self.trim(placed, self.tokens - room)
        return [x[:3] for x in placed]

    def trim(self, placed: list[tuple[object, int, int, int]], filled: int) -> None:
        """Cuts what is over the largest power of two off the end of ``placed`` and puts it back."""
        excess = filled - (1 << (filled.bit_length() - 1))
        while excess:
            item, start, length, prompt = placed.pop()
            back = min(excess, length)
            if back < length:
                placed.append((item, start, length - back, prompt))
            self.put(item, start + length - back, back, prompt)
            excess -= back

    def finish(self) -> Iterator[list[tuple[object, int, int]]]:
        """The last sequences; with ``cut`` what is left at the end goes to sequences of powers of two."""
        while self.size:
            last = self.sequence()
            filled = sum(x[2] for x in last)
            if not self.cut or self.size or filled == self.tokens:
                yield last
                continue
            while last:
                size, part = 1 << (filled.bit_length() - 1), []
                filled -= size
                while size:
                    item, start, length = last.pop(0)
                    front = min(size, length)
                    part.append((item, start, front))
                    if front < length:
                        last.insert(0, (item, start + front, length - front))
                    size -= front
                yield part


PIECES = (
    "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, "
    "loss_tokens BIGINT, ids BINARY"
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    tokens: int = 1024,
    segments: int = 64,
    loss: int = 1024,
    with_ids: bool = True,
    plain: bool = True,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    A document's ids are those of its text (null: none) and id 0. Its first id bears no loss, as nothing comes before it.
    ids is the piece's ids as little-endian unsigned 32-bit integers (null without ``with_ids``). Repeated rows are packed
    each on its own; a null doc_id stays null; other columns are not read. An empty table gives no rows. ``plain``: special
    tokens in a text are encoded as text (see :class:`snapcat.llm.tokens.Encoder`); the queries leave them tokens.
    """

    def packed(batches):
        import pyarrow as pa

        codec, packer = encoder(tokenizer, plain), Packer(tokens, segments, loss)
        number = TaskContext.get().partitionId() << 40
        types = [pa.int64()] * 8 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
        rows: list[tuple] = []

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def keep(sequence):
            nonlocal number
            offset = 0
            for (doc_id, ids), start, length in sequence:
                piece = ids[4 * start : 4 * (start + length)]
                bears = length - (start == 0)
                total = len(ids) // 4
                rows.append(
                    (doc_id, start, length, zlib.crc32(piece), total, number, offset, bears, piece if with_ids else None)
                )
                offset += length
            number += 1

        for source in batches:
            for doc_ids, texts in slices(source, ("doc_id", "text")):
                for doc_id, ids in zip(doc_ids, codec.encode(texts), strict=True):
                    ids += b"\0\0\0\0"
                    for sequence in packer.add((doc_id, ids), len(ids) // 4, 1):
                        keep(sequence)
                if len(rows) >= 2048:
                    yield batch()
                    rows.clear()
        for sequence in packer.finish():
            keep(sequence)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, PIECES)


def pack_examples(
    examples: DataFrame, tokens: int = 1024, segments: int = 64, loss: int = 1024, cut: bool = False
) -> DataFrame:
    """Packs examples given as (example_id, n_tokens, n_prompt): rows (example_id, start, length, sequence_id, offset).

    For instruction data, whose loss-bearing tokens are those behind the prompt. Without ``cut`` an example stays whole
    unless a limit is smaller than it. Null counts are 0; an example without tokens gives no piece.
    """

    def packed(batches):
        import pyarrow as pa

        packer, number, rows = Packer(tokens, segments, loss, cut), TaskContext.get().partitionId() << 40, []

        def keep(sequence):
            nonlocal number
            offset = 0
            for item, start, length in sequence:
                rows.append((item, start, length, number, offset))
                offset += length
            number += 1

        def batch():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["example_id", "start", "length", "sequence_id", "offset"]
            )

        for source in batches:
            for ids, lengths, prompts in slices(source, ("example_id", "n_tokens", "n_prompt"), 4096):
                for example, length, prompt in zip(ids, lengths, prompts, strict=True):
                    if length and length > 0:
                        for sequence in packer.add(example, length, prompt or 0):
                            keep(sequence)
                if rows:
                    yield batch()
                    rows.clear()
        for sequence in packer.finish():
            keep(sequence)
        if rows:
            yield batch()

    long = [F.col(c).cast("long") for c in ("example_id", "n_tokens", "n_prompt")]
    schema = "example_id BIGINT, start BIGINT, length BIGINT, sequence_id BIGINT, offset BIGINT"
    return examples.select(*long).mapInArrow(packed, schema)
