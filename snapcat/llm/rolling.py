"""Hashes of words and n-grams of many texts at once, and runs of windows that share their smallest n-gram hash."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64, and the constants of a 64-bit mixer.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes that separate words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text worked on at once, whole texts.
BLOCK = 2 << 20

_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        _POWERS.clear()
        for factor in (BASE, INVERSE):
            out = np.full(size, factor, dtype=np.uint64)
            out[0] = 1
            _POWERS.append(np.cumprod(out))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of any slice of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=self.sums[1:])

    def of(self, starts, ends) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + np.uint64(1))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k numbers from each place on."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice of bytes: eight bytes at a time are mixed with their place, then added up.

    Unlike a polynomial modulo 2^64 this has no pairs of strings that collide for every multiplier."""
    size = len(data)
    eight = np.zeros(size + 8, dtype=np.uint64)  # the eight bytes from each place on
    eight[:size] = data
    for step in (1, 2, 4):
        eight[:size] |= eight[step : size + step] << np.uint64(8 * step)
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    left = np.repeat(lengths, pieces) - 8 * place
    unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    found = (eight[np.repeat(starts, pieces) + 8 * place] << unused) >> unused
    sums = np.zeros(len(found) + 1, dtype=np.uint64)
    np.cumsum(mixed(found ^ mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))), out=sums[1:])
    return mixed(sums[first + pieces] - sums[first] + lengths.astype(np.uint64) * MIX[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of texts that lie one behind the other."""
    if not len(data):
        return (np.empty(0, dtype=np.int64),) * 3
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, side="right") - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(values: np.ndarray, bounds: np.ndarray, gram: int, window: int):
    """Runs of windows whose smallest gram (the first such) is at one place: (document, first window, windows, key).

    ``bounds`` are the ends of the documents in ``values``, with 0 in front. Equal windows have equal keys, wherever they
    are, and windows at two places are in two runs. A run has no more windows than a window has grams.
    """
    width = window - gram + 1
    grams = Sums(values).grams(gram)
    least = sliding_min(grams, width)
    if not len(least):
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.int64),)
    lengths = np.diff(bounds)
    valid = np.zeros(len(values) + 1, dtype=np.int32)
    long = lengths >= window
    valid[bounds[:-1][long]] += 1
    valid[bounds[1:][long] - window + 1] -= 1
    valid = np.cumsum(valid)[: len(least)] > 0
    head = valid.copy()
    # a smallest gram at the front of the window before has left: if the value goes on, it stands at a second place
    head[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(head)
    if not len(first):
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.int64),)
    doc = np.searchsorted(bounds, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(values)), bounds[doc + 1] - window + 1)
    return doc, first - bounds[doc], last - first, least[first].view(np.int64)


def text_blocks(batch, column: int):
    """(first row, bytes, offsets) of the texts of an Arrow batch, about BLOCK bytes at a time; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
