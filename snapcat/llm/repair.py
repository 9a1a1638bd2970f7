"""Re-Pair grammars over arrays of token ids, with the expansion lengths that random access needs."""

from __future__ import annotations

import io
import json
import struct

import numpy as np

MAGIC = b"RPG1"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A round replaces pairs down to this part of the most frequent one's count.
SPAN = 64
#: A round leaves a pair alone that would lose more than the rest of its occurrences to more frequent neighbours.
SHARE = 0.7
#: Pairs are counted exactly where less than this part of the sequence can still hold a frequent one, or of the places that
#: can less than the second part were replaced in the last round.
TAIL, STUCK = 16, 32
#: Bits of a rule's expansion length; a length that needs more is 0 there and stored behind them.
SHORT = 5
#: Rules of at most so many ids are written out before a shard is decoded.
FLAT = 32


def apart(pairs: np.ndarray, counts: np.ndarray) -> list[int]:
    """The most frequent pairs of which no two can overlap: no symbol is the left part of one and the right of another."""
    lefts: set[int] = set()
    rights: set[int] = set()
    chosen = []
    for key in pairs[np.argsort(-counts, kind="stable")].tolist():
        a, b = key >> 32, key & 0xFFFFFFFF
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(key)
    return chosen


def every_other(at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of chosen places that follow each other (a run of one symbol) the first, the third and so on."""
    won = np.flatnonzero(chosen)
    places = at.take(won)
    follows = np.append(False, places[1:] == places[:-1] + 1)[: len(won)]
    if follows.any():
        order = np.arange(len(won))
        start = np.maximum.accumulate(np.where(follows, 0, order))
        won = won[(order - start) % 2 == 0]
    return won


def exact_round(at: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(frequent places, places to replace, number of the rule of each, pairs of the rules), by sorted pairs."""
    pairs, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts[of] >= least
    at, of = at[often], of[often]
    high = np.flatnonzero(counts >= max(least, int(counts.max()) // SPAN))
    if not len(at):
        return at, at, of, pairs[:0]
    chosen = np.sort(np.array(apart(pairs[high], counts[high]), dtype=np.uint64))
    rule = np.full(len(pairs), -1)
    rule[np.searchsorted(pairs, chosen)] = np.arange(len(chosen))
    rule = rule[of]
    won = every_other(at, rule >= 0)
    return at, at[won], rule[won], chosen


def hashed_round(at: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The same by counts per bin of a hash, which are never too low: a place wins that is no less frequent than those it
    overlaps, and of the pairs in a bin the one named last is replaced, if it wins often enough by its own count."""
    bits = max(12, min(21, len(at).bit_length() + 1))
    bins = keys * MIX
    bins >>= np.uint64(64 - bits)
    bins = bins.view(np.int64)
    counts = np.bincount(bins, minlength=1 << bits).take(bins)
    hot = np.flatnonzero(counts >= least)
    if not len(hot):
        return hot, hot, hot, keys[:0]
    if len(hot) < len(at):
        at, keys, bins, counts = at.take(hot), keys.take(hot), bins.take(hot), counts.take(hot)
    weight = counts << bits
    weight |= bins
    near = at[1:] == at[:-1] + 1
    win = counts >= max(least, int(counts.max()) // SPAN)
    win[1:] &= ~(near & (weight[1:] < weight[:-1]))
    win[:-1] &= ~(near & (weight[1:] > weight[:-1]))
    won = every_other(at, win)
    keys, bins, place = keys.take(won), bins.take(won), np.arange(len(won), dtype=np.int32)
    last = np.empty(1 << bits, dtype=np.int32)
    last[bins] = place
    last = last.take(bins)
    same = keys.take(last) == keys
    used = np.bincount(last[same], minlength=len(won))
    good = np.flatnonzero((used >= least) & (used >= SHARE * counts.take(won)))
    rule = np.full(len(won), -1)
    rule[good] = np.arange(len(good))
    rule = rule.take(last)
    use = np.flatnonzero(same & (rule >= 0))
    return at, at.take(won.take(use)), rule.take(use), keys.take(good)


def compress(ids: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule k replaces its pair by symbol first + k. No pair of the sequence occurs ``least`` times.

    A round counts only where a pair was frequent in the round before or holds a symbol made there: the count of any other
    pair never grows.
    """
    seq = np.array(ids, dtype=np.uint32)
    rules = [np.empty(0, dtype=np.uint64)]
    size, at, stuck = first, np.arange(max(len(seq) - 1, 0)), False
    while len(at):
        if len(at) == len(seq) - 1:
            keys = seq[:-1].astype(np.uint64) << np.uint64(32)
            keys |= seq[1:]
        else:
            keys = seq.take(at).astype(np.uint64) << np.uint64(32)
            keys |= seq.take(at + 1)
        step = exact_round if stuck or len(at) * TAIL <= len(seq) else hashed_round
        live, places, rule, pairs = step(at, keys, least)
        if not len(live):
            break
        if not len(pairs):  # all lose to each other, or bins counted too much
            live, places, rule, pairs = exact_round(at, keys, least)
            if not len(pairs):
                break
        stuck = step is hashed_round and len(places) * STUCK < len(live)
        rules.append(pairs)
        seq[places] = size + rule
        size += len(pairs)
        keep = np.ones(len(seq), dtype=bool)
        keep[places + 1] = False
        open_ = np.zeros(len(seq), dtype=bool)
        open_[live] = True
        open_[places] = True
        open_[places[places > 0] - 1] = True
        seq, open_ = seq[keep], open_[keep]
        open_[-1] = False
        at = np.flatnonzero(open_)
    made = np.concatenate(rules)
    return np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), seq


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids each rule stands for; rules up to the next that needs one of them are added up together."""
    lengths = np.ones(first + len(rules), dtype=np.int64)
    needs, at = rules.max(axis=1, initial=0).astype(np.int64) - first, 0
    while at < len(rules):
        end, step = at + 1, 64
        while end < len(rules):
            late = np.flatnonzero(needs[end : end + step] >= at)
            if len(late):
                end += int(late[0])
                break
            end, step = min(end + step, len(rules)), step * 2
        lengths[first + at : first + end] = lengths[rules[at:end, 0]] + lengths[rules[at:end, 1]]
        at = end
    return lengths[first:]


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = seq.astype(np.int64)
    while len(seq):
        rule = seq >= first
        if not rule.any():
            break
        width = np.where(rule, 2, 1)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), dtype=np.int64)
        out[at[~rule]] = seq[~rule]
        pair = rules[seq[rule] - first]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq.astype(np.uint32)


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ``flat`` from each start on, as many as the size says, one run after the other."""
    ends = np.cumsum(sizes)
    return flat.take(np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes))


def packed(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each value, one after the other."""
    rows = np.ascontiguousarray(values, dtype="<u4").reshape(-1, 1).view(np.uint8)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpacked(data: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    """``count`` values of ``bits`` bits from ``at`` on, and where they end."""
    end = at + (count * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(data, np.uint8, end - at, at), count=count * bits, bitorder="little")
    rows = np.packbits(flat.reshape(count, bits), axis=1, bitorder="little")
    out = np.zeros((count, 4), dtype=np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u4").ravel(), end


def to_bytes(ids: np.ndarray, lengths: np.ndarray, first: int, least: int) -> bytes:
    """A shard: header, rules, their expansion lengths (short, then large ones), ids per document, symbols; each part in as few bits as it needs."""
    rules, seq = compress(ids, first, least)
    wide = max(1, (first + len(rules) - 1).bit_length())
    reach = rule_lengths(rules, first)
    long = max(1, int(reach.max(initial=1)).bit_length())
    large = reach >= 1 << SHORT
    head = {"first": first, "rules": len(rules), "docs": len(lengths), "symbols": len(seq), "wide": wide, "long": long}
    head["large"] = int(large.sum())
    out = io.BytesIO()
    text = json.dumps(head).encode()
    out.write(MAGIC + struct.pack("<I", len(text)) + text)
    out.write(packed(rules, wide))
    out.write(packed(np.where(large, 0, reach), SHORT))
    out.write(packed(reach[large], long))
    out.write(np.asarray(lengths).astype("<u8").tobytes())
    out.write(packed(seq, wide))
    return out.getvalue()


class Shard:
    """A shard file's bytes: documents are decoded one by one, only from the symbols that cover them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + size])
        self.first, at = head["first"], 8 + size
        rules, at = unpacked(data, at, 2 * head["rules"], head["wide"])
        self.rules = rules.reshape(-1, 2)
        reach, at = unpacked(data, at, head["rules"], SHORT)
        large, at = unpacked(data, at, head["large"], head["long"])
        reach = reach.astype(np.int64)
        reach[reach == 0] = large
        self.sizes = np.concatenate([np.ones(self.first, dtype=np.int64), reach])
        self.lengths = np.frombuffer(data, "<u8", head["docs"], at).astype(np.int64)
        at += 8 * head["docs"]
        self.symbols, _ = unpacked(data, at, head["symbols"], head["wide"])
        self.ends = np.cumsum(self.sizes[self.symbols])
        if int(self.lengths.sum()) != (int(self.ends[-1]) if len(self.ends) else 0):
            raise ValueError("a shard whose symbols do not expand to its documents")

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start + length of the shard."""
        if length <= 0:
            return np.empty(0, dtype=np.uint32)
        low = int(np.searchsorted(self.ends, start, side="right"))
        high = int(np.searchsorted(self.ends, start + length, side="left"))
        skip = start - (int(self.ends[low - 1]) if low else 0)
        return expand(self.symbols[low : high + 1], self.rules, self.first)[skip : skip + length]

    def written_out(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, start per symbol): what each symbol of at most ``FLAT`` ids stands for, one after the other."""
        reach = self.sizes[self.first :]
        small = np.flatnonzero(reach <= FLAT)
        small = small[np.argsort(reach[small], kind="stable")]
        sizes = reach[small]
        starts = np.zeros(len(self.sizes), dtype=np.int64)
        starts[: self.first] = np.arange(self.first)
        starts[self.first + small] = self.first + np.cumsum(sizes) - sizes
        flat = np.empty(self.first + int(sizes.sum()), dtype=np.uint32)
        flat[: self.first] = np.arange(self.first)
        bounds = np.searchsorted(sizes, np.arange(2, FLAT + 2)).tolist()
        for low, high in zip(bounds, bounds[1:], strict=False):  # parts are shorter than the whole
            if low < high:
                parts, at = self.rules[small[low:high]].ravel(), int(starts[self.first + small[low]])
                ids = runs(flat, starts[parts], self.sizes[parts])
                flat[at : at + len(ids)] = ids
        return flat, starts

    def documents(self, block: int = 1 << 18):
        """The ids of each document in turn; symbols are expanded a block at a time."""
        flat, places = self.written_out()
        starts = np.cumsum(self.lengths) - self.lengths
        at = 0
        while at < len(self.lengths):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + block, side="left")))
            start, length = int(starts[at]), int(self.lengths[at:end].sum())
            low = int(np.searchsorted(self.ends, start, side="right"))
            high = int(np.searchsorted(self.ends, start + length, side="left"))
            symbols = self.symbols[low : high + 1]
            sizes = self.sizes[symbols]
            skip = start - (int(self.ends[low - 1]) if low else 0)
            froms, large = places[symbols], np.flatnonzero(sizes > FLAT)
            froms[large] = len(flat) + np.cumsum(sizes[large]) - sizes[large]
            everything = np.concatenate([flat, expand(symbols[large], self.rules, self.first)]) if len(large) else flat
            ids = runs(everything, froms, sizes)[skip : skip + length]
            cuts = np.cumsum(self.lengths[at:end])
            yield from np.split(ids, cuts[:-1])
            at = end
