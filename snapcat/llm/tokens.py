"""Token ids of whole texts by the tokenizers library, for byte-level BPE files without a normalizer."""

from __future__ import annotations

import os
import re

import numpy as np

#: A space before white space (or the end) belongs to a run; elsewhere a token never reaches across the front of a space.
RUN = re.compile("(?: (?=[\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\u2060\\ufeff]|\\Z))")
#: Pieces whose ids a worker remembers; beyond that it starts anew, and takes over from the last as many those it meets again.
MEMORY = 600_000
#: Characters of texts that are cut at once.
TURN = 1 << 22
#: Characters given to the library at once.
BLOCK = 1 << 11
#: Marks of which one behind a word is a token of its own, whatever follows.
MARKS = ",."
#: Letters in any version of Unicode.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class Pieces:
    """Ids of texts as bytes (little-endian unsigned 32-bit), from the ids of their distinct pieces.

    The pattern that splits a text before merging always splits in front of a single space, so a text is cut there, and each
    distinct piece is encoded once (Arrow cuts the texts of a turn and numbers their pieces). Texts with runs of white space behind a space, and those with one of the strings of
    ``uncut``, are encoded whole.
    """

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.uncut: list[str] = []

    def wholes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        raise NotImplementedError

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of new pieces, each with the space in front of it, to ``known``."""
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """In turns of about ``TURN`` characters."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < TURN or end == at):
                size += len(texts[end] or "")
                end += 1
            out += self.turn(texts[at:end])
            at = end
        return out

    def turn(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        heads: list[str] = []
        rests: list[str | None] = []
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        for text in texts:
            if not text or RUN.search(text) or any(t in text for t in self.uncut):
                heads.append(text or "")
                rests.append(None)
            else:
                head, space, rest = text.partition(" ")
                heads.append(head)
                rests.append(rest if space else None)
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.known.get, distinct))
        if missing := [k for k, ids in enumerate(raw) if ids is None]:
            names = {distinct[k] for k in missing}
            self.known.update({p: ids for p in names if (ids := self.older.get(p)) is not None})
            self.learn(names.difference(self.known))
            for k in missing:
                raw[k] = self.known[distinct[k]]
        fronts = dict(zip(asked := [h for h in heads if h], self.wholes(asked), strict=True))
        fronts[""] = b""
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        starts = np.cumsum(sizes) - sizes
        names = pieces.indices.to_numpy()
        sizes = sizes[names]
        ends = np.cumsum(sizes)
        places = np.arange(int(sizes.sum())) + np.repeat(starts[names] - (ends - sizes), sizes)
        ids = np.frombuffer(b"".join(raw), "<u4").take(places).tobytes()
        bounds = np.append(0, 4 * ends)[np.asarray(cut.offsets)].tolist()
        return [fronts[h] + ids[start:end] for h, start, end in zip(heads, bounds, bounds[1:], strict=False)]


class Encoder(Pieces):
    """By the tokenizers library; equal to its ids of the whole text.

    ``plain``: the text of a special token (``<|endoftext|>``) is encoded like any other; otherwise it is that token, as the
    library does by itself.
    """

    def __init__(self, path: str, plain: bool = True):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        added = self.library.get_added_tokens_decoder().values()
        self.uncut = [t.content for t in added if not (plain and t.special)]
        if any(" " in t for t in self.uncut):  # could span pieces
            self.uncut = [""]
        vocab = self.library.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.lengths = np.ones(self.vocab_size, dtype=np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)
        self.marks = dict(zip(MARKS, self.wholes(list(MARKS)), strict=True))

    def wholes(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def learn(self, pieces: set[str]) -> None:
        """A word and the mark behind it are separate tokens, so such a piece comes from the ids of both."""
        known, marked = self.known, []
        words = set()
        for p in pieces:
            word = p[:-1]
            if p[-1] in MARKS and LETTERS.fullmatch(word):
                marked.append(p)
                if word not in known:
                    words.add(word)
            else:
                words.add(p)
        self.learn_words(list(words))
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[p[-1]]

    def learn_words(self, pieces: list[str]) -> None:
        """Many in one call of the library; token lengths tell where one ends."""
        at, texts, parts = 0, [], []
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (size < BLOCK or end == at):
                size += len(pieces[end]) + 1
                end += 1
            parts.append(pieces[at:end])
            texts.append(" " + " ".join(parts[-1]))
            at = end
        known = self.known
        for k in range(0, len(texts), 16):
            encoded = self.library.encode_batch_fast(texts[k : k + 16], add_special_tokens=False)
            for text, part, encoding in zip(texts[k : k + 16], parts[k : k + 16], encoded, strict=True):
                ids = np.array(encoding.ids, dtype="<u4")
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.append(np.flatnonzero(data == 32)[1:], len(data))
                if len(ends) != len(part):  # some piece holds a space
                    ends = np.cumsum([len(p.encode()) + 1 for p in part])
                cuts = 4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1)
                raw, start = ids.tobytes(), 0
                for p, cut in zip(part, cuts.tolist(), strict=True):
                    known[p] = raw[start:cut]
                    start = cut


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = True) -> Encoder:
    """One encoder per file, kind and Python worker."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


def slices(batch, columns: tuple[str, ...], rows: int = 256):
    """Lists of the columns of an Arrow record batch, a few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
