"""Small tables with awkward rows, and plain versions of the operators to compare with."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, rid STRING, start STRING, key STRING, row STRING, "
    "name STRING, n_words STRING, _count STRING"
)


def prose(rng, n, lines=True):
    words = ["".join(rng.choice(["an", "th", "er", "ou", "sté", "ño", "li", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w + ("." if k % 9 == 8 or k == n - 1 else ""))
        out.append("\n" if lines and k % 27 == 26 else " ")
    return "".join(out).strip()


def awkward_texts(seed=3):
    """Texts with copies, near copies, shared passages, runs of blanks, marks of other scripts, junk and long ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    passage = prose(rng, 60, lines=False)
    out = list(base)
    out += base[:5] * 3
    for k in range(60):
        words = base[5 + k % 4].split(" ")
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"edit{k}x{rng.randrange(99)}"
        out.append(" ".join(words))
    out += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25) for _ in range(12)]
    out += [passage.replace(" ", "\t\x0b"), passage.upper(), "a b c", "A b c", "one", "", "   \n\t ", None, None]
    out += ["ab " * 400, "x" * 3000, "na na na " * 50 + "end", "  two  spaces \n\n here ", "日本語の文章。 다른 글", "don't 'tis <|endoftext|> 12 345"]
    out += ["Menu | Home | News | About | Contact", "We use cookies.\n" + prose(rng, 60), "### $$$ %%% " * 20]
    out.append(prose(rng, 6000))
    rng.shuffle(out)
    return out


def documents(spark, texts=None, messy=False):
    texts = awkward_texts() if texts is None else texts
    rows = [(k, t, "en", "s", len(t or ""), *["clash"] * 7) for k, t in enumerate(texts)]
    if messy:  # null and repeated ids, repeated rows
        rows += [(None, texts[0], None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
        rows += [rows[3], rows[3], (7, "another text under an id that is taken", "en", "s", 1, *["clash"] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def shingle_set(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def component_ids(texts, k=4, percent=85):
    """Smallest index reachable, per index."""
    sets = [shingle_set(t, k) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(sets))], [len(s) for s in sets]


def window_mask(texts, width=35):
    """Per text the words that a window covers which starts elsewhere too."""
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def suffix_rows(texts, width=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) per text in order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            piece = raw[i : i + width]
            if piece in seen:
                gone[i : i + width] = [True] * width
            seen.add(piece)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
