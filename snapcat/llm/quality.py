"""Quality rules, line first: lines that fail are taken out, then documents that lose too much text are rejected.

Built-in functions only. Arrays never leave their row, so nothing is shuffled.

* null text: no words, ``base_failed`` true, ``kept`` false. Empty text likewise.
* repeated rows and equal doc_ids are judged each on its own; extra columns pass through :func:`with_quality` untouched,
  but those named like its results are replaced by them. :func:`reject` returns all columns as they were.
* a very long text is one row: its words, lines and windows must fit a task's memory. A long line is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.llm.shared import blank_free, let

#: The characters that separate words, and those counted as symbols.
BLANK = r"[\x09-\x0D\x20]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: What a line of running text ends with, closing quotes and brackets included.
SENTENCE_END = r"""[.!?:;,…。！？।؟]["'”’»)\]]*[\x09-\x0D\x20]*\z"""
#: Menus and bread crumbs: several items between separators. They fail a line of which they are half or more; a slash
#: separates none, as in addresses.
NAVIGATION = r"(?:[|»›>•·][^|»›>•·]{1,40}){3,}"
#: Phrases that sites repeat on every page. As whole words they fail a short line; in a longer one they are part of prose.
BOILERPLATE = (
    "accept cookies",
    "use cookies",
    "uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for",
    "subscribe to",
    "all rights reserved",
    "log in",
    "skip to content",
)
PHRASE = r"(?:\A|[^\pL\pN])(?:" + "|".join(BOILERPLATE) + r")(?:[^\pL\pN]|\z)"
SHORT_LINE = 100

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 60


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeated_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words covered by a window of ``width`` words that the same text holds twice or more.

    Hashes of the windows tell whether any repeats; only then the windows themselves are sorted, so hashes that collide
    never count.
    """

    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - width + 1)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w) - width + 1, F.lit(0)).otherwise(covered(w))

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - width + 1)
        ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.slice(w, i, width).alias("w"), i.alias("p"))))
        return let(ordered, lambda s: span(F.sort_array(F.filter(F.transform(s, lambda x, k: twin(s, x, k)), F.isnotnull))))

    def twin(s: Column, x: Column, k: Column) -> Column:
        before = F.get(s, k - 1)["w"]
        after = F.get(s, k + 1)["w"]
        return F.when(F.coalesce(before == x["w"], F.lit(False)) | F.coalesce(after == x["w"], F.lit(False)), x["p"])

    def span(starts: Column) -> Column:
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    return let(words, lambda w: F.when(F.size(w) < width + 1, F.lit(0)).otherwise(counted(w)))


def failing_line(line: Column) -> Column:
    """True for a line that is mostly a menu, a short one with boilerplate, or one without the end of a sentence."""
    menus = F.length(line) - F.length(F.regexp_replace(line, F.lit(NAVIGATION), F.lit("")))
    boiler = (F.length(line) <= SHORT_LINE) & F.rlike(F.lower(line), F.lit(PHRASE))
    return ~F.rlike(line, F.lit(SENTENCE_END)) | (F.rlike(line, F.lit(NAVIGATION)) & (2 * menus >= F.length(line))) | boiler


def with_quality(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, lost_chars and kept.

    ``cleaned`` is the text without failing lines. ``kept``: the base rules hold and at most ``max_lost_percent`` of the
    characters in words are lost with the failing lines.
    """
    t = blank_free(docs, "_q")
    plain = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn(f"{t}words", words_of(plain))
    docs = docs.withColumn(f"{t}lines", F.filter(F.split(plain, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))
    words, lines = F.col(f"{t}words"), F.col(f"{t}lines")
    docs = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(plain, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(words).cast("long"),
            "cleaned": F.array_join(F.filter(lines, lambda x: ~failing_line(x)), "\n"),
        }
    )
    left = F.length(F.regexp_replace("cleaned", BLANK + "+", ""))
    docs = docs.withColumn("lost_chars", F.col("word_chars") - left)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    docs = docs.withColumn("base_failed", failed)
    return docs.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars"))).drop(
        f"{t}words", f"{t}lines"
    )


def reject(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, whole and with their own columns only."""
    taken = blank_free(docs, "_r")
    row = docs.select(F.col(text).alias(text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{taken}row"))
    return with_quality(row, text).where("kept").select(f"{taken}row.*")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of op6."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    menus = f"length(l) - length(regexp_replace(l, {quote(NAVIGATION)}, '', 'g'))"
    boiler = f"(length(l) <= {SHORT_LINE} AND regexp_matches(lower(l), {quote(PHRASE)}))"
    navigation = f"(regexp_matches(l, {quote(NAVIGATION)}) AND 2 * ({menus}) >= length(l))"
    fails = f"(NOT regexp_matches(l, {quote(SENTENCE_END)}) OR {navigation} OR {boiler})"
    last = REPEAT_WINDOW - 1
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '{BLANK}+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
    p AS (SELECT r, ws, unnest(range(1, len(ws) - {last} + 1)) AS p FROM w),
    g AS (SELECT r, list(p) AS ps FROM p GROUP BY r, ws[p : p + {last}] HAVING count(*) > 1),
    s AS (SELECT r, unnest(ps) AS p FROM g),
    c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + {REPEAT_WINDOW})) AS q FROM s) GROUP BY r),
    b AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        length(regexp_replace(array_to_string(list_filter(ls, lambda l: NOT {fails}), ''), '{BLANK}+', '', 'g')) AS rest
        FROM w LEFT JOIN c ON c.r = w.r),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND 100 * (word_chars - rest) <= {MAX_LOST_PERCENT} * word_chars AS kept FROM f"""
