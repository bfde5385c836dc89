"""Line-first cleaning: judge every line, drop the lines that fail, then judge the documents.

A line fails if it is mostly symbols or shouting (more than one of `[#*$%&|<>!]` for two words), if it is
a navigation bar (two or more stand-alone "|", and one for three words at most), if it holds a
boilerplate phrase, or if it has many words and no sentence punctuation at all. A document that passes
the base checks is kept if failing lines hold at most `max_lost` percent of its word characters. The
cleaned text is its passing lines, blank ones among them, joined by line feeds; the query leaves it out.

Everything stays inside one row: no shuffle, whatever the length or the skew of the documents.

Defined results. Null, empty or white text: all counts 0, base_failed true, kept false, the text as it is.
A text whose lines all pass is unchanged to the byte. Counts and base checks are those of the whole text.
A document that is not kept has its cleaned text too. Repeated rows and ids each give their own row. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, table

SYMBOLS = "#*$%&|<>"
PHRASES = (
    *("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript"),
    *("click here", "subscribe to", "sign in to", "log in to", "skip to content", "back to top", "share this"),
)
BOILERPLATE = "|".join(PHRASES)
WINDOW, MIN_WORDS, MAX_REPEAT, MAX_LOST, RUN_ON = 8, 20, 30, 50, 40


def _without(text: Column, chars: str) -> Column:
    """Searches for bytes, one a character: far cheaper than a pattern or a translation of every character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _words(text: Column) -> Column:
    flat = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def marks(text: Column) -> Column:
    """What of the rules' marks a text has at all: most texts have none, and their lines need no look."""
    low = F.lower(text)
    return F.struct(
        reduce(or_, [text.contains(c) for c in SYMBOLS + "!"]).alias("symbols"),
        text.contains(" | ").alias("bars"),
        reduce(or_, [low.contains(p) for p in PHRASES]).alias("phrases"),
    )


def line_fails(line: Column, has: Column) -> Column:
    """has: `marks` of the whole text. The cheap conditions come first and decide for most lines."""
    words = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(r" \|(?= )"))
    return (
        (has.symbols & (2 * _count(line, SYMBOLS + "!") > words))
        | (has.bars & (bars >= 2) & (3 * bars >= words))
        | ((F.length(line) > 2 * RUN_ON) & ~line.rlike("[.!?,;:]") & (words > RUN_ON))
        | (has.phrases & F.lower(line).rlike(BOILERPLATE))
    )


def _chars(text: Column) -> Column:
    return F.length(_without(text, SPACES))


def cleaned(text: Column) -> Column:
    """The lines that pass. The text's marks are bound by an outer lambda: the optimizer would look for them once a line."""
    passing = lambda y: F.array_join(F.filter(F.split(y.text, "\n", -1), lambda x: ~line_fails(x, y.has)), "\n")
    return F.transform(F.array(F.struct(text.alias("text"), marks(text).alias("has"))), passing)[0]


def _windows(hashes: Column) -> Column:
    """Hashes of all runs of 8 (WINDOW) word hashes: of two, of two twos, of two fours."""
    joined = lambda h, step: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
    return F.slice(joined(joined(joined(hashes, 1), 2), 4), F.lit(1), F.size(hashes) - (WINDOW - 1))


def quality_rules(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """Counts and verdict of each document, and its cleaned text."""
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", text.alias("text"), F.col("text").isNull().alias("none"), _words(text).alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("l"))
    n = F.size("w").cast("long")
    a = a.select("doc_id", "text", "none", "l", n.alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"), cleaned(F.col("text")).alias("cleaned"))
    a = a.select("*", F.when(F.size("w") >= WINDOW, _windows(F.col("w"))).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    a = a.select("*", F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1),
        F.slice("s", F.lit(2), F.size("s") - 1),
        lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")),
    )
    a = a.select("*", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same)))).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda x, y: F.least(y - x, F.lit(WINDOW)).cast("long"))
    covered = F.when(F.col("p").isNotNull(), F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda x, y: x + y)).otherwise(F.lit(0).cast("long"))
    lost = F.when(F.col("cleaned") == F.col("text"), 0).otherwise(_chars(F.col("text")) - _chars(F.col("cleaned")))
    a = a.select(
        "doc_id",
        "n_words",
        _chars(F.col("text")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        lost.cast("long").alias("lost_chars"),
        F.when(~F.col("none"), F.col("cleaned")).alias("text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    a = a.select("*", failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars"))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lost_chars", "text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text")


ORACLE = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, string_agg(word, ' ' ORDER BY i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram, n
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM a)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE i + 7 <= n) WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
x AS (
  SELECT doc_id, unnest(l) AS line FROM a),
y AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS nw,
         len(line) - len(regexp_replace(line, '[#*$%&|<>!]', '', 'g')) AS sym,
         (len(line) - len(replace(replace(line, ' | ', '  '), ' | ', '  '))) AS bars,
         len(line) - len(regexp_replace(line, '[.!?,;:]', '', 'g')) AS punct
  FROM x),
z AS (
  SELECT doc_id, sum(len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS lost FROM y
  WHERE 2 * sym > nw OR (bars >= 2 AND 3 * bars >= nw) OR (nw > {RUN_ON} AND punct = 0) OR regexp_matches(lower(line), '{BOILERPLATE}')
  GROUP BY doc_id),
b AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(z.lost, 0)::BIGINT AS lost_chars
  FROM a LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept,
       lost_chars
FROM b
"""
