"""Line-first quality rules, by DataFrame and SQL functions alone.

Each line with a word is judged by itself and removed if it breaks a rule:

* navigation: three or more bars, at least one for every three words;
* punctuation: three or more symbols of `#*$%&<>` and more of them than words,
  or six or more exclamation marks and more of them than words;
* boilerplate: a line of BOILERPLATE_WORDS words at most with a phrase of BOILERPLATE;
* repetition: a line equal to an earlier one.

A document is kept unless its base counts fail or it loses more than MAX_LOST
per cent of the characters in its words.

Defined cases: a null or empty text has counts of 0, fails and has a null or
empty clean text; equal rows are rows of their own; very long texts are judged
whole; no rows give no rows; other columns are kept by clean(), except those
whose names it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, renamed

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 40
BOILERPLATE_WORDS = 25
# Phrases of boilerplate, in small letters.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy", "sign up for our newsletter",
    "share this article", "skip to content", "subscribe to our newsletter", "terms of service", "use cookies",
)
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def bad_line(line: Column) -> Column:
    """Whether a line breaks one of the rules that look at it alone."""
    words = _word_count(line)
    bars, symbols, shouts = _count(line, "|"), _count(line, "#*$%&<>"), _count(line, "!")
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE)) & (words <= BOILERPLATE_WORDS)
    return (
        ((bars >= 3) & (3 * bars >= words))
        | ((symbols >= 3) & (symbols > words))
        | ((shouts >= 6) & (shouts > words))
        | boilerplate
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and some columns that start with __."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    given = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    given = given.withColumn(
        "__windows",
        F.expr("transform(CASE WHEN size(__words) >= 3 THEN sequence(0, size(__words) - 3) ELSE array() END, i -> xxhash64(__words[i], __words[i + 1], __words[i + 2]))"),
    )
    given = given.withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    # each window's hash with its place in the low bits, sorted: equal windows stand next to each other
    given = given.withColumn("__low", F.expr("shiftleft(1L, CAST(ceil(log2(size(__windows) + 1)) AS INT)) - 1"))
    given = given.withColumn("__sorted", F.expr("sort_array(transform(__windows, (h, i) -> (h & ~__low) | i))"))
    # neighbours that are equal, the whole hashes too; their places, ascending
    given = given.withColumn(
        "__pairs",
        F.expr("""filter(zip_with(slice(__sorted, 1, greatest(size(__sorted) - 1, 0)), slice(__sorted, 2, greatest(size(__sorted) - 1, 0)), (a, b) ->
            CASE WHEN (a ^ b) BETWEEN 0 AND __low AND __windows[CAST(a & __low AS INT)] = __windows[CAST(b & __low AS INT)]
            THEN array(CAST(a & __low AS INT), CAST(b & __low AS INT)) END), x -> x IS NOT NULL)"""),
    ).drop("__windows", "__sorted", "__low")
    given = given.withColumn("__places", F.sort_array(F.array_distinct(F.flatten("__pairs")))).drop("__pairs")
    repeated = F.expr("aggregate(__places, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.end, p), 'end', p + 3), a -> a.n)")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return (
        given.withColumn("n_repeat_words", repeated)
        .drop("__places")
        .withColumn("word_chars", F.length(F.translate(text, SPACE, "")).cast("long"))
        .withColumn("n_symbols", _count(text, SYMBOLS).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("__once", F.array_distinct("__lines"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size("__once")).cast("long"))
    )


def clean(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, clean_text, kept_chars and kept."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept_chars", "kept"]
    counted = base_counts(renamed(docs.withColumn("__text", F.col("text").cast("string")), added))
    counted = counted.withColumn("__good", F.filter("__once", lambda x: ~bad_line(x)))
    rest = F.array_join("__good", "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = F.col("word_chars") - F.col("kept_chars")
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("clean_text", F.when(F.col("__text").isNotNull(), rest))
        .withColumn("kept_chars", F.length(F.translate(rest, SPACE, "")).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (100 * lost <= MAX_LOST * F.col("word_chars")))
        .drop("__text", "__lines", "__once", "__good")
    )
