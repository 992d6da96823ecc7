"""Quality rules, line first: failing lines are removed, then documents that lost too much text are rejected.

Only DataFrame functions, and no shuffle: everything about a document is computed from its own row, so neither a hot
source nor groups of copies matter. Work per document is n log n in its words, and only where five-word windows repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import text_of, words_of

# Phrases by which a line counts as boilerplate, matched ignoring case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "we use cookies",
    "accept cookies", "enable javascript", "lorem ipsum", "click here to", "read more", "sign up for", "log in to",
    "subscribe to our", "share this", "follow us on", "powered by", "back to top", "skip to content",
)
SYMBOLS = "[#*$%&|<>]"
ENDING = r"""[.!?:;…。！？؟।]["'”’»)\]]*[ \t-\r]*$"""

MIN_WORDS = 10           # fewer words fail the base rules
MAX_REPEATED = 20        # percent of words inside repeated five-word windows
WINDOW = 5               # words in a window
NOTICE_WORDS = 20        # only lines of at most so many words count as boilerplate
FRAGMENT_WORDS = 4       # a line of fewer words without sentence end is a fragment
BAR_SHARE = 3            # a line with one separator bar to this many words, or more bars, is navigation
SHOUT_SHARE = 2          # a line with one doubled exclamation mark to this many words, or more, is shouting
SYMBOL_SHARE = 2         # a line with one symbol to this many words, or more, is noise
MAX_LOST = 50            # percent of word characters a document may lose with its lines


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated_words(words: Column, window: int) -> tuple[Column, ...]:
    """Stages of the count of words inside windows that occur twice or more in the list."""
    hashes = F.when(F.size(words) >= window, F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda at: F.xxhash64(*[F.get(words, at + i) for i in range(window)])))
    known = F.col("_windows")
    ordered = F.when(F.size(F.array_distinct(known)) < F.size(known), F.sort_array(
        F.transform(known, lambda h, at: F.struct(h.alias("h"), at.alias("at")))))
    rows = F.col("_ordered")
    places = F.sort_array(F.transform(
        F.filter(rows, lambda row, at: (F.get(rows, at - 1)["h"] == row["h"]) | (F.get(rows, at + 1)["h"] == row["h"])),
        lambda row: row["at"]))
    found = F.col("_places")
    steps = F.transform(found, lambda at, i: F.least(F.lit(window), F.coalesce(
        F.get(found, i + 1) - at, F.lit(window))))
    return hashes, ordered, places, F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))


def line_verdict(line: Column, lowered: Column, words: Column) -> Column:
    """Why a line of ``words`` words goes: ``boilerplate``, ``navigation``, ``punctuation``; null if it stays."""
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    symbols = _without(line, "[#*$%&<>]")
    notice = reduce(lambda a, b: a | b, [lowered.contains(phrase) for phrase in BOILERPLATE])
    return (F.when(words == 0, F.lit(None))
            .when((words <= NOTICE_WORDS) & notice, "boilerplate")
            .when(line.contains("|") & (bars * BAR_SHARE >= words - bars), "navigation")
            .when(line.contains("!!") & (shouts * SHOUT_SHARE >= words), "punctuation")
            .when(symbols * SYMBOL_SHARE >= words, "punctuation")
            .when((words < FRAGMENT_WORDS) & ~line.rlike(ENDING), "punctuation"))


def quality_rules(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """All rows and columns of ``docs`` with the counts, the cleaned text and the verdict.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``clean_text`` (lines
    that stay, joined by newlines), ``n_lines_removed, lost_chars`` (long) and ``kept``. A document is rejected if the
    base rules fail or removed lines hold more than ``max_lost`` percent of its word characters.

    A null text counts as empty: no words, ``base_failed``. Columns of these names in ``docs`` are replaced. Rows are
    judged one by one: repeated rows give repeated results, an empty table an empty result. Windows of five words are
    compared by 64-bit hashes within one document.
    """
    value = text_of(text)
    words, lines, judged = F.col("_words"), F.col("_lines"), F.col("_judged")
    hashes, ordered, places, repeated = _repeated_words(words, WINDOW)
    gone = F.filter(judged, lambda x: x["why"].isNotNull())
    chars = lambda t: F.length(F.array_join(words_of(t), ""))
    n_words = F.col("n_words")
    out = (docs.withColumn("_words", words_of(value))
           .withColumn("n_words", F.size(words).cast("long"))
           .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
           .withColumn("_windows", hashes)
           .withColumn("_ordered", ordered)
           .withColumn("_places", places)
           .withColumn("n_repeat_words", repeated.cast("long"))
           .drop("_words", "_windows", "_ordered", "_places")
           .withColumn("n_symbols", _without(value, SYMBOLS).cast("long"))
           .withColumn("_counted", F.transform(F.split(value, "\n"), lambda x: F.struct(
               x.alias("line"), F.lower(x).alias("lowered"), F.size(words_of(x)).alias("words"))))
           .withColumn("_judged", F.transform(F.col("_counted"), lambda x: F.struct(
               x["line"].alias("line"), x["words"].alias("words"),
               line_verdict(x["line"], x["lowered"], x["words"]).alias("why"))))
           .withColumn("_lines", F.transform(F.filter(judged, lambda x: x["words"] > 0), lambda x: x["line"]))
           .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
           .withColumn("clean_text", F.array_join(F.transform(
               F.filter(judged, lambda x: x["why"].isNull()), lambda x: x["line"]), "\n"))
           .withColumn("n_lines_removed", F.size(gone).cast("long"))
           .withColumn("lost_chars", F.aggregate(gone, F.lit(0), lambda a, x: a + chars(x["line"])).cast("long"))
           .drop("_lines", "_counted", "_judged"))
    return (out.withColumn("base_failed", (n_words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n_words))
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars"))))
