"""Text columns: whitespace, boilerplate, snippets. All of it stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.settings import SNIPPET_CHARS

# Fixed value: every character that counts as whitespace in text handling.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

# Boilerplate runs, deleted in this order, then one leading menu word.
BOILERPLATE = (
    "(?iu)Cookie +Policy.*?Accept",
    "(?iu)Privacy +Policy.*?Terms",
    "(?iu)Subscribe +to.*?Newsletter",
)
# Lower-case pieces every such run contains; the long s, an s to the patterns, is folded before they are looked for.
BOILERPLATE_SIGNS = (("cook", "accept"), ("vacy", "term"), ("ubscr", "letter"))
MENU_WORD = "(?iu)^(Home|About|Contact|Menu|Navigation)( |$)"


def strip_ws(col: Column) -> Column:
    """Strip every kind of whitespace; ``trim`` alone would only know U+0020."""
    return F.btrim(col, F.lit(WHITESPACE))


def clean_text(col: Column) -> Column:
    """Collapse whitespace, delete boilerplate, strip last.

    Texts without a sign of any boilerplate skip the three searches: nothing is deleted, so nothing can appear.
    The strip comes last on purpose: a text that begins with whitespace keeps its menu word.
    """
    collapsed = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    lowered = F.replace(F.lower(collapsed), F.lit("\u017f"), F.lit("s"))
    suspect, out = F.lit(False), collapsed
    for (first, last), pattern in zip(BOILERPLATE_SIGNS, BOILERPLATE):
        suspect = suspect | (F.contains(lowered, F.lit(first)) & F.contains(lowered, F.lit(last)))
        out = F.regexp_replace(out, pattern, "")
    out = F.when(suspect, out).otherwise(collapsed)
    return F.trim(F.regexp_replace(out, MENU_WORD, ""))


def snippet(col: Column, n: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def first_phrase(text: Column, phrases) -> Column:
    """First of ``phrases`` (in list order) contained in ``text``, else null."""
    out = F.lit(None).cast("string")
    for phrase in reversed(tuple(phrases)):
        out = F.when(F.contains(text, F.lit(phrase)), F.lit(phrase)).otherwise(out)
    return out


def contains_any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out
