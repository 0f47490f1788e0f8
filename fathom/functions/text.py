"""Text expressions: pure columns, null in, null out unless said otherwise.

White space is Unicode white space throughout (``(?U)\\s``), as trimming with Spark's
``trim`` takes only plain blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def utrim(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_newlines(x: Column) -> Column:
    """Without byte order mark; line ends are LF."""
    return F.replace(F.replace(F.replace(x, F.lit("\ufeff"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_blank_lines(x: Column) -> Column:
    """LF line ends, at most one blank line in a row, trimmed."""
    lf = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return utrim(F.regexp_replace(lf, "\n{3,}", "\n\n"))


def collapse_space(x: Column) -> Column:
    """Every run of white space as one blank, trimmed."""
    return utrim(F.regexp_replace(x, WHITE, " "))


def empty_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def lines(x: Column) -> Column:
    """Cleaned lines: white space collapsed, blank lines and pure rule lines (``-``, ``=``, ``_``) dropped; null gives none."""
    split = F.split(F.coalesce(normalize_newlines(x), F.lit("")), "\n")
    return F.filter(F.transform(split, collapse_space), lambda line: (line != "") & ~line.rlike(r"^[-=_ ]+$"))


def unique(items: Column) -> Column:
    """Distinct canonical forms in the order of their first occurrence; blanks are dropped."""
    return F.array_distinct(F.filter(F.transform(items, collapse_space), lambda x: x != ""))


def terms(query: Column) -> Column:
    """Lower-cased search terms, split at white space and ``, ; ， ；``; repeated terms stay."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)[\s,，;；]+"), lambda t: t != "")


def contained(text: Column, words: list[str]) -> Column:
    """Those of the words, in their order, that the text contains."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words; an empty word is in every text, null contains nothing."""
    if not words:
        return F.lit(False)
    return F.coalesce(text.rlike("|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in words)), F.lit(False))


def split_questions(question: Column, separators: list[str]) -> Column:
    """Parts of a question at the separators, trimmed, unique, in order; null gives none."""
    pattern = "|".join(re.escape(s) for s in sorted(separators, key=len, reverse=True))
    return unique(F.split(F.coalesce(question, F.lit("")), pattern))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def section(text: Column, titles: list[str], stops: list[str]) -> Column:
    """The slice from the first title found anywhere to the first occurrence of a stop after its begin.

    A stop counts by its first occurrence within the slice only, and not at its very begin.
    Includes the title, trimmed; empty where no title occurs.
    """

    def cut(rest: Column) -> Column:
        ends = F.array_min(F.filter(F.array(*[F.locate(x, rest) for x in stops] or [F.lit(0)]), lambda p: p > 1))
        return utrim(let(ends, lambda end: F.when(end.isNull(), rest).otherwise(F.substring(rest, F.lit(1), end - 1))))

    def begin(body: Column) -> Column:
        start = F.array_min(F.filter(F.array(*[F.locate(t, body) for t in titles]), lambda p: p > 0))
        return let(start, lambda s: F.when(s.isNull(), "").otherwise(let(F.substring(body, s, F.length(body)), cut)))

    return let(F.coalesce(normalize_newlines(text), F.lit("")), begin)


def until(text: Column, stops: list[str]) -> Column:
    """(text, closed): the text up to the first of the stops, and whether there is one."""
    ends = F.array_min(F.filter(F.array(*[F.locate(x, text) for x in stops] or [F.lit(0)]), lambda p: p > 0))
    return let(ends, lambda end: F.struct(F.when(end.isNull(), text).otherwise(F.substring(text, F.lit(1), end - 1)).alias("text"), end.isNotNull().alias("closed")))


def closed(text: Column, titles: list[str], stops: list[str]) -> Column:
    """Whether a stop ends the ``section`` within the text; null where no title occurs."""

    def begin(body: Column) -> Column:
        start = F.array_min(F.filter(F.array(*[F.locate(t, body) for t in titles]), lambda p: p > 0))
        rest = lambda s: let(F.substring(body, s, F.length(body)), lambda r: F.exists(F.array(*[F.locate(x, r) for x in stops] or [F.lit(0)]), lambda p: p > 1))
        return let(start, lambda s: F.when(s.isNotNull(), rest(s)))

    return let(F.coalesce(normalize_newlines(text), F.lit("")), begin)


def head(x: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(x, F.lit(n))


def tail(x: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(x, F.lit(n))


def ascii_digits(x: Column) -> Column:
    """Full-width digits as plain ones."""
    return F.translate(x, "０１２３４５６７８９", "0123456789")
