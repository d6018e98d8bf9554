"""Words, lines and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Maximal runs of other characters than blank, tab, line feed and carriage return; null gives null."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines of a text. One closing line feed ends the last line and does not begin another."""
    return F.split(F.regexp_replace(text, "\\n\\z", ""), "\\n")


def word_ngrams(words_col: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by a blank; fewer words give the whole sequence, none gives no n-gram."""
    size = F.size(words_col)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words_col, i, n), " "))
    return F.when(size >= 1, many).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decoded(payload: Column) -> Column:
    """Bytes as UTF-8, each bad sequence replaced by U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


def decoded_ignoring(payload: Column) -> Column:
    """Bytes as UTF-8 without the bad sequences."""
    return F.replace(decoded(payload), F.lit("\ufffd"), F.lit(""))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, whatever the optimiser does with later predicates.

    Predicates, also inferred ones such as not-null on a join key, are pushed below projections by repeating the projected
    expression; inside a lambda function that means once per element. A generator's output cannot be repeated so.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))
