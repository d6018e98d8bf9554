"""Rule-based quality metrics and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN, MAX_MEAN = 3, 10
MAX_ELLIPSIS, MIN_ALPHA = 0.3, 0.8
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")


_WORD = "[^ \\t\\n\\r]+"
#: A word with a letter in it, taken whole; nothing is tried twice.
_ALPHA = "[^ \\t\\n\\r\\p{L}]*+\\p{L}[^ \\t\\n\\r]*+"


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus n_words, mean_word_length, ellipsis_share, alpha_share, stop_words, symbol_ratio, bullet_share, keep.

    Counts are regular expressions over the whole text, which run compiled; no word becomes a value of its own. Null and empty
    texts have no words: means and shares are 0 and ``keep`` is false. The last three metrics do not enter the verdict.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    many = lambda pattern: F.regexp_count(t, F.lit(pattern))
    count = {
        "_n": many(_WORD),
        "_m": F.when(t == "", 1).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(t.endswith("\n"), 0).otherwise(1)),
        "_c": F.length(F.translate(t, " \t\n\r", "")),
        "_e": many("(?:[.]{3}|\u2026)[ \\t\\r]*+(?=\\n|\\z)"),
        "_a": many(_ALPHA),
        "_y": many("#|[.]{3}|\u2026"),
        "_b": many("(?<![^\\n])[ \\t]*+[-*\u2022]"),
        "_s": sum(F.lower(t).rlike(f"(?<![^ \\t\\n\\r]){w}(?![^ \\t\\n\\r])").cast("int") for w in STOP_WORDS),
    }
    base = df.select("*", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in count.items()]))).alias("_q"))
    n, m = F.col("_q._n"), F.col("_q._m")
    share = lambda hits, of: F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(0.0))
    counted = base.withColumns(
        {
            "n_words": n.cast("long"),
            "mean_word_length": share(F.col("_q._c"), n),
            "ellipsis_share": share(F.col("_q._e"), m),
            "alpha_share": share(F.col("_q._a"), n),
            "stop_words": F.col("_q._s").cast("long"),
            "symbol_ratio": share(F.col("_q._y"), n),
            "bullet_share": share(F.col("_q._b"), m),
        }
    )
    return counted.drop("_q").withColumn("keep", verdict())


def verdict() -> Column:
    """All bounds are inclusive."""
    return (
        F.col("n_words").between(MIN_WORDS, MAX_WORDS)
        & F.col("mean_word_length").between(MIN_MEAN, MAX_MEAN)
        & (F.col("ellipsis_share") <= MAX_ELLIPSIS)
        & (F.col("alpha_share") >= MIN_ALPHA)
    )
