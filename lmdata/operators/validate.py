"""Extension: what a corpus, a training set or a set of preference pairs looks like, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.functions.text import WS
from lmdata.operators import chat, prefs
from lmdata.operators.tokens import byte_count


def corpus(df: DataFrame) -> DataFrame:
    """Documents, tokens, and the share of lines that are blank."""
    lines = F.split("text", "\n")
    blank = F.size(F.filter(lines, lambda x: ~F.regexp_like(F.regexp_replace(x, WS, ""), F.lit("."))))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(byte_count(F.col("text"))).alias("n_tokens"), F.round(F.sum(blank) / F.sum(F.size(lines)), 6).alias("blank_line_rate"))


def conversations(df: DataFrame) -> DataFrame:
    """(messages): conversations, how many are well formed and usable, and turns by role."""
    m = F.col("messages")
    of = lambda r: F.sum(F.size(F.filter(m, lambda x: x["role"] == r)))
    ok = chat.well_formed(m)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("well_formed"), F.sum((ok & chat.sft_reason(m).isNull()).cast("int")).alias("usable"), *[of(r).alias(r) for r in chat.ROLES])


def pairs(df: DataFrame) -> DataFrame:
    """Pairs, how many stay, and how many are far apart in length."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(prefs.drop_reason().isNull().cast("int")).alias("complete"), F.sum(prefs.bias_share().cast("int")).alias("biased"))


def ngram_overlap(new: DataFrame, real: DataFrame, n: int = 3) -> DataFrame:
    """How many different word n-grams the new texts have, and the share of them that the real ones have too."""
    words = F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != "")
    grams = lambda df: df.select(words.alias("w")).filter(F.size("w") >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("g")).distinct()
    a, b = grams(new), grams(real).select(F.col("g").alias("_g"))
    return a.join(b, F.col("g") == F.col("_g"), "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("_g").isNotNull().cast("double")), 6).alias("shared"))
