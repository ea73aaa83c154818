"""Preference pairs: filtering by the first reason that applies, noise, and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.functions.text import strip
from lmdata.operators.ranks import hash_rank
from lmdata.operators.tokens import byte_count

SIDES = ("prompt", "chosen", "rejected")
LEAST, MOST, BIAS = 10, 20_000, 0.5


def drop_reason() -> Column:
    """Why a pair goes, the first reason that applies; null where it stays.  Lengths are those before stripping."""
    missing = F.col("prompt").isNull() | F.col("chosen").isNull() | F.col("rejected").isNull()
    blank = (strip(F.col("prompt")) == "") | (strip(F.col("chosen")) == "") | (strip(F.col("rejected")) == "")
    short = F.least(*[F.length(s) for s in SIDES]) < LEAST
    long = F.greatest(*[F.length(s) for s in SIDES]) > MOST
    return F.when(missing, "missing_fields").when(blank, "empty_field").when(strip(F.col("chosen")) == strip(F.col("rejected")), "chosen_eq_rejected").when(short, "too_short").when(long, "too_long")


def filter_pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("_reason", drop_reason()).filter("_reason IS NULL").drop("_reason")


def reasons(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(drop_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, values: dict[str, Column], places: int = 2) -> DataFrame:
    """One row (metric, n, mean, median, stdev, min, max, p95, p99) per value; percentiles are exact and interpolated."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("x")) for k, v in values.items()])).alias("r")).select("r.*").filter("x IS NOT NULL")
    r = lambda c: F.round(c, places)
    return long.groupBy("metric").agg(
        F.count("x").alias("n"), r(F.avg("x")).alias("mean"), r(F.percentile("x", 0.5)).alias("median"), r(F.coalesce(F.stddev_samp("x"), F.lit(0.0))).alias("stdev"),
        r(F.min("x")).alias("min"), r(F.max("x")).alias("max"), r(F.percentile("x", 0.95)).alias("p95"), r(F.percentile("x", 0.99)).alias("p99"),
    )


def length_values() -> dict[str, Column]:
    return {s: F.length(s) for s in SIDES} | {"chosen_minus_rejected": F.length("chosen") - F.length("rejected")}


def bias_share(threshold: float = BIAS) -> Column:
    lc, lr = F.length("chosen"), F.length("rejected")
    return F.abs(lc - lr) / F.greatest(lc, lr, F.lit(1)) > threshold


def length_bias(df: DataFrame) -> DataFrame:
    pct = lambda c: F.round(F.avg(c.cast("double")) * 100, 2)
    return df.agg(pct(F.length("chosen") > F.length("rejected")).alias("chosen_longer_pct"), pct(bias_share()).alias("length_bias_pct"))


def token_values() -> dict[str, Column]:
    p = byte_count(F.col("prompt"))
    return {"prompt": p, "prompt_chosen": p + byte_count(F.col("chosen")), "prompt_rejected": p + byte_count(F.col("rejected"))}


def coverage(df: DataFrame, limits: tuple[int, ...] = (1024, 2048, 4096)) -> DataFrame:
    n = token_values()["prompt_chosen"]
    return df.agg(*[F.round(F.avg((n <= m).cast("double")) * 100, 2).alias(f"coverage_{m}") for m in limits])


def length_ratio_ok() -> Column:
    """Extension: the share is of the chosen length alone."""
    lc, lr = F.length("chosen"), F.length("rejected")
    return F.abs(lc - lr) / F.greatest(lc, F.lit(1)) <= 0.5


def inject_noise(df: DataFrame, share: float, seed: int, key: str = "pair_id") -> DataFrame:
    """Swaps chosen and rejected in exactly round(n * share) rows by a seeded shuffle; adds flipped."""
    total = df.agg(F.bround(F.count(F.lit(1)) * F.lit(share), 0).alias("_m"))
    rows = hash_rank(df, F.col(key), seed, "_rank").crossJoin(F.broadcast(total))  # one row
    flip = F.col("_rank") <= F.col("_m")
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    return rows.select(*rest, F.when(flip, F.col("rejected")).otherwise(F.col("chosen")).alias("chosen"), F.when(flip, F.col("chosen")).otherwise(F.col("rejected")).alias("rejected"), flip.alias("flipped"))
