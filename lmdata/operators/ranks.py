"""Ranks and prefix sums over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def ordered_sum(df: DataFrame, order: str, value: Column, name: str, keys: list[str] | None = None, width: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one, by ``order`` (a whole number), per key.

    Rows are summed per block of ``width`` orders, the blocks' sums are added up, and each block's rows by themselves.  A null order
    comes last.
    """
    keys = keys or []
    rows = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / width))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(blocks, same).withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)


def hash_rank(df: DataFrame, key: Column, seed: int | str, name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """Adds a rank from 1 by md5(seed:key): a seeded shuffle that every engine gives alike.

    The first hexadecimal digits say which bucket a row is in; buckets are counted, and only a bucket's rows sorted together.
    """
    keys = keys or []
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).withColumn("_b", F.substring("_h", 1, 2))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h")))
    same = F.col("_b") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(counts) if not keys else counts, same).withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)
