"""Helpers that several corpus operators share: staged tables, distributed ranks, null handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lmdata.session import bit_filter, shipped  # noqa: F401

#: Stands for a null id while ids are compared: sorts after every real one.
NULL_ID = (1 << 63) - 1
#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lmdata-")
        shared_dir.own = named
    return named.rstrip("/")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lmdata-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")


def unboxed(docs: DataFrame) -> list[Column]:
    return [F.col(f"_own.`{c}`").alias(c) for c in docs.columns]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the named keys of two frames."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


#: Bytes of text that one part of a table dealt to parts holds.
PART_BYTES = 16 << 20


def parts_of(text: DataFrame) -> int:
    """In how many parts to deal out a frame of one text column: at least the shuffle's partitions, and none much over PART_BYTES."""
    total = text.agg(F.sum(F.octet_length(text.columns[0]).cast("long"))).first()[0] or 0
    return max(int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)


def part_keys(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` parts, such that a shuffle by it into as many partitions puts one part in each."""
    slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("slot")
    found, tried = {}, 0
    while len(found) < parts:
        rows = spark.range(tried, tried + 16 * parts).select("id", slot).groupBy("slot").agg(F.min("id").alias("id")).collect()  # a row per part
        found = {r["slot"]: r["id"] for r in rows} | found
        tried += 16 * parts
    return [found[i] for i in range(parts)]


def numbered_parts(parts: int | list[int]) -> list[int]:
    return list(range(parts)) if isinstance(parts, int) else list(parts)


#: A key is hot if more rows than this, and than one in MOST_HOT of all, have it: there are at most MOST_HOT such keys.
HOT, MOST_HOT = 64, 10_000


def joined_with(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has a row per key and in n how many of the ``total`` rows have it.

    The rows of hot keys stay where they are and get their entry by broadcast, so that no key's rows meet in one task.
    """
    hot = F.broadcast(table.filter(F.col("n") > max(HOT, total // MOST_HOT)))  # at most MOST_HOT rows
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table, keys))


def with_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column], rank: str, carry: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key from 0 without bringing a whole key into one task.

    ``bucket`` is a column that splits a key; rows come in the order of bucket, then ``order``.  Rows are counted per
    (key, bucket), the counts are prefix-summed within the key, and only a bucket's rows are sorted together.
    ``carry`` holds further columns per key that the small count table takes along.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if carry is not None:
        names = [c for c in carry.columns if c not in keys]
        offsets = offsets.join(carry, same(offsets, carry, keys), "left").select(*[offsets[c] for c in offsets.columns], *[carry[c] for c in names])
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.withColumn("_row", F.row_number().over(within))
    both = [*keys, bucket]
    extra = [offsets[c] for c in offsets.columns if c not in both and c != "_before"]
    return rows.join(offsets, same(rows, offsets, both), "left").select(
        *[rows[c] for c in df.columns], *extra, (offsets["_before"] + rows["_row"] - 1).alias(rank)
    )
