"""Writers: completeness is the writer's own mark, never that a file is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.functions.text import collapse
from lmdata.sources.readers import exists


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_lines(df: DataFrame, path: str, text: str = "text", mode: str = "errorifexists") -> None:
    """One row per line: white space is collapsed, so that no text breaks its line."""
    df.select(collapse(F.col(text)).alias("value")).write.mode(mode).text(path)


def write_chunks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks by ratio."""
    df.write.mode(mode).partitionBy("ratio").parquet(path)


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").json(path)


def write_log(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Fixed columns; missing ones and nulls are blank, others are left out."""
    fixed = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*fixed).write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON documents, for reports of a row or a few."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(mode).text(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the table doesn't hold yet, and returns them: a run that broke off goes on where it was."""
    spark = df.sparkSession
    new = df
    if exists(spark, path):
        new = df.join(spark.read.schema(df.schema).parquet(path).select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def complete(spark, path: str) -> bool:
    """Whether a writer finished there."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def write_once(df: DataFrame, path: str) -> bool:
    """Writes unless a finished table is there; says whether it did."""
    if complete(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def preview(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    return df.orderBy(order).limit(n)


def markdown(df: DataFrame, most: int = 50) -> str:
    """A table of a few rows as Markdown; null is a dash."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["—" if v is None else str(v) for v in r]) for r in rows)])
