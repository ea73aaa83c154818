"""Corpus cleaning: boilerplate, length, exact and near copies, with what each step dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.functions.text import strip
from lmdata.operators import dedup


@dataclass(frozen=True)
class Domain:
    min_length: int = 100
    max_length: int = 50_000
    threshold: float = 0.8


# Settings by domain; an unknown one takes the first.
DOMAINS = {"medical": Domain(100, 50_000, 0.8), "finance": Domain(120, 50_000, 0.85), "general": Domain(80, 50_000, 0.8)}
LEAST_AFTER_BOILERPLATE = 50


def domain(name: str) -> Domain:
    return DOMAINS.get(name, DOMAINS["medical"])


def without_markup(c: Column) -> Column:
    plain = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c)
    return strip(F.when(F.contains(plain, F.lit("\n\n\n")), F.regexp_replace(plain, "\n{3,}", "\n\n")).otherwise(plain))


def remove_boilerplate(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, without_markup(F.col(text))).filter(F.length(text) > LEAST_AFTER_BOILERPLATE)


def length_filter(df: DataFrame, low: int = 100, high: int = 50_000, text: str = "text") -> DataFrame:
    return df.filter(F.length(text).between(low, high))


def clean(df: DataFrame, config: Domain = DOMAINS["medical"], near: str | None = "lsh") -> tuple[DataFrame, dict[str, DataFrame]]:
    """What is left of (seq, text) after all steps, and what was left after each."""
    steps = {"input": df, "boilerplate": remove_boilerplate(df)}
    steps["length"] = length_filter(steps["boilerplate"], config.min_length, config.max_length)
    steps["exact_dedup"] = dedup.exact_text(steps["length"])
    if near:
        steps["near_dedup"] = dedup.near_dedup(steps["exact_dedup"], config.threshold, near)
    return list(steps.values())[-1], steps


def report(steps: dict[str, DataFrame]) -> DataFrame:
    """One row: input, output, drop_rate, breakdown (rows dropped by step)."""
    names = list(steps)
    counted = None
    for i, n in enumerate(names):
        one = steps[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), F.lit(n).alias("step"), "n")
        counted = one if counted is None else counted.unionByName(one)
    row = counted.agg(F.array_sort(F.collect_list(F.struct("i", "step", "n"))).alias("s")).select(F.transform("s", lambda x: x["n"]).alias("n"))
    first, last = F.get("n", F.lit(0)), F.element_at("n", -1)
    lost = F.map_from_arrays(F.array(*[F.lit(n) for n in names[1:]]), F.transform(F.sequence(F.lit(1), F.lit(len(names) - 1)), lambda i: F.get("n", i - 1) - F.get("n", i)))
    return row.select(first.alias("input"), last.alias("output"), F.round((first - last) / F.greatest(first, F.lit(1)), 3).alias("drop_rate"), lost.alias("breakdown"))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Extension: how many of the keywords a text holds."""
    return sum((F.lower(text).contains(k.lower()).cast("int") for k in keywords), F.lit(0))
