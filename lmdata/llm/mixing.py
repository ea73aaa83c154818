"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is due ``target / source size`` copies.  The copies are prefix-summed in the source's
order, one random offset per source is added, and a document is emitted once for each integer its interval crosses.
Documents are ordered by size class, so that the words taken stay close to the target whatever the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.llm.common import WORD, boxed, documents, staged, unboxed, with_rank

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Documents of a source are counted by size class, this many words wide, and by piece of a class, so that no sort holds a whole hot source.
SIZE_STEP, PIECES = 16, 8


def words(text: Column) -> Column:
    """Number of runs of characters that are not white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], total_share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total by weight, capped, the excess shared again.

    Sharing the excess until no source is above its cap gives every source min(cap, level * weight) for one level, found
    here from the sources in the order of cap / weight.  One row per source: the windows hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    line = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    done, rest, everything = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(total_share)
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(line))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has target
    0 and no copies; a null doc_id is a document like any other; repeated rows are sampled one by one; an empty table
    gives an empty result; columns other than doc_id, text and source are not read.
    """
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    sized = sized.withColumn("_place", F.floor(F.col("size") / SIZE_STEP) * PIECES + F.coalesce(F.pmod(F.col("doc_id"), F.lit(PIECES)), F.lit(0)))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, max_repeats)
    ranked = with_rank(sized, ["source"], "_place", [F.col("size"), F.col("doc_id").asc_nulls_last()], "_rank", carry=goals)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = F.floor(F.col("_due") * (F.col("_rank") + 1) + F.col("_offset")) - F.floor(F.col("_due") * F.col("_rank") + F.col("_offset"))
    out = ranked.withColumn("_due", due).withColumn("_offset", offset).withColumn("copies", F.least(crossed, F.ceil("_due")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it.

    Defined cases: those of ``mix``; rows that tie in doc_id, source and size share their copies in turn, by text; documents
    without words are taken like others of their source, or not at all if it has none; all columns pass through, whatever their names.
    """
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", "rows")
    own = docs.select(boxed(docs), words(F.col("text")).alias("_words"))
    due = own["_own.doc_id"].eqNullSafe(taken["_id"]) & own["_own.source"].eqNullSafe(taken["_source"]) & (own["_words"] == taken["_size"])
    one = F.lit(1).cast("long")
    turn = F.when(F.col("rows") == 1, one).otherwise(F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_own.text")))
    joined = own.join(taken, due).withColumn("_turn", turn)
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("_turn") <= F.col("copies") % F.col("rows")).cast("long")
    return joined.withColumn("_times", times).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(one, F.col("_times")))).select(*unboxed(docs))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (source_size * 2)::DOUBLE AS cap FROM sources),
line AS (SELECT *, cap / weight AS full_at, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighted),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5
             - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM line),
goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= full_at) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT *, (size // 16) * 8 + coalesce(doc_id % 8, 0) AS place FROM sized),
ranked AS (
  SELECT p.doc_id, p.source, p.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS due,
         (('0x' || substr(md5('mix:' || coalesce(p.source, '')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 AS off,
         row_number() OVER (PARTITION BY p.source ORDER BY p.place, p.size, p.doc_id NULLS LAST) - 1 AS rk
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (least(floor(due * (rk + 1) + off) - floor(due * rk + off), ceil(due)) * size)::BIGINT AS taken
FROM ranked
"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
