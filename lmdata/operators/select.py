"""Best-of-N selection, preference pairs from samples, and datasets built by joining picks with answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.functions.text import distill_completion, lead_letter, strip
from lmdata.operators.ranks import hash_rank


def exploded(groups: DataFrame) -> DataFrame:
    """Sample groups to a row per sample; its index is its place in the array."""
    return groups.select("question_id", "gold", "prompt", F.posexplode("samples").alias("sample_idx", "s")).select("question_id", "gold", "prompt", "sample_idx", "s.*")


def latest_scores(scores: DataFrame, order: str) -> DataFrame:
    """A score per (question_id, sample_idx): the last one that is not null."""
    return scores.filter("score IS NOT NULL").groupBy("question_id", "sample_idx").agg(F.max_by("score", order).alias("score"))


def scored(samples: DataFrame, scores: DataFrame) -> DataFrame:
    return samples.drop("score").join(scores, ["question_id", "sample_idx"], "left")


def _best(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each question; a question holds the N samples drawn for it."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter("_row = 1").drop("_row")


def _mcq_order() -> list[Column]:
    return [lead_letter(F.col("text")).desc(), F.length("text").asc(), F.col("sample_idx").asc()]


def _teacher_order() -> list[Column]:
    return [F.coalesce("score", F.lit(-1)).desc(), F.col("correct").desc(), *_mcq_order()]


def _with_fallback(samples: DataFrame, best: DataFrame, teacher: DataFrame) -> DataFrame:
    """(question_id, completion, source): the student's pick, else the teacher's answer; a question with neither has no row."""
    asked = samples.select("question_id", "gold").distinct()
    picked = best.select("question_id", F.col("text").alias("_own"))
    given = teacher.select("question_id", F.nullif("teacher_answer", F.lit("")).alias("_given"))
    rows = asked.join(picked, "question_id", "left").join(given, "question_id", "left")
    out = rows.select("question_id", "gold", F.coalesce("_own", "_given").alias("completion"), F.when(F.col("_own").isNotNull(), "student").otherwise("teacher_fallback").alias("source"))
    return out.filter("completion IS NOT NULL")


def rs_mcq(samples: DataFrame, teacher: DataFrame) -> DataFrame:
    return _with_fallback(samples, _best(samples.filter("correct"), _mcq_order()), teacher)


def rs_teacher(samples: DataFrame, teacher: DataFrame) -> DataFrame:
    return _with_fallback(samples, _best(samples.filter("score IS NOT NULL"), _teacher_order()), teacher)


def _both(samples: DataFrame) -> DataFrame:
    of = Window.partitionBy("question_id")
    rows = samples.withColumn("_any", F.max((F.col("score").isNotNull()).cast("int")).over(of)).withColumn("_cs", F.max((F.col("correct") & F.col("score").isNotNull()).cast("int")).over(of))
    pool = rows.filter(F.col("correct") & (F.col("_any") == 1) & ((F.col("_cs") == 0) | F.col("score").isNotNull())).drop("_any", "_cs")
    return _best(pool, _teacher_order())


def rs_both(samples: DataFrame, teacher: DataFrame) -> DataFrame:
    """Among the correct by the teacher's score; needs a correct sample and a scored one in the question."""
    return _with_fallback(samples, _both(samples), teacher)


def onpolicy_pairs(samples: DataFrame) -> DataFrame:
    """(question_id, chosen, rejected, chosen_score, rejected_score, status): pairs, skip_same or skip_nodata per question.

    Chosen as rs_both chooses, else the best scored.  Rejected is the worst scored wrong sample, or the worst scored where none
    is wrong; where wrong ones exist but none has a score there is no data.
    """
    n = samples.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("score").isNotNull().cast("int")).alias("any_scored"), F.max((~F.col("correct")).cast("int")).alias("any_wrong"))
    both = _both(samples).select("question_id", F.col("text").alias("_bt"), F.col("score").alias("_bs"))
    best = _best(samples.filter("score IS NOT NULL"), _teacher_order()).select("question_id", F.col("text").alias("_st"), F.col("score").alias("_ss"))
    worst_first = [F.col("score").asc(), F.col("correct").asc(), lead_letter(F.col("text")).asc(), F.length("text").desc(), F.col("sample_idx").asc()]
    pool = samples.filter("score IS NOT NULL").join(n.select("question_id", "any_wrong"), "question_id").filter((F.col("any_wrong") == 0) | ~F.col("correct"))
    worst = _best(pool, worst_first).select("question_id", F.col("text").alias("rejected"), F.col("score").alias("rejected_score"))
    rows = n.join(both, "question_id", "left").join(best, "question_id", "left").join(worst, "question_id", "left")
    has = F.col("_bt").isNotNull()
    rows = rows.withColumn("chosen", F.when(has, F.col("_bt")).otherwise(F.col("_st"))).withColumn("chosen_score", F.when(has, F.col("_bs")).otherwise(F.col("_ss")))
    status = F.when((F.col("n") < 2) | (F.col("any_scored") == 0) | F.col("rejected").isNull(), "skip_nodata").when(strip(F.col("chosen")) == strip(F.col("rejected")), "skip_same").otherwise("pairs")
    return rows.withColumn("status", status).select("question_id", "chosen", "rejected", "chosen_score", "rejected_score", "status")


def pool_stats(samples: DataFrame) -> DataFrame:
    """One row: samples, sample_acc, coverage (questions with a correct sample), mean_letters (different letters, null one of them)."""
    q = samples.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("c"), (F.count_distinct("letter") + F.max(F.col("letter").isNull().cast("int"))).alias("letters"))
    return q.agg(F.sum("n").alias("samples"), F.round(F.sum("c") / F.sum("n"), 4).alias("sample_acc"), F.round(F.avg((F.col("c") > 0).cast("double")), 4).alias("coverage"), F.round(F.avg("letters"), 4).alias("mean_letters"))


def judge_stats(scores: DataFrame) -> DataFrame:
    """One row per score: its count and share, the mean, the share that was parsed, and whether one score is over 60 %."""
    each = scores.filter("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = scores.agg(F.count(F.lit(1)).alias("all_n"), F.count("score").alias("parsed"), F.round(F.avg("score"), 3).alias("mean_score"))
    rows = each.crossJoin(F.broadcast(total))  # one row
    top = F.max("n").over(Window.partitionBy(F.lit(1)))
    return rows.select("score", "n", F.round(F.col("n") * 100.0 / F.col("parsed"), 2).alias("pct"), "mean_score", F.round(F.col("parsed") / F.col("all_n"), 4).alias("parse_rate"), (top / F.col("parsed") > 0.6).alias("biased"))


def fallback_rate(arm: DataFrame) -> DataFrame:
    return arm.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("source") == "teacher_fallback").cast("double")), 4).alias("fallback_rate"))


def single_answers(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    a = strip(F.col(answer))
    return df.filter((F.col(question) != "") & (F.length(a) == 1) & F.upper(a).isin(*"ABCDE")).withColumn(answer, F.upper(a))


def distilled(picked: DataFrame, teacher: DataFrame) -> DataFrame:
    """Picks with a teacher's answer, as completions that begin with a letter."""
    given = teacher.select("question_id", F.nullif("teacher_answer", F.lit("")).alias("_t")).filter("_t IS NOT NULL")
    return picked.join(given, "question_id").withColumn("_d", distill_completion(F.col("_t"), F.col("answer"))).select("question_id", F.col("answer").alias("gold"), "_d.*")


def mixed_sources(picked: DataFrame, teacher: DataFrame, seed: int = 42) -> DataFrame:
    """Half of the questions take the teacher's completion, by a seeded shuffle; a missing one gives way to the real one."""
    rows = hash_rank(picked, F.col("question_id"), seed, "rank").crossJoin(F.broadcast(picked.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    d = distilled(picked, teacher).select(F.col("question_id").alias("_q"), F.col("completion").alias("_c"))
    rows = rows.join(d, F.col("question_id") == F.col("_q"), "left")
    use = (F.col("rank") <= F.floor(F.col("_n") / 2)) & F.col("_c").isNotNull()
    return rows.select("question_id", F.when(use, F.col("_c")).otherwise(F.col("answer")).alias("completion"), F.when(use, "distill").otherwise("real").alias("origin"))


def todo(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do: rows whose keys have no result yet."""
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")


def with_logits(sft: DataFrame, logits: DataFrame, max_length: int) -> DataFrame:
    """Training rows with their teacher's logits where the prompt lengths agree, cut from the right; without room for a completion none."""
    rows = sft.join(logits.select("question_id", "prompt_len", "positions"), "question_id").filter(F.size("prompt_ids") == F.col("prompt_len"))
    room = F.least(F.size("completion_ids"), F.size("positions"), F.lit(max_length) - F.col("prompt_len"))
    return rows.withColumn("_room", room).filter("_room > 0").withColumn("completion_ids", F.slice("completion_ids", F.lit(1), F.col("_room"))).withColumn("positions", F.slice("positions", F.lit(1), F.col("_room"))).drop("_room")
