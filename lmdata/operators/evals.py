"""Evaluation: rewards, accuracy, win rates, gain and forgetting, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.functions.text import extract_answer, strip

# The task groups.
TASK_GROUPS = {
    "medical_cn": ["cmmlu_anatomy", "cmmlu_clinical_knowledge", "cmmlu_college_medicine", "cmmlu_professional_medicine", "cmmlu_genetics", "cmmlu_traditional_chinese_medicine", "cmmlu_virology", "cmmlu_nutrition"],
    "general_cn": ["cmmlu_world_history", "cmmlu_high_school_physics", "cmmlu_economics", "cmmlu_marxist_theory"],
    "medical_en": ["mmlu_anatomy", "mmlu_clinical_knowledge", "mmlu_college_medicine", "mmlu_medical_genetics", "mmlu_professional_medicine"],
}
BUCKETS = ("matched", "mid", "skewed")


def accuracy_reward(text: Column, gold: Column) -> Column:
    """1 where the parsed letter is the gold answer's first; no gold answer is never right."""
    first = F.substring(F.upper(strip(F.coalesce(gold, F.lit("")))), 1, 1)
    return F.coalesce((extract_answer(text) == F.nullif(first, F.lit(""))).cast("double"), F.lit(0.0))


def format_reward(text: Column) -> Column:
    n = F.length(text)
    return F.when((n > 20) & (n < 500), 0.5).otherwise(0.0) + F.when(extract_answer(text).isNotNull(), 0.5).otherwise(0.0)


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    hit = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.round(F.avg(hit), 4).alias("accuracy"), F.sum(F.col(pred).isNull().cast("int")).alias("unparseable"), F.round(F.avg(F.col(pred).isNull().cast("int")), 4).alias("unparseable_rate"))


def running_accuracy(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """Adds acc: the share of hits so far, in order, by prefix sums over blocks."""
    from lmdata.operators.ranks import ordered_sum

    rows = ordered_sum(ordered_sum(df, order, hit.cast("int"), "_h"), order, F.lit(1), "_n")
    return rows.withColumn("acc", (F.col("_h") + hit.cast("int")) / (F.col("_n") + 1)).drop("_h", "_n")


def length_bucket(share: Column) -> Column:
    return F.when(share < 0.2, "matched").when(share < 0.5, "mid").otherwise("skewed")


def win_rates(df: DataFrame) -> DataFrame:
    """(chosen_sum, chosen_n, rejected_sum, rejected_n) to a row per bucket and one for all: n, sum_wr, mean_wr, null without pairs."""
    rows = df.filter("chosen_n > 0 AND rejected_n > 0")
    share = F.abs(F.col("chosen_n") - F.col("rejected_n")) / F.greatest("chosen_n", "rejected_n")
    rows = rows.select(length_bucket(share).alias("bucket"), (F.col("chosen_sum") > F.col("rejected_sum")).cast("double").alias("s"), (F.col("chosen_sum") / F.col("chosen_n") > F.col("rejected_sum") / F.col("rejected_n")).cast("double").alias("m"))
    rows = rows.select(F.explode(F.array(F.lit("all"), F.col("bucket"))).alias("bucket"), "s", "m")
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 3).alias("sum_wr"), F.round(F.avg("m"), 3).alias("mean_wr"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("all", *BUCKETS)])).alias("bucket"))
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "sum_wr", "mean_wr")


def group_means(scores: DataFrame) -> DataFrame:
    """(model, task_group, task, acc) to a mean per model and group."""
    return scores.groupBy("model", "task_group").agg(F.round(F.avg("acc"), 4).alias("mean_acc"))


def deltas(means: DataFrame, base: str) -> DataFrame:
    """Means less the base model's, both already rounded."""
    b = means.filter(F.col("model") == base).select("task_group", F.col("mean_acc").alias("base_acc"))
    return means.filter(F.col("model") != base).join(b, "task_group").withColumn("delta", F.round(F.col("mean_acc") - F.col("base_acc"), 4))


def gains(scores: DataFrame, base: str, model: str) -> DataFrame:
    """Per task of both models: absolute and relative gain, forgetting, and whether it improved."""
    b = scores.filter(F.col("model") == base).select("task", "task_group", F.col("acc").alias("base"))
    m = scores.filter(F.col("model") == model).select("task", F.col("acc").alias("tuned"))
    gain = F.col("tuned") - F.col("base")
    return b.join(m, "task").select(
        "task", "task_group", "base", "tuned", F.round(gain, 6).alias("abs_gain"), F.round(F.when(F.col("base") > 0, gain / F.col("base")).otherwise(0.0), 6).alias("rel_gain"),
        F.round(F.when(F.col("base") > 0, -gain / F.col("base")).otherwise(0.0), 6).alias("forgetting"), F.when(gain > 0, "up").otherwise("down").alias("direction"),
    )


def gain_and_forgetting(scores: DataFrame, base: str, model: str) -> DataFrame:
    g = gains(scores, base, model)
    return g.agg(F.round(F.avg(F.when(F.col("task_group") == "domain", F.col("abs_gain"))), 5).alias("domain_gain"), F.round(F.avg(F.when(F.col("task_group") == "general", F.col("forgetting"))), 5).alias("forgetting"))


def debiased(df: DataFrame) -> DataFrame:
    """Adds winner: the first verdict where the second, with sides swapped, agrees; else a tie."""
    back = F.when(F.col("second_verdict") == "A", "B").when(F.col("second_verdict") == "B", "A").otherwise("tie")
    return df.withColumn("winner", F.when(F.col("first_verdict") == back, F.col("first_verdict")).otherwise("tie"))


def kappa(df: DataFrame, a: str = "r1", b: str = "r2") -> DataFrame:
    """Extension: Cohen's kappa of two raters, from the confusion matrix."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "v").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("c", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def advantages(df: DataFrame, group: str = "question_id", reward: str = "reward", scale: str = "group") -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the deviation of the group, of all, or of nothing."""
    of = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(of)
    if scale == "none":
        return df.withColumn("advantage", centred)
    if scale == "group":
        return df.withColumn("advantage", centred / (F.coalesce(F.stddev_samp(reward).over(of), F.lit(0.0)) + 1e-4))
    dev = df.agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_dev"))
    return df.crossJoin(F.broadcast(dev)).withColumn("advantage", centred / (F.col("_dev") + 1e-4)).drop("_dev")  # one row


def resolve_tasks(names: DataFrame) -> DataFrame:
    """(ord, name) to the tasks they stand for, each where it comes first; a name that is no group stands for itself."""
    spark = names.sparkSession
    groups = spark.createDataFrame([(g, i, t) for g, ts in TASK_GROUPS.items() for i, t in enumerate(ts)], "grp string, pos int, task string")
    rows = names.join(F.broadcast(groups), F.col("name") == F.col("grp"), "left").select("ord", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("task", "name").alias("task"))
    return rows.groupBy("task").agg(F.min(F.struct("ord", "pos")).alias("at")).select("task", "at.ord", "at.pos")


def throughput(df: DataFrame, n: int) -> DataFrame:
    """(elapsed_s, n_out_tokens) to tokens per second, seconds per item, and hours that n items take."""
    return df.agg(F.round(F.sum("n_out_tokens") / F.sum("elapsed_s"), 4).alias("tok_per_s"), F.round(F.avg("elapsed_s"), 4).alias("s_per_item"), F.round(F.avg("elapsed_s") * n / 3600, 4).alias("hours"))


def position_bias(df: DataFrame) -> DataFrame:
    """Extension: how often the first place wins, and the longer answer."""
    return df.agg(F.round(F.avg((F.col("winner") == "A").cast("double")), 6).alias("first_share"), F.round(F.avg(((F.col("winner") == "A") == (F.length("answer_a") > F.length("answer_b"))).cast("double")), 6).alias("longer_share"))
