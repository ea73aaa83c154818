"""Training sweeps: logs, run classes, comparison with a control, and the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.functions.text import seconds_of_day


def last_values(log: DataFrame, value: str, key: str = "run", order: str = "step") -> DataFrame:
    """Of each run the last row whose value is there."""
    return log.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.struct(order, value), order).alias("l")).select(key, "l.*")


def quarters(log: DataFrame, value: str, key: str = "run", order: str = "step") -> DataFrame:
    """Means of a run's quarters in order.  A run's rows are numbered together: a log has as many as it has steps."""
    q = log.filter(F.col(value).isNotNull()).withColumn("quarter", F.ntile(4).over(Window.partitionBy(key).orderBy(order)))
    return q.groupBy(key, "quarter").agg(F.round(F.avg(value), 3).alias("mean"))


def buffered(log: DataFrame, values: list[str], every: int, key: str = "run", order: str = "step") -> DataFrame:
    """Means of the steps since the last log line, a line each ``every`` steps."""
    return log.groupBy(key, F.floor((F.col(order) - 1) / every).alias("line")).agg(*[F.round(F.avg(v), 6).alias(v) for v in values], F.max(order).alias(order))


def classify(run: Column, noise: Column, loss: Column, beta: Column) -> Column:
    noise, loss, beta = F.coalesce(noise, F.lit(0.0)), F.coalesce(loss, F.lit("sigmoid")), F.coalesce(beta, F.lit(0.3))
    scan = run.startswith("beta_") & beta.isin(0.01, 10.0, 0.1, 0.5)
    return F.when((run == "beta_0.3") & (noise == 0) & (loss == "sigmoid"), "control").when(noise > 0, "noise").when(loss == "ipo", "ipo").when(scan & beta.isin(0.01, 10.0), "extreme-beta").when(scan, "beta-scan").otherwise("other")


def run_key(run: Column) -> Column:
    return F.regexp_replace(run, "^beta_", "")


def winrate_key(run: Column) -> Column:
    return F.concat(F.lit("dpo_b"), run_key(run))


def against_control(runs: DataFrame, metrics: list[str], control: Column) -> DataFrame:
    """Each run's metrics less the control's, null where either is; the control is one row."""
    one = runs.filter(control).limit(1).select(*[F.col(m).alias(f"_c_{m}") for m in metrics])
    return runs.join(F.broadcast(one), F.lit(True), "left").select(*runs.columns, *[F.round(F.col(m) - F.col(f"_c_{m}"), 3).alias(f"d_{m}") for m in metrics])


def drift(margin: Column, beta: Column) -> Column:
    return F.round(F.try_divide(margin, beta), 2)


def star(runs: DataFrame, *sides: DataFrame, key: str = "run") -> DataFrame:
    for s in sides:
        runs = runs.join(s, key, "left")
    return runs


def best_gain(sweep: DataFrame) -> DataFrame:
    """The largest gain, then the least forgetting."""
    return sweep.orderBy(F.col("gain").desc(), F.col("forgetting").asc(), "run").limit(1)


def best_dpo(sweep: DataFrame, tolerance: float = -0.02) -> DataFrame:
    """The best matched win rate among runs that lost little; a missing rate counts as -1; the earlier run wins ties."""
    ok = sweep.filter(F.col("med_delta").isNull() | (F.col("med_delta") >= tolerance))
    return ok.orderBy(F.coalesce("matched_wr", F.lit(-1.0)).desc(), "ord").limit(1)


def train_minutes(lines: DataFrame) -> DataFrame:
    """(pos, line) to (run, minutes): from a start to its end, past midnight too.

    A start while the run is open is ignored, an end without a start too; of several pairs the last counts.
    """
    clock = F.regexp_extract("line", r"^\[(\d{2}:\d{2}:\d{2})\]", 1)
    begun = F.regexp_extract("line", r"^\[\d{2}:\d{2}:\d{2}\] ---- TRAIN (\S+)", 1)
    ended = F.regexp_extract("line", r"^\[\d{2}:\d{2}:\d{2}\] [✓✗] TRAIN (\S+) (?:OK|FAIL)", 1)
    rows = lines.select("pos", seconds_of_day(F.nullif(clock, F.lit(""))).alias("at"), F.coalesce(F.nullif(begun, F.lit("")), F.nullif(ended, F.lit(""))).alias("run"), (begun != "").cast("int").alias("begins")).filter("run IS NOT NULL")
    earlier = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("session", F.coalesce(F.sum(1 - F.col("begins")).over(earlier), F.lit(0)))
    pairs = rows.groupBy("run", "session").agg(F.min_by(F.when(F.col("begins") == 1, F.col("at")), F.when(F.col("begins") == 1, F.col("pos"))).alias("a"), F.max(F.when(F.col("begins") == 0, F.col("at"))).alias("b"))
    done = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("run").agg(F.max_by(F.struct("a", "b"), "session").alias("p"))
    took = F.col("p.b") - F.col("p.a")
    return done.select("run", F.round((took + F.when(took < 0, 86400).otherwise(0)) / 60.0, 1).alias("minutes"))


def loss_lines(lines: DataFrame) -> DataFrame:
    """(line) of a trainer's output to (iter, kind, loss)."""
    at = F.regexp_extract("line", r"(?:Iter|Step)\s*(\d+)", 1)
    value = lambda k: F.regexp_extract("line", rf"(?:Iter|Step)\s*\d+.*?[{k[0]}{k[0].lower()}]{k[1:]}\w*\s*loss\s*([\d.eE+-]+)", 1)
    kinds = F.array(*[F.struct(F.lit(k.lower()).alias("kind"), F.nullif(value(k), F.lit("")).alias("v")) for k in ("Train", "Val")])
    rows = lines.select(F.nullif(at, F.lit("")).cast("int").alias("iter"), F.explode(kinds).alias("k"))
    return rows.filter("iter IS NOT NULL AND k.v IS NOT NULL").select("iter", "k.kind", F.col("k.v").try_cast("double").alias("loss"))


def arm_tags(configs: DataFrame) -> DataFrame:
    """(run, method, alpha, temperature, data) to how a run was distilled; what only the other method has is null."""
    kd = F.coalesce(F.col("method").startswith("logit_distillation"), F.lit(False))
    return configs.select("run", F.when(kd, "logit_KD").otherwise("onpolicy_SFT").alias("kd_method"), F.when(kd, F.col("alpha")).alias("alpha"), F.when(kd, F.col("temperature")).alias("temperature"), F.when(~kd, F.element_at(F.split(F.coalesce("data", F.lit("")), "/"), -1)).alias("data_source"))


def arm_table(arms: DataFrame, base: dict[str, float]) -> DataFrame:
    """(run, holdout, d_medical, d_general) with the holdout's delta and the scores that the deltas lead to; null stays null."""
    return arms.select(
        "run", "holdout", F.round(F.col("holdout") - base["holdout"], 4).alias("holdout_delta"), F.round(F.col("d_medical") + base["medical"], 4).alias("medical"), "d_medical",
        F.round(F.col("d_general") + base["general"], 4).alias("general"), "d_general",
    )


def overlay(defaults: DataFrame, measured: DataFrame, key: str = "run") -> DataFrame:
    """Defaults, with measured values over them where there are any."""
    values = [c for c in defaults.columns if c != key]
    m = measured.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_m_{c}") for c in values])
    return defaults.join(m, F.col(key) == F.col("_k"), "left").select(key, *[F.coalesce(f"_m_{c}", c).alias(c) for c in values])


def teacher_accuracy(answers: DataFrame) -> DataFrame:
    """One row: n, acc, compliant, the last two null without answers."""
    hit = F.coalesce("letter_matches_gold", F.lit(False)).cast("double")
    letter = (F.coalesce("teacher_letter", F.lit("")) != "").cast("double")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 4).alias("acc"), F.round(F.avg(letter), 4).alias("compliant"))


def in_sweep_order(runs: DataFrame, order: list[str]) -> DataFrame:
    """Adds place: sweeps in the given order, runs by name within; unknown sweeps come last."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("sweep")), F.lit(0))
    rank = F.when(at == 0, len(order) + 1).otherwise(at)
    return runs.withColumn("place", F.row_number().over(Window.orderBy(rank, "sweep", "run")))  # a row per run
