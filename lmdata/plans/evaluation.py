"""Queries of evaluation and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions import text as T
from lmdata.functions.arrays import perplexity
from lmdata.operators import evals, sweeps
from lmdata.plans.registry import query
from lmdata.plans.selection import _F1
from lmdata.plans.views import table, view, with_views


def _v(spark, sf_dir, name):
    return view(spark, sf_dir, name)


@query("g5_accuracy", with_views(f"SELECT count(*) AS n, sum(coalesce(p = gold, false)::INT)::BIGINT AS correct, round(avg(coalesce(p = gold, false)::INT), 4) AS accuracy, sum((p IS NULL)::INT)::BIGINT AS unparseable, round(avg((p IS NULL)::INT), 4) AS unparseable_rate FROM (SELECT gold, {_F1} AS p FROM v_samples) x", "v_samples"))
def g5(spark, sf_dir):
    return evals.accuracy(_v(spark, sf_dir, "v_samples").withColumn("pred", T.extract_answer(F.col("text"))))


@query("c19_accuracy_reward", with_views(f"SELECT question_id, sample_idx, coalesce(({_F1} = gold)::INT::DOUBLE, 0.0) AS reward FROM v_samples", "v_samples"))
def c19(spark, sf_dir):
    return _v(spark, sf_dir, "v_samples").select("question_id", "sample_idx", evals.accuracy_reward(F.col("text"), F.col("gold")).alias("reward"))


@query("c18_format_reward", with_views(f"SELECT question_id, sample_idx, (CASE WHEN length(text) > 20 AND length(text) < 500 THEN 0.5 ELSE 0.0 END + CASE WHEN {_F1} IS NOT NULL THEN 0.5 ELSE 0.0 END)::DOUBLE AS reward FROM v_samples", "v_samples"))
def c18(spark, sf_dir):
    return _v(spark, sf_dir, "v_samples").select("question_id", "sample_idx", evals.format_reward(F.col("text")).alias("reward"))


@query("h17_running_accuracy", with_views("SELECT question_id, sample_idx, round(avg(correct::INT) OVER (ORDER BY question_id * 8 + sample_idx ROWS UNBOUNDED PRECEDING), 6) AS acc FROM v_samples", "v_samples"))
def h17(spark, sf_dir):
    rows = _v(spark, sf_dir, "v_samples").withColumn("place", F.col("question_id") * 8 + F.col("sample_idx"))
    return evals.running_accuracy(rows, "place", F.col("correct")).select("question_id", "sample_idx", F.round("acc", 6).alias("acc"))


@query("h16_advantages", with_views("SELECT question_id, sample_idx, round((r - avg(r) OVER q) / (coalesce(stddev_samp(r) OVER q, 0.0) + 0.0001), 6) AS advantage FROM (SELECT *, correct::INT::DOUBLE AS r FROM v_samples) x WINDOW q AS (PARTITION BY question_id)", "v_samples"))
def h16(spark, sf_dir):
    rows = _v(spark, sf_dir, "v_samples").withColumn("reward", F.col("correct").cast("double"))
    return evals.advantages(rows).select("question_id", "sample_idx", F.round("advantage", 6).alias("advantage"))


_PAIRS = "SELECT event_id, value AS cs, length(props)::DOUBLE AS cn, value * 1.1 - 3 AS rs, (user_id % 9)::DOUBLE AS rn FROM events"
_WR = f"""WITH p AS (SELECT (cs > rs)::INT AS s, (cs / cn > rs / rn)::INT AS m, CASE WHEN abs(cn - rn) / greatest(cn, rn) < 0.2 THEN 'matched' WHEN abs(cn - rn) / greatest(cn, rn) < 0.5 THEN 'mid' ELSE 'skewed' END AS b
FROM ({_PAIRS}) x WHERE cn > 0 AND rn > 0), w AS (SELECT 'all' AS bucket, s, m FROM p UNION ALL SELECT b, s, m FROM p)
SELECT n.bucket, count(w.s) AS n, round(avg(s), 3) AS sum_wr, round(avg(m), 3) AS mean_wr FROM (SELECT unnest(['all', 'matched', 'mid', 'skewed']) AS bucket) n LEFT JOIN w USING (bucket) GROUP BY n.bucket"""


@query("g6_win_rates", _WR)
def g6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evals.win_rates(e.select(F.col("value").alias("chosen_sum"), F.length("props").cast("double").alias("chosen_n"), (F.col("value") * 1.1 - 3).alias("rejected_sum"), (F.col("user_id") % 9).cast("double").alias("rejected_n")))


@query("g7_group_deltas", with_views("m AS (SELECT model, task_group, round(avg(acc), 4) AS mean_acc FROM v_scores GROUP BY 1, 2) SELECT t.task_group, t.model, t.mean_acc, b.mean_acc AS base_acc, round(t.mean_acc - b.mean_acc, 4) AS delta FROM m t JOIN m b ON b.task_group = t.task_group AND b.model = 'base' WHERE t.model <> 'base'", "v_scores").replace("\nm AS", ",\nm AS", 1))
def g7(spark, sf_dir):
    return evals.deltas(evals.group_means(_v(spark, sf_dir, "v_scores")), "base")


_GAINS = """SELECT b.task, b.task_group, b.acc AS base, t.acc AS tuned, round(t.acc - b.acc, 6) AS abs_gain, round(CASE WHEN b.acc > 0 THEN (t.acc - b.acc) / b.acc ELSE 0.0 END, 6) AS rel_gain,
  round(CASE WHEN b.acc > 0 THEN (b.acc - t.acc) / b.acc ELSE 0.0 END, 6) AS forgetting, CASE WHEN t.acc > b.acc THEN 'up' ELSE 'down' END AS direction
FROM v_scores b JOIN v_scores t ON t.task = b.task AND t.model = 'tuned' WHERE b.model = 'base'"""


@query("g8_gains", with_views(_GAINS, "v_scores"))
def g8(spark, sf_dir):
    return evals.gains(_v(spark, sf_dir, "v_scores"), "base", "tuned")


@query("h13_gain_forgetting", with_views(f"SELECT round(avg(abs_gain) FILTER (WHERE task_group = 'domain'), 5) AS domain_gain, round(avg(forgetting) FILTER (WHERE task_group = 'general'), 5) AS forgetting FROM ({_GAINS}) g", "v_scores"))
def h13(spark, sf_dir):
    return evals.gain_and_forgetting(_v(spark, sf_dir, "v_scores"), "base", "tuned")


@query("d8_common_tasks", with_views("SELECT task FROM v_scores WHERE model = 'base' INTERSECT SELECT task FROM v_scores WHERE model = 'tuned'", "v_scores"))
def d8(spark, sf_dir):
    s = _v(spark, sf_dir, "v_scores")
    return s.filter("model = 'base'").select("task").intersect(s.filter("model = 'tuned'").select("task"))


@query("g17_debiased_verdicts", with_views("SELECT CASE WHEN first_verdict = CASE second_verdict WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'tie' END THEN first_verdict ELSE 'tie' END AS winner, count(*) AS n FROM v_verdicts GROUP BY 1", "v_verdicts"))
def g17(spark, sf_dir):
    return evals.debiased(_v(spark, sf_dir, "v_verdicts")).groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g20_kappa",
    with_views("""t AS (SELECT count(*) AS n, sum((r1 = r2)::INT) AS same FROM v_raters), a AS (SELECT r1 AS v, count(*) AS x FROM v_raters GROUP BY 1), b AS (SELECT r2 AS v, count(*) AS y FROM v_raters GROUP BY 1),
c AS (SELECT sum(x * y) AS c FROM a JOIN b USING (v))
SELECT n, round(same / n, 6) AS observed, round(c / (n * n), 6) AS expected, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM t, c""", "v_raters").replace("\nt AS", ",\nt AS", 1),
)
def g20(spark, sf_dir):
    return evals.kappa(_v(spark, sf_dir, "v_raters"))


@query("c25_resolve_tasks", "SELECT t.task, t.ord, t.pos FROM (VALUES ('cmmlu_world_history', 0, 0), ('cmmlu_high_school_physics', 0, 1), ('cmmlu_economics', 0, 2), ('cmmlu_marxist_theory', 0, 3), ('own_task', 1, 0)) t(task, ord, pos)")
def c25(spark, sf_dir):
    names = table(spark, sf_dir, "region").limit(1).select(F.posexplode(F.array(*[F.lit(x) for x in ("general_cn", "own_task", "cmmlu_economics")])).alias("ord", "name"))
    return evals.resolve_tasks(names)


@query("f12_best_accuracy")
def f12(spark, sf_dir):
    m = F.create_map(F.lit("alias"), F.lit("x"), F.when(F.col("item_id") % 2 == 0, "acc,none").otherwise("my_acc"), (F.col("item_id") / 100).cast("string"), F.lit("acc_stderr"), F.lit("9"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.best_accuracy(m).alias("acc"))


@query("g25_throughput", "SELECT round(sum(length(props)) / sum(value), 4) AS tok_per_s, round(avg(value), 4) AS s_per_item, round(avg(value) * 2000 / 3600, 4) AS hours FROM events")
def g25(spark, sf_dir):
    return evals.throughput(table(spark, sf_dir, "events").select(F.col("value").alias("elapsed_s"), F.length("props").alias("n_out_tokens")), 2000)


@query("g18_mean_ignoring_nulls", with_views("SELECT run, round(avg(margin), 6) AS mean FROM v_runlog GROUP BY run", "v_runlog"))
def g18(spark, sf_dir):
    return _v(spark, sf_dir, "v_runlog").groupBy("run").agg(F.round(F.avg("margin"), 6).alias("mean"))


@query("a10_last_margin", with_views("SELECT run, max(step) AS step, arg_max(margin, step) AS margin FROM v_runlog WHERE margin IS NOT NULL GROUP BY run", "v_runlog"))
def a10(spark, sf_dir):
    return sweeps.last_values(_v(spark, sf_dir, "v_runlog"), "margin")


@query("h18_quarter_means", with_views("SELECT run, quarter::INT AS quarter, round(avg(margin), 3) AS mean FROM (SELECT *, ntile(4) OVER (PARTITION BY run ORDER BY step) AS quarter FROM v_runlog WHERE margin IS NOT NULL) x GROUP BY 1, 2", "v_runlog"))
def h18(spark, sf_dir):
    return sweeps.quarters(_v(spark, sf_dir, "v_runlog"), "margin")


@query("h21_loss_buffer", with_views("SELECT run, floor((step - 1) / 50)::BIGINT AS line, round(avg(margin), 6) AS margin, max(step) AS step FROM v_runlog GROUP BY 1, 2", "v_runlog"))
def h21(spark, sf_dir):
    return sweeps.buffered(_v(spark, sf_dir, "v_runlog"), ["margin"], 50)


_RUNS = "r AS (SELECT run, arg_max(margin, step) AS margin, count(*)::DOUBLE AS n FROM v_runlog WHERE margin IS NOT NULL GROUP BY run)"


def _runs(spark, sf_dir):
    return _v(spark, sf_dir, "v_runlog").filter("margin IS NOT NULL").groupBy("run").agg(F.max_by("margin", "step").alias("margin"), F.count(F.lit(1)).cast("double").alias("n"))


@query("h15_against_control", with_views(_RUNS + " SELECT r.run, r.margin, r.n, round(r.margin - c.margin, 3) AS d_margin, round(r.n - c.n, 3) AS d_n FROM r, (SELECT * FROM r WHERE run = 'click') c", "v_runlog").replace("\nr AS", ",\nr AS", 1))
def h15(spark, sf_dir):
    return sweeps.against_control(_runs(spark, sf_dir), ["margin", "n"], F.col("run") == "click")


@query("h15_drift", with_views(_RUNS + " SELECT run, round(margin / nullif(b, 0), 2) AS drift FROM (SELECT run, margin, CASE WHEN run = 'error' THEN 0.0 ELSE 0.1 END AS b FROM r) x", "v_runlog").replace("\nr AS", ",\nr AS", 1))
def h15_drift(spark, sf_dir):
    return _runs(spark, sf_dir).select("run", sweeps.drift(F.col("margin"), F.when(F.col("run") == "error", 0.0).otherwise(0.1)).alias("drift"))


@query("h14_best_run", with_views(_RUNS + " SELECT run FROM r WHERE margin IS NULL OR margin >= -0.02 ORDER BY coalesce(CASE WHEN run = 'click' THEN NULL ELSE n END, -1.0) DESC, run LIMIT 1", "v_runlog").replace("\nr AS", ",\nr AS", 1))
def h14(spark, sf_dir):
    rows = _runs(spark, sf_dir).select("run", F.col("margin").alias("med_delta"), F.when(F.col("run") != "click", F.col("n")).alias("matched_wr"), F.col("run").alias("ord"))
    return sweeps.best_dpo(rows).select("run")


@query("h13_best_sweep", with_views(_RUNS + " SELECT run FROM r ORDER BY margin DESC, n, run LIMIT 1", "v_runlog").replace("\nr AS", ",\nr AS", 1))
def h13_best(spark, sf_dir):
    return sweeps.best_gain(_runs(spark, sf_dir).select("run", F.col("margin").alias("gain"), F.col("n").alias("forgetting"))).select("run")


@query("e7_star", with_views(_RUNS + " SELECT r.run, r.margin, r.n, q.steps FROM r LEFT JOIN (SELECT run, max(step) AS steps FROM v_runlog GROUP BY run) q USING (run)", "v_runlog").replace("\nr AS", ",\nr AS", 1))
def e7(spark, sf_dir):
    return sweeps.star(_runs(spark, sf_dir), _v(spark, sf_dir, "v_runlog").groupBy("run").agg(F.max("step").alias("steps")))


@query("c23_run_class", """SELECT event_id, CASE WHEN b = 3 AND z = 0 AND l <> 'ipo' THEN 'control' WHEN z > 0 THEN 'noise' WHEN l = 'ipo' THEN 'ipo' WHEN b = 1 THEN 'beta-scan' WHEN b = 5 THEN 'beta-scan' WHEN b = 0 THEN 'extreme-beta' ELSE 'other' END AS kind
FROM (SELECT event_id, event_id % 6 AS b, CASE WHEN event_id % 11 = 0 THEN 0.1 ELSE 0.0 END AS z, CASE WHEN event_id % 7 = 0 THEN 'ipo' ELSE 'sigmoid' END AS l FROM events) x""")
def c23(spark, sf_dir):
    b = F.col("event_id") % 6
    beta = F.when(b == 0, 0.01).otherwise(b.cast("double") / 10)
    run = F.concat(F.lit("beta_"), F.when(b == 0, "0.01").otherwise(F.concat(F.lit("0."), b.cast("string"))))
    kind = sweeps.classify(run, F.when(F.col("event_id") % 11 == 0, 0.1), F.when(F.col("event_id") % 7 == 0, "ipo"), beta)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query("c24_run_keys", "SELECT DISTINCT event_type AS run, event_type AS k, 'dpo_b' || event_type AS wk FROM events")
def c24(spark, sf_dir):
    run = F.concat(F.lit("beta_"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), sweeps.run_key(run).alias("k"), sweeps.winrate_key(run).alias("wk")).distinct()


@query("f13_numbers", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(value, 4) END AS v FROM events")
def f13(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.number4(F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("n/a")).alias("v"))


@query("f14_seconds", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS s FROM events")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.seconds_of_day(F.date_format("ts", "HH:mm:ss")).alias("s"))


@query("f26_perplexity", with_views("SELECT run, step, round(exp(margin / 100), 6) AS ppl FROM v_runlog", "v_runlog"))
def f26(spark, sf_dir):
    return _v(spark, sf_dir, "v_runlog").select("run", "step", F.round(perplexity(F.col("margin") / 100), 6).alias("ppl"))


@query("g21_judge_bias", "SELECT round(avg((event_id % 3 = 0)::INT), 6) AS first_share, round(avg(((event_id % 3 = 0) = (length(props) > length(event_type)))::INT), 6) AS longer_share FROM events")
def g21(spark, sf_dir):
    rows = _v(spark, sf_dir, "v_verdicts").join(table(spark, sf_dir, "events"), F.col("question_id") == F.col("event_id"))
    return evals.position_bias(rows.select(F.col("first_verdict").alias("winner"), F.col("props").alias("answer_a"), F.col("event_type").alias("answer_b")))
