"""Queries of array arithmetic and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions import arrays as A
from lmdata.plans.registry import query
from lmdata.plans.views import table, view, with_views

_LS = "list_transform({0}, lambda x: x::DOUBLE / {1} - (list_max({0})::DOUBLE / {1} + ln(list_sum(list_transform({0}, lambda y: exp(y::DOUBLE / {1} - list_max({0})::DOUBLE / {1})))))) "


@query("f23_restricted_kl", with_views(f"SELECT pos, round(list_sum(list_transform(list_zip(t, s), lambda z: exp(z[1]) * (z[1] - z[2]))), 5) AS kl FROM (SELECT pos, {_LS.format('teacher', '2.0')} AS t, {_LS.format('student', '2.0')} AS s FROM v_logits) x", "v_logits"))
def f23(spark, sf_dir):
    return view(spark, sf_dir, "v_logits").select("pos", F.round(A.restricted_kl(F.col("teacher"), F.col("student"), 2.0), 5).alias("kl"))


@query("f23_kd_total", with_views(f"SELECT pos, round(0.3 * 1.5 + 0.7 * 4.0 * list_sum(list_transform(list_zip(t, s), lambda z: exp(z[1]) * (z[1] - z[2]))), 5) AS loss FROM (SELECT pos, {_LS.format('teacher', '2.0')} AS t, {_LS.format('student', '2.0')} AS s FROM v_logits) x", "v_logits"))
def f23_total(spark, sf_dir):
    kl = A.restricted_kl(F.col("teacher"), F.col("student"), 2.0)
    return view(spark, sf_dir, "v_logits").select("pos", F.round(A.kd_total(F.lit(1.5), kl, 0.3, 2.0), 5).alias("loss"))


@query(
    "f22_top_k",
    """SELECT vec_id, rn - 1 AS place, i AS token, round(v::DOUBLE, 6) AS logit FROM (SELECT vec_id, i, embedding[i + 1] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS rn
FROM embeddings, unnest(range(0, 64)) AS u(i)) x WHERE rn <= 5""",
)
def f22(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.top_k(F.col("embedding"), 5)).alias("place", "t"))
    return rows.select("vec_id", F.col("place").cast("long"), F.col("t.token").cast("long").alias("token"), F.round(F.col("t.logit").cast("double"), 6).alias("logit"))


@query("f24_sequence_logp", "SELECT vec_id, round(list_sum(list_transform(embedding[11:], lambda x: x::DOUBLE)), 5) AS s, round(list_sum(list_transform(embedding[11:], lambda x: x::DOUBLE)) / 54, 5) AS m FROM embeddings")
def f24(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.logp_sum(e, F.lit(10)), 5).alias("s"), F.round(A.logp_mean(e, F.lit(10)), 5).alias("m"))


@query("h22_preference_losses", "SELECT event_id, round(ln(1 + exp(-abs(0.3 * d))) + greatest(-0.3 * d, 0.0), 6) AS dpo, round((d - 1 / 0.6) * (d - 1 / 0.6), 6) AS ipo, round(exp(d) - d - 1, 6) AS k3 FROM (SELECT event_id, (value - 50) / 50 AS d FROM events) x")
def h22(spark, sf_dir):
    d = (F.col("value") - 50) / 50
    return table(spark, sf_dir, "events").select("event_id", F.round(A.dpo_loss(d, 0.3), 6).alias("dpo"), F.round(A.ipo_loss(d, 0.3), 6).alias("ipo"), F.round(A.k3(d), 6).alias("k3"))


@query(
    "f16_lr_schedules",
    """SELECT item_id, round(CASE WHEN item_id < 5 THEN 0.001 * (item_id + 1) / 6 WHEN item_id > 30 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * (item_id - 5) / 25.0)) * 0.0009 END, 9) AS cosine,
  round(CASE WHEN item_id < 5 THEN 0.001 * (item_id + 1) / 5 ELSE 0.001 END, 9) AS constant FROM benchmark""",
)
def f16(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(A.warmup_cosine(i, 5, 30, 0.001, 0.0001), 9).alias("cosine"), F.round(A.warmup_constant(i, 5, 0.001), 9).alias("constant"))


@query("f21_padded", "SELECT vec_id, label AS n, list_sum(list_transform(embedding[1:label + 2], lambda x: round(x::DOUBLE, 4))) AS s FROM embeddings")
def f21(spark, sf_dir):
    vals = F.transform(F.slice("embedding", F.lit(1), F.col("label") + 2), lambda x: F.round(x.cast("double"), 4))
    moved = A.at_completion(vals, F.lit(4), 96)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("n"), F.aggregate(moved, F.lit(0.0), lambda s, x: s + x).alias("s"))
