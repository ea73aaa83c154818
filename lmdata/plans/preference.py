"""Queries of preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions.text import WS
from lmdata.operators import prefs
from lmdata.operators.tokens import holdout, sample
from lmdata.plans.registry import query
from lmdata.plans.views import view, with_views

_S = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
_REASON = f"""CASE WHEN prompt IS NULL OR chosen IS NULL OR rejected IS NULL THEN 'missing_fields'
 WHEN {_S % "prompt"} = '' OR {_S % "chosen"} = '' OR {_S % "rejected"} = '' THEN 'empty_field'
 WHEN {_S % "chosen"} = {_S % "rejected"} THEN 'chosen_eq_rejected'
 WHEN least(length(prompt), length(chosen), length(rejected)) < 10 THEN 'too_short'
 WHEN greatest(length(prompt), length(chosen), length(rejected)) > 20000 THEN 'too_long' END"""
_STATS = """SELECT metric, count(x) AS n, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 2) AS median, round(coalesce(stddev_samp(x), 0.0), 2) AS stdev,
 round(min(x), 2) AS min, round(max(x), 2) AS max, round(quantile_cont(x, 0.95), 2) AS p95, round(quantile_cont(x, 0.99), 2) AS p99 FROM (%s) v WHERE x IS NOT NULL GROUP BY metric"""


def _union(values: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::DOUBLE AS x FROM {source}" for k, v in values.items())


@query("c6_filter_pairs", with_views(f"SELECT pair_id FROM v_pref WHERE {_REASON} IS NULL", "v_pref"))
def c6(spark, sf_dir):
    return prefs.filter_pairs(view(spark, sf_dir, "v_pref")).select("pair_id")


@query("g10_drop_reasons", with_views(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM v_pref GROUP BY 1", "v_pref"))
def g10(spark, sf_dir):
    return prefs.reasons(view(spark, sf_dir, "v_pref"))


@query("g1_char_summary", with_views(_STATS % _union({"prompt": "length(prompt)", "chosen": "length(chosen)", "rejected": "length(rejected)", "chosen_minus_rejected": "length(chosen) - length(rejected)"}, "v_pref"), "v_pref"))
def g1(spark, sf_dir):
    return prefs.summary(view(spark, sf_dir, "v_pref"), prefs.length_values())


@query(
    "g3_length_bias",
    with_views("SELECT round(avg((length(chosen) > length(rejected))::INT) * 100, 2) AS chosen_longer_pct, round(avg((abs(length(chosen) - length(rejected)) / greatest(length(chosen), length(rejected), 1) > 0.5)::INT) * 100, 2) AS length_bias_pct FROM v_pref", "v_pref"),
)
def g3(spark, sf_dir):
    return prefs.length_bias(view(spark, sf_dir, "v_pref"))


@query("g4_token_summary", with_views(_STATS % _union({"prompt": "strlen(prompt)", "prompt_chosen": "strlen(prompt) + strlen(chosen)", "prompt_rejected": "strlen(prompt) + strlen(rejected)"}, "v_pref"), "v_pref"))
def g4(spark, sf_dir):
    return prefs.summary(view(spark, sf_dir, "v_pref"), prefs.token_values())


@query("g4_coverage", with_views("SELECT " + ", ".join(f"round(avg((strlen(prompt) + strlen(chosen) <= {m})::INT) * 100, 2) AS coverage_{m}" for m in (1024, 2048, 4096)) + " FROM v_pref", "v_pref"))
def g4_coverage(spark, sf_dir):
    return prefs.coverage(view(spark, sf_dir, "v_pref"))


@query("c29_length_ratio", with_views("SELECT pair_id FROM v_pref WHERE abs(length(chosen) - length(rejected)) / greatest(length(chosen), 1) <= 0.5", "v_pref"))
def c29(spark, sf_dir):
    return view(spark, sf_dir, "v_pref").filter(prefs.length_ratio_ok()).select("pair_id")


_RANK = "row_number() OVER (ORDER BY md5('%s:' || %s)) AS rk"


@query(
    "c21_inject_noise",
    with_views(f"""SELECT pair_id, CASE WHEN rk <= m THEN rejected ELSE chosen END AS chosen, CASE WHEN rk <= m THEN chosen ELSE rejected END AS rejected, rk <= m AS flipped
FROM (SELECT *, {_RANK % (7, "pair_id")}, round_even(count(*) OVER () * 0.3, 0) AS m FROM v_pref) x""", "v_pref"),
)
def c21(spark, sf_dir):
    return prefs.inject_noise(view(spark, sf_dir, "v_pref"), 0.3, 7).select("pair_id", "chosen", "rejected", "flipped")


@query("h7_holdout", with_views(f"SELECT pair_id, CASE WHEN rk <= 20 THEN 'holdout' ELSE 'train' END AS part FROM (SELECT *, {_RANK % (123, 'pair_id')} FROM v_pref) x", "v_pref"))
def h7(spark, sf_dir):
    return holdout(view(spark, sf_dir, "v_pref"), "pair_id", 20).select("pair_id", "part")


@query("h8_sample", with_views(f"SELECT pair_id FROM (SELECT *, {_RANK % (123, 'pair_id')} FROM v_pref) x WHERE rk <= 50", "v_pref"))
def h8(spark, sf_dir):
    return sample(view(spark, sf_dir, "v_pref"), "pair_id", 50).select("pair_id")
