"""Queries of limits, tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions import text as T
from lmdata.operators import chat, select, sweeps, tokens, validate
from lmdata.plans.evaluation import _RUNS, _runs
from lmdata.plans.preference import _REASON
from lmdata.plans.registry import query
from lmdata.plans.views import table, view, with_views
from lmdata.sources import readers, sinks


def _with_runs(sql: str) -> str:
    return with_views(_RUNS + " " + sql, "v_runlog").replace("\nr AS", ",\nr AS", 1)


@query("c17_head_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def c17(spark, sf_dir):
    return sinks.preview(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("a5_collected_texts", "SELECT doc_id AS pos FROM documents WHERE length(text) > 50 ORDER BY doc_id LIMIT 100")
def a5(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.to_json(F.struct(F.col("text").alias("content"))).alias("value"))
    return readers.collect_texts(records, 100).select("pos")


@query("a6_filled_files", "SELECT (doc_id % 2)::INT AS file, doc_id AS pos FROM documents ORDER BY file, pos LIMIT 150")
def a6(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return readers.fill([d.filter("pos % 2 = 0"), d.filter("pos % 2 = 1")], 150).select("file", "pos")


@query("c20_last_turn", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def c20(spark, sf_dir):
    return chat.messages(table(spark, sf_dir, "conversations")).select("conv_id", T.last_content(F.col("messages")).alias("text"))


@query("d7_disjoint_split", with_views("SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY md5('123:' || pair_id)) <= 20 THEN 'holdout' ELSE 'train' END AS part FROM v_pref) x GROUP BY part", "v_pref"))
def d7(spark, sf_dir):
    return tokens.holdout(view(spark, sf_dir, "v_pref"), "pair_id", 20).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("c26_arm_tags", "SELECT DISTINCT event_type AS run, CASE WHEN event_type IN ('click', 'error') THEN 'logit_KD' ELSE 'onpolicy_SFT' END AS kd_method, CASE WHEN event_type IN ('click', 'error') THEN 0.5::DOUBLE END AS alpha, CASE WHEN event_type IN ('click', 'error') THEN 2.0::DOUBLE END AS temperature, CASE WHEN event_type NOT IN ('click', 'error') THEN event_type || '.jsonl' END AS data_source FROM events")
def c26(spark, sf_dir):
    run = F.col("event_type")
    configs = table(spark, sf_dir, "events").select(run.alias("run"), F.when(run.isin("click", "error"), "logit_distillation_v1").alias("method"), F.lit(0.5).alias("alpha"), F.lit(2.0).alias("temperature"), F.concat(F.lit("a/b/"), run, F.lit(".jsonl")).alias("data"))
    return sweeps.arm_tags(configs).distinct()


@query("e4_kd_join", "SELECT vec_id AS question_id, least(20, 64, 40 - (label % 50))::INT AS kept FROM embeddings WHERE label % 3 <> 0 AND 40 - (label % 50) > 0")
def e4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = (F.col("label") % 50).cast("int")
    ids = lambda k: F.slice(F.sequence(F.lit(0), F.lit(99)), F.lit(1), k)
    sft = e.select(F.col("vec_id").alias("question_id"), ids(n).alias("prompt_ids"), ids(F.lit(20)).alias("completion_ids"))
    logits = e.select(F.col("vec_id").alias("question_id"), F.when(F.col("label") % 3 == 0, n + 1).otherwise(n).alias("prompt_len"), F.col("embedding").alias("positions"))
    return select.with_logits(sft, logits, 40).select("question_id", F.size("completion_ids").alias("kept"))


@query("e9_overlay", _with_runs("SELECT run, CASE WHEN run = 'click' THEN margin ELSE 1.5 END AS margin, CASE WHEN run = 'click' THEN n ELSE 2.5 END AS n FROM r"))
def e9(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return sweeps.overlay(runs.select("run", F.lit(1.5).alias("margin"), F.lit(2.5).alias("n")), runs.filter("run = 'click'"))


@query("g13_teacher_accuracy", with_views("SELECT count(*) AS n, round(avg((teacher_answer <> '' AND question_id % 2 = 0)::INT), 4) AS acc, round(avg((teacher_answer <> '')::INT), 4) AS compliant FROM v_teacher", "v_teacher"))
def g13(spark, sf_dir):
    said = F.nullif("teacher_answer", F.lit(""))
    return sweeps.teacher_accuracy(view(spark, sf_dir, "v_teacher").select(F.when(said.isNotNull(), F.col("question_id") % 2 == 0).alias("letter_matches_gold"), F.substring(said, 1, 1).alias("teacher_letter")))


@query("g15_arm_table", _with_runs("SELECT run, margin AS holdout, round(margin - 0.512, 4) AS holdout_delta, round(d + 0.5663, 4) AS medical, d AS d_medical, round(-d + 0.6675, 4) AS general, -d AS d_general FROM (SELECT run, margin, CASE WHEN run <> 'click' THEN n / 1000 END AS d FROM r) x"))
def g15(spark, sf_dir):
    d = F.when(F.col("run") != "click", F.col("n") / 1000)
    return sweeps.arm_table(_runs(spark, sf_dir).select("run", F.col("margin").alias("holdout"), d.alias("d_medical"), (-d).alias("d_general")), {"holdout": 0.512, "medical": 0.5663, "general": 0.6675})


@query("g26_answer_sheet", with_views("SELECT question_id, question, teacher_answer AS answer_a, answer AS answer_b, NULL::VARCHAR AS rating FROM v_mcq JOIN v_teacher USING (question_id)", "v_mcq", "v_teacher"))
def g26(spark, sf_dir):
    rows = view(spark, sf_dir, "v_mcq").join(view(spark, sf_dir, "v_teacher"), "question_id")
    return rows.select("question_id", "question", F.col("teacher_answer").alias("answer_a"), F.col("answer").alias("answer_b"), F.lit(None).cast("string").alias("rating"))


@query("h20_sweep_order", _with_runs("SELECT run, row_number() OVER (ORDER BY CASE WHEN length(run) = 5 THEN 1 ELSE 2 END, CASE WHEN length(run) = 5 THEN 'five' ELSE 'other' END, run)::INT AS place FROM r"))
def h20(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("run", F.when(F.length("run") == 5, "five").otherwise("other").alias("sweep"))
    return sweeps.in_sweep_order(runs, ["five"]).select("run", "place")


@query("c27_validate_corpus", "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS n_tokens, round(sum(b) / sum(l), 6) AS blank_line_rate FROM (SELECT text, len(string_split(text, chr(10))) AS l, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS b FROM documents) y")
def c27_corpus(spark, sf_dir):
    return validate.corpus(table(spark, sf_dir, "documents"))


@query("c27_validate_chat", "SELECT count(DISTINCT conv_id) AS n, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role = 'user') AS \"user\", count(*) FILTER (WHERE role = 'assistant') AS assistant FROM conversations")
def c27_chat(spark, sf_dir):
    return validate.conversations(chat.messages(table(spark, sf_dir, "conversations"))).select("n", *chat.ROLES)


@query("c27_validate_pairs", with_views(f"SELECT count(*) AS n, sum(({_REASON} IS NULL)::INT)::BIGINT AS complete, sum((abs(length(chosen) - length(rejected)) / greatest(length(chosen), length(rejected), 1) > 0.5)::INT)::BIGINT AS biased FROM v_pref", "v_pref"))
def c27_pairs(spark, sf_dir):
    return validate.pairs(view(spark, sf_dir, "v_pref"))


@query(
    "g23_ngram_overlap",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id % 2 AS side, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3)
SELECT count(*) AS n, round(avg((g IN (SELECT g FROM g WHERE side = 0))::INT), 6) AS shared FROM g WHERE side = 1""",
)
def g23(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return validate.ngram_overlap(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0"))
