"""Queries of best-of-N selection and of datasets from answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions import text as T
from lmdata.operators import select
from lmdata.operators.ranks import hash_rank
from lmdata.plans.registry import query
from lmdata.plans.views import view, with_views

_WS = T.WS
_F1 = f"""upper(coalesce(nullif(regexp_extract(text, '{T.LEAD}', 1), ''), nullif(regexp_extract(text, '{T.EXPLICIT}', 1), ''), nullif(regexp_extract(text, '{T.ANY_LETTER}', 1), '')))"""
_LEAD = f"regexp_matches(text, '{T.LEAD}')"
_MCQ = f"{_LEAD} DESC, length(text) ASC, sample_idx ASC"
_TEACHER = f"coalesce(score, -1) DESC, correct DESC, {_MCQ}"


def _v(spark, sf_dir):
    return view(spark, sf_dir, "v_samples"), view(spark, sf_dir, "v_teacher")


@query("f1_extract_answer", with_views(f"SELECT question_id, sample_idx, {_F1} AS letter FROM v_samples", "v_samples"))
def f1(spark, sf_dir):
    return view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", T.extract_answer(F.col("text")).alias("letter"))


@query("f5_lead_letter", with_views(f"SELECT question_id, sample_idx, {_LEAD} AS lead FROM v_samples", "v_samples"))
def f5(spark, sf_dir):
    return view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", T.lead_letter(F.col("text")).alias("lead"))


@query("f2_parse_score", with_views("SELECT question_id, sample_idx, score FROM v_samples", "v_samples"))
def f2(spark, sf_dir):
    said = F.when(F.col("sample_idx") % 2 == 0, F.concat(F.lit("分数："), F.col("score").cast("string"))).otherwise(F.concat(F.lit("理由\n"), F.col("score").cast("string"), F.lit(" 好")))
    return view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", T.parse_score(said).alias("score"))


@query("f4_strip_think", with_views("SELECT question_id, sample_idx, letter AS text FROM v_samples", "v_samples"))
def f4(spark, sf_dir):
    said = F.concat(F.lit("<think>a\nb</think>\n "), F.col("letter"), F.lit(" <think>open "), F.col("text"))
    return view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", T.strip_think(said).alias("text"))


@query("e1_scored_samples", with_views("SELECT question_id, sample_idx, letter, score FROM v_samples", "v_samples"))
def e1(spark, sf_dir):
    s = view(spark, sf_dir, "v_samples")
    groups = s.withColumn("prompt", F.lit("")).groupBy("question_id", "gold", "prompt").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "text", "letter", "correct"))).alias("x"))
    groups = groups.select("question_id", "gold", "prompt", F.transform("x", lambda v: F.struct(v["text"].alias("text"), v["letter"].alias("letter"), v["correct"].alias("correct"))).alias("samples"))
    scores = select.latest_scores(s.select("question_id", "sample_idx", "score"), "sample_idx")
    return select.scored(select.exploded(groups), scores).select("question_id", F.col("sample_idx").cast("int"), "letter", "score")


def _arm(best: str) -> str:
    return with_views(
        f"""best AS ({best}), asked AS (SELECT DISTINCT question_id, gold FROM v_samples)
SELECT a.question_id, a.gold, coalesce(b.text, nullif(t.teacher_answer, '')) AS completion, CASE WHEN b.text IS NOT NULL THEN 'student' ELSE 'teacher_fallback' END AS source
FROM asked a LEFT JOIN best b USING (question_id) LEFT JOIN v_teacher t USING (question_id) WHERE coalesce(b.text, nullif(t.teacher_answer, '')) IS NOT NULL""",
        "v_samples", "v_teacher",
    ).replace("\nbest AS", ",\nbest AS", 1)


_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY %s) AS rn FROM %s) x WHERE rn = 1"
_POOL = """(SELECT * FROM (SELECT *, bool_or(score IS NOT NULL) OVER (PARTITION BY question_id) AS any_scored, bool_or(correct AND score IS NOT NULL) OVER (PARTITION BY question_id) AS cs FROM v_samples) y
 WHERE correct AND any_scored AND (NOT cs OR score IS NOT NULL)) p"""


@query("h1_select_rs_mcq", _arm(_BEST % (_MCQ, "(SELECT * FROM v_samples WHERE correct) c")))
def h1(spark, sf_dir):
    return select.rs_mcq(*_v(spark, sf_dir))


@query("h2_select_rs_teacher", _arm(_BEST % (_TEACHER, "(SELECT * FROM v_samples WHERE score IS NOT NULL) c")))
def h2(spark, sf_dir):
    return select.rs_teacher(*_v(spark, sf_dir))


@query("h2_select_rs_both", _arm(_BEST % (_TEACHER, _POOL)))
def h2_both(spark, sf_dir):
    return select.rs_both(*_v(spark, sf_dir))


@query(
    "h2b_onpolicy_pairs",
    with_views(f"""n AS (SELECT question_id, count(*) AS n, bool_or(score IS NOT NULL) AS any_scored, bool_or(NOT correct) AS any_wrong FROM v_samples GROUP BY question_id),
b AS ({_BEST % (_TEACHER, _POOL)}), s AS ({_BEST % (_TEACHER, "(SELECT * FROM v_samples WHERE score IS NOT NULL) c")}),
w AS ({_BEST % (f"score ASC, correct ASC, {_LEAD} ASC, length(text) DESC, sample_idx ASC", "(SELECT v.* FROM v_samples v JOIN n USING (question_id) WHERE score IS NOT NULL AND (NOT any_wrong OR NOT correct)) c")}),
j AS (SELECT n.*, CASE WHEN b.text IS NOT NULL THEN b.text ELSE s.text END AS chosen, CASE WHEN b.text IS NOT NULL THEN b.score ELSE s.score END AS chosen_score, w.text AS rejected, w.score AS rejected_score
      FROM n LEFT JOIN b USING (question_id) LEFT JOIN s USING (question_id) LEFT JOIN w USING (question_id))
SELECT question_id, chosen, rejected, chosen_score, rejected_score,
  CASE WHEN n < 2 OR NOT any_scored OR rejected IS NULL THEN 'skip_nodata' WHEN regexp_replace(chosen, '^{_WS}+|{_WS}+$', '', 'g') = regexp_replace(rejected, '^{_WS}+|{_WS}+$', '', 'g') THEN 'skip_same' ELSE 'pairs' END AS status FROM j""", "v_samples").replace("\nn AS", ",\nn AS", 1),
)
def h2b(spark, sf_dir):
    return select.onpolicy_pairs(view(spark, sf_dir, "v_samples"))


@query(
    "g12_pool_stats",
    with_views("""SELECT sum(n)::BIGINT AS samples, round(sum(c) / sum(n), 4) AS sample_acc, round(avg((c > 0)::INT), 4) AS coverage, round(avg(l), 4) AS mean_letters
FROM (SELECT question_id, count(*) AS n, sum(correct::INT) AS c, count(DISTINCT letter) + max((letter IS NULL)::INT) AS l FROM v_samples GROUP BY question_id) q""", "v_samples"),
)
def g12(spark, sf_dir):
    return select.pool_stats(view(spark, sf_dir, "v_samples"))


@query(
    "g11_judge_stats",
    with_views("""SELECT score, count(*) AS n, round(count(*) * 100.0 / (SELECT count(score) FROM v_samples), 2) AS pct, (SELECT round(avg(score), 3) FROM v_samples) AS mean_score,
  (SELECT round(count(score) / count(*), 4) FROM v_samples) AS parse_rate, max(count(*)) OVER () / (SELECT count(score) FROM v_samples) > 0.6 AS biased FROM v_samples WHERE score IS NOT NULL GROUP BY score""", "v_samples"),
)
def g11(spark, sf_dir):
    return select.judge_stats(view(spark, sf_dir, "v_samples"))


@query("g14_fallback_rate", "WITH arm AS (" + _arm(_BEST % (_MCQ, "(SELECT * FROM v_samples WHERE correct) c")) + ") SELECT count(*) AS n, round(avg((source = 'teacher_fallback')::INT), 4) AS fallback_rate FROM arm")
def g14(spark, sf_dir):
    return select.fallback_rate(select.rs_mcq(*_v(spark, sf_dir)))


@query("c11_single_answers", with_views("SELECT question_id, upper(trim(answer)) AS answer FROM v_mcq WHERE question <> '' AND length(trim(answer)) = 1 AND upper(trim(answer)) IN ('A', 'B', 'C', 'D', 'E')", "v_mcq"))
def c11(spark, sf_dir):
    return select.single_answers(view(spark, sf_dir, "v_mcq")).select("question_id", "answer")


@query("c12_mcq_prompt", with_views("SELECT question_id, question || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || '答案：' AS prompt FROM v_mcq", "v_mcq"))
def c12(spark, sf_dir):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("A", "yes"), ("B", "no"))])
    return view(spark, sf_dir, "v_mcq").select("question_id", T.mcq_prompt(F.col("question"), options).alias("prompt"))


@query("c13_real_completion", with_views(f"SELECT question_id, upper(answer) || chr(10) || regexp_replace(question, '^{_WS}+|{_WS}+$', '', 'g') AS completion FROM v_mcq", "v_mcq"))
def c13(spark, sf_dir):
    return view(spark, sf_dir, "v_mcq").select("question_id", T.real_completion(F.col("answer"), F.col("question")).alias("completion"))


@query("c14_teacher_message", with_views(f"SELECT question_id, '{T.TEACHER_PREFIX}' || question AS message FROM v_mcq", "v_mcq"))
def c14(spark, sf_dir):
    return view(spark, sf_dir, "v_mcq").select("question_id", T.teacher_message(F.col("question")).alias("message"))


_ALL = f"""SELECT question_id, sample_idx, gold, text, {_F1} AS letter, {_LEAD} AS lead FROM v_samples"""


@query("c15_distill_completion", with_views(f"""SELECT question_id, sample_idx, CASE WHEN lead THEN t ELSE coalesce(letter, gold) || chr(10) || t END AS completion, coalesce(letter, gold) AS letter,
  CASE WHEN lead THEN 'compliant' WHEN letter IS NOT NULL THEN 'recovered_teacher' ELSE 'recovered_gold' END AS status
FROM (SELECT *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM ({_ALL}) a) x""", "v_samples"))  # fmt: skip
def c15(spark, sf_dir):
    return view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", T.distill_completion(F.col("text"), F.col("gold")).alias("d")).select("question_id", "sample_idx", "d.*")


_PICKED = "(SELECT question_id, answer, question FROM v_mcq WHERE length(answer) = 1)"


@query("e3_distilled", with_views(f"SELECT p.question_id, answer AS gold, teacher_answer AS completion, substr(teacher_answer, 1, 1) AS letter, 'compliant' AS status FROM {_PICKED} p JOIN v_teacher t USING (question_id) WHERE teacher_answer <> ''", "v_mcq", "v_teacher"))
def e3(spark, sf_dir):
    return select.distilled(select.single_answers(view(spark, sf_dir, "v_mcq")), view(spark, sf_dir, "v_teacher"))


@query(
    "h10_mixed_sources",
    with_views(f"""SELECT p.question_id, CASE WHEN rk <= n // 2 AND t.c IS NOT NULL THEN t.c ELSE answer END AS completion, CASE WHEN rk <= n // 2 AND t.c IS NOT NULL THEN 'distill' ELSE 'real' END AS origin
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || question_id)) AS rk, count(*) OVER () AS n FROM {_PICKED} q) p
LEFT JOIN (SELECT question_id, nullif(teacher_answer, '') AS c FROM v_teacher) t USING (question_id)""", "v_mcq", "v_teacher"),
)
def h10(spark, sf_dir):
    return select.mixed_sources(select.single_answers(view(spark, sf_dir, "v_mcq")), view(spark, sf_dir, "v_teacher"))


@query("h9_shuffled_take", with_views(f"SELECT rk - 1 AS place, question_id FROM (SELECT question_id, row_number() OVER (ORDER BY md5('42:' || question_id)) AS rk FROM {_PICKED} q) x WHERE rk <= 20", "v_mcq"))
def h9(spark, sf_dir):
    ranked = hash_rank(select.single_answers(view(spark, sf_dir, "v_mcq")), F.col("question_id"), 42, "rank")
    return ranked.filter("rank <= 20").select((F.col("rank") - 1).cast("long").alias("place"), "question_id")


@query("e2_teacher_lookup", with_views("SELECT question_id, gold, nullif(teacher_answer, '') AS teacher_answer FROM (SELECT DISTINCT question_id, gold FROM v_samples) q LEFT JOIN v_teacher USING (question_id)", "v_samples", "v_teacher"))
def e2(spark, sf_dir):
    s, t = _v(spark, sf_dir)
    return s.select("question_id", "gold").distinct().join(t, "question_id", "left").withColumn("teacher_answer", F.nullif("teacher_answer", F.lit("")))


@query("e6_resume", with_views("SELECT question_id, sample_idx FROM v_samples WHERE score IS NULL", "v_samples"))
def e6(spark, sf_dir):
    s = view(spark, sf_dir, "v_samples").select("question_id", "sample_idx", "score")
    return select.todo(s, s.filter("score IS NOT NULL"), ["question_id", "sample_idx"]).select("question_id", "sample_idx")


@query("e10_semi", with_views("SELECT question_id FROM v_mcq WHERE question_id IN (SELECT question_id FROM v_teacher)", "v_mcq", "v_teacher"))
def e10(spark, sf_dir):
    return view(spark, sf_dir, "v_mcq").join(view(spark, sf_dir, "v_teacher"), "question_id", "left_semi").select("question_id")


@query("f3_winner")
def f3(spark, sf_dir):
    said = F.concat(F.lit("分析\n获胜者: "), F.col("first_verdict"))
    return view(spark, sf_dir, "v_verdicts").select("question_id", T.parse_winner(said).alias("winner"))


@query("f25_prompts")
def f25(spark, sf_dir):
    q = F.col("question")
    return view(spark, sf_dir, "v_mcq").select("question_id", T.judge_prompt(q, F.col("answer")).alias("judge"), T.pairwise_prompt(q, F.lit("a"), F.col("answer")).alias("pairwise"), T.evolve_instruction(F.lit("reasoning")).alias("evolve"))
