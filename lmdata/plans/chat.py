"""Queries of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.operators import chat
from lmdata.operators.tokens import byte_ids
from lmdata.plans.registry import query
from lmdata.plans.views import table

def _m():
    return F.col("messages")


def _messages(spark, sf_dir):
    return chat.messages(table(spark, sf_dir, "conversations"))


_AGG = """c AS (
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS na, sum(length(text)) AS total,
       avg(length(text)) FILTER (WHERE role = 'assistant') AS mean, min(length(text)) FILTER (WHERE role = 'assistant') AS least,
       arg_min(role, turn) AS first_role,
       arg_min(CASE WHEN length(text) < 20 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long' END, turn)
         FILTER (WHERE role = 'assistant' AND (length(text) < 20 OR length(text) > 2000)) AS wrong,
       bool_and(role IN ('system', 'user', 'assistant') AND text IS NOT NULL) AS formed
FROM conversations GROUP BY conv_id)"""


@query("c7_sft_reason", f"WITH {_AGG} SELECT conv_id, CASE WHEN n < 2 THEN 'too_few_turns' WHEN wrong IS NOT NULL THEN wrong WHEN first_role NOT IN ('system', 'user') THEN 'bad_first_role' END AS reason FROM c")
def c7(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", chat.sft_reason(_m()).alias("reason"))


@query("c8_grades", f"WITH {_AGG} SELECT conv_id, CASE WHEN na = 0 THEN 'C' WHEN mean > 200 AND n >= 3 THEN 'A' WHEN mean > 100 THEN 'B' ELSE 'C' END AS grade FROM c")
def c8(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", chat.grade(_m()).alias("grade"))


@query("c9_format", f"WITH {_AGG} SELECT conv_id, formed AS ok FROM c")
def c9(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", chat.well_formed(_m()).alias("ok"))


@query("c10_quality", f"WITH {_AGG} SELECT conv_id FROM c WHERE total >= 20 AND na > 0 AND least >= 10")
def c10(spark, sf_dir):
    return _messages(spark, sf_dir).filter(chat.good_enough(_m())).select("conv_id")


_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query("f17_chat_template", f"SELECT conv_id, string_agg({_TURN}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def f17(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", chat.render(_m()).alias("rendered"))


_AT = f"""t AS (SELECT conv_id, turn, role, strlen({_TURN}) AS size, coalesce(sum(strlen({_TURN})) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  sum(strlen({_TURN})) OVER (PARTITION BY conv_id) AS total FROM conversations)"""


@query("f18_mask_all", f"WITH {_AT} SELECT conv_id, (off + 21)::INT AS start, (off + size - 11)::INT AS \"end\" FROM t WHERE role = 'assistant'")
def f18(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.explode(chat.loss_spans(_m(), "all")).alias("s")).select("conv_id", "s.start", "s.end")


@query(
    "f19_mask_last",
    f"""WITH {_AT}, l AS (SELECT conv_id, max(total) AS total, max(off) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id)
SELECT conv_id, coalesce(last + 22, 0)::INT AS start, total::INT AS "end" FROM l""",
)
def f19(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.explode(chat.loss_spans(_m(), "last")).alias("s")).select("conv_id", "s.start", "s.end")


@query("f20_mask_next", f"WITH {_AT} SELECT conv_id, (off + 22)::INT AS start, coalesce(lead(off) OVER (PARTITION BY conv_id ORDER BY turn), total)::INT AS \"end\" FROM t WHERE role = 'assistant'")
def f20(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.explode(chat.loss_spans(_m(), "next")).alias("s")).select("conv_id", "s.start", "s.end")


@query(
    "g24_loss_share",
    f"""WITH {_AT}, k AS (SELECT conv_id, max(total) AS total, coalesce(sum(size - 32) FILTER (WHERE role = 'assistant'), 0) AS onn, count(*) FILTER (WHERE role = 'assistant') AS na FROM t GROUP BY conv_id)
SELECT CASE WHEN na > 1 THEN 'multi' ELSE 'single' END AS kind, sum(total)::BIGINT AS total, sum(onn)::BIGINT AS contributing, sum(total - onn)::BIGINT AS masked, round(sum(onn) * 100.0 / sum(total), 2) AS contributing_pct FROM k GROUP BY 1""",
)
def g24(spark, sf_dir):
    return chat.loss_share(_messages(spark, sf_dir))


@query("f18_labels")
def f18_labels(spark, sf_dir):
    ids = byte_ids(chat.render(_m()))
    return _messages(spark, sf_dir).withColumn("spans", chat.loss_spans(_m(), "all")).select("conv_id", F.size(F.filter(chat.labels(ids, F.col("spans")), lambda x: x != -100)).alias("counted"))
