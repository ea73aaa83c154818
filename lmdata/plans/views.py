"""Views that bind the tables to the operators' inputs.  The text runs in Spark SQL and in other engines alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "events", "benchmark", "labels", "embeddings", "pages")
VIEWS = {
    "v_stream": "SELECT doc_id AS seq, CASE WHEN lang = 'en' THEN 'domain' ELSE 'general' END AS stream, text FROM documents",
    "v_pref": """
WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rd FROM conversations WHERE role = 'assistant')
SELECT u.conv_id AS pair_id, u.text AS prompt, c.text AS chosen, r.text AS rejected
FROM u JOIN a c ON c.conv_id = u.conv_id AND c.rn = 1 JOIN a r ON r.conv_id = u.conv_id AND r.rd = 1 WHERE u.rn = 1""",
    "v_samples": """
SELECT question_id, sample_idx, gold, letter,
       CASE WHEN event_id % 3 = 0 THEN concat('答案：', letter) ELSE concat(letter, chr(10), props) END AS text,
       letter = gold AS correct, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS INT) END AS score
FROM (SELECT event_id, props, user_id + 1000000 * CAST(floor((rn - 1) / 8) AS BIGINT) AS question_id, CAST((rn - 1) % 8 AS INT) AS sample_idx,
             substr('ABCDE', CAST(user_id % 5 AS INT) + 1, 1) AS gold,
             CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'E' END AS letter
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) n) e""",
    "v_teacher": """
SELECT DISTINCT question_id,
       CASE WHEN question_id % 4 = 0 THEN '' ELSE concat(substr('ABCDE', CAST(question_id % 5 AS INT) + 1, 1), chr(10), 'teacher') END AS teacher_answer
FROM (SELECT user_id + 1000000 * CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 8) AS BIGINT) AS question_id FROM events) e""",
    "v_mcq": """
SELECT item_id AS question_id, text AS question,
       CASE WHEN item_id % 10 = 0 THEN 'AC' ELSE substr('ABCDE', CAST(item_id % 5 AS INT) + 1, 1) END AS answer FROM benchmark""",
    "v_scores": """
SELECT CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN 'base' ELSE 'tuned' END AS model, d.source AS task,
       CASE WHEN length(d.source) = 4 THEN 'domain' ELSE 'general' END AS task_group, round(avg(CAST(l.quality AS DOUBLE)), 6) AS acc
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
GROUP BY CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN 'base' ELSE 'tuned' END, d.source""",
    "v_runlog": """
SELECT event_type AS run, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS step,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS margin FROM events""",
    "v_logits": "SELECT t.vec_id AS pos, t.embedding AS teacher, s.embedding AS student FROM embeddings t JOIN embeddings s ON s.vec_id = t.vec_id + 1",
    "v_verdicts": """
SELECT event_id AS question_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS first_verdict,
       CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS second_verdict FROM events""",
    "v_raters": "SELECT doc_id, quality AS r1, toxic AS r2 FROM labels",
    "v_split": "SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, text FROM documents",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, used = VIEWS[name], {}
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            used[t] = table(spark, sf_dir, t)
            sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str, *names: str) -> str:
    """SQL that reads the views, with them before it."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
