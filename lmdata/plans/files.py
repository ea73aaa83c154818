"""Queries that go through the readers, writers and the streaming path."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.operators import clean, sweeps
from lmdata.plans.registry import query
from lmdata.plans.views import table, view
from lmdata.session import scratch
from lmdata.sources import readers, sinks
from lmdata.streaming import ingest


@query("a4_record_text", "SELECT page_id, url AS text FROM pages")
def a4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    value = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.lit(" ").alias("text"), F.col("url").alias("content")))).when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.lit("a").alias("x"), F.col("url").alias("y"), F.lit(7).alias("z")))).otherwise(F.to_json(F.struct(F.col("url").alias("body"))))
    return pages.select("page_id", readers.record_text(value).alias("text"))


@query("a17_dirty_corpus")
def a17(spark, sf_dir):
    return clean.report(clean.clean(readers.dirty_texts(spark, 500), clean.domain("general"), "exact")[1])


@query("a18_template_corpus")
def a18(spark, sf_dir):
    domain, general = readers.corpus(spark, "synthetic")
    return domain.unionByName(general)


@query("a3_json_roundtrip", "SELECT item_id, text FROM benchmark")
def a3(spark, sf_dir):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    return readers.json_records(spark, path).select(F.from_json("value", "item_id bigint, text string").alias("r")).select("r.*")


@query("a1_text_folder", "SELECT item_id AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def a1(spark, sf_dir):
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(" : "), "text").alias("text"))
    sinks.write_lines(rows, path)
    lines = readers.text_lines(spark, path)
    return lines.select(F.substring_index("text", " : ", 1).cast("long").alias("pos"), F.regexp_replace("text", "^[0-9]+ : ", "").alias("text"))


@query("a2_long_lines", "SELECT count(*) AS n FROM benchmark WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 50")
def a2(spark, sf_dir):
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "benchmark"), path)
    return readers.text_lines(spark, path, readers.MIN_CORPUS_LENGTH).agg(F.count(F.lit(1)).alias("n"))


@query("b1_jsonl_roundtrip", "SELECT doc_id, text FROM documents")
def b1(spark, sf_dir):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return readers.jsonl(spark, path, "doc_id bigint, text string")


@query("b5_resumed_append", "SELECT event_id, event_type FROM events")
def b5(spark, sf_dir):
    path, events = scratch(spark, "appended"), table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append_new(events.filter("event_id % 3 = 0"), path, ["event_id"])
    sinks.append_new(events, path, ["event_id"])
    return spark.read.schema(events.schema).parquet(path)


@query("b7_written_split", "SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def b7(spark, sf_dir):
    path = scratch(spark, "split")
    sinks.write_split(view(spark, sf_dir, "v_split").select("seq", "split"), path)
    return spark.read.schema("seq bigint, split string").json(path)


@query("b8_written_log", "SELECT event_id AS step, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value, 4) END AS loss, NULL::DOUBLE AS margin FROM events")
def b8(spark, sf_dir):
    path = scratch(spark, "log")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 != 0, F.round("value", 4)).alias("loss"), F.lit("x").alias("extra"))
    sinks.write_log(rows, path, ["step", "loss", "margin"])
    return readers.training_log(spark, path, "step bigint, loss double, margin double")


@query("b6_written_report", "SELECT count(*) AS n, max(doc_id) AS last FROM documents")
def b6(spark, sf_dir):
    path = scratch(spark, "report")
    sinks.write_report(table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), path)
    return readers.optional_json(spark, path, "n bigint, last bigint")


@query("b14_written_once", "SELECT 1::BIGINT AS written, 0::BIGINT AS again, count(*) AS n FROM labels")
def b14(spark, sf_dir):
    path, labels = scratch(spark, "once"), table(spark, sf_dir, "labels")
    first, again = sinks.write_once(labels, path), sinks.write_once(labels.limit(0), path)
    return spark.read.schema(labels.schema).parquet(path).agg(F.lit(int(first)).cast("long").alias("written"), F.lit(int(again)).cast("long").alias("again"), F.count(F.lit(1)).alias("n"))



@query("g9_train_minutes")
def g9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("---- TRAIN "), "event_type")).otherwise(F.concat(F.lit("✓ TRAIN "), "event_type", F.lit(" OK"))))
    return sweeps.train_minutes(e.select(F.col("event_id").alias("pos"), line.alias("line")))


@query("f15_loss_lines", "SELECT event_id::INT AS iter, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'val' END AS kind, round(value, 4) AS loss FROM events")
def f15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ": Train loss ").otherwise(": Val loss "), F.round("value", 4).cast("string"), F.lit(", It/sec 5.1"))
    return sweeps.loss_lines(e.select(line.alias("line")))


@query("i1_event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i1(spark, sf_dir):
    return ingest.window_sums(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
