"""Readers, writers and streaming on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lmdata import schemas
from lmdata.sources import readers, sinks
from lmdata.streaming import ingest


def test_text_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second\r\n\n 　\nthird  \n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("first " * 20, encoding="utf-8")
    (tmp_path / "c.md").write_text("not read")
    df = readers.numbered(readers.text_lines(spark, str(tmp_path)), ["path", "pos"])
    assert [r.text for r in df.orderBy("seq").collect()] == [("first " * 20).strip(), "second", "third"]
    assert readers.text_lines(spark, str(tmp_path), 50).count() == 1
    assert readers.text_lines(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("content", ['[{"text": "a"},\n {"body": "b"}]', '{"text": "a"}\nnot json\n\n{"body": "b"}\n'])
def test_json_array_and_lines(spark, tmp_path, content):
    (tmp_path / "x.json").write_text(content)
    rows = readers.json_records(spark, str(tmp_path / "x.json")).select("pos", readers.record_text(F.col("value")).alias("t")).orderBy("pos")
    assert [r.t for r in rows.collect()] == ["a", "b"]


def test_record_text(spark):
    cases = [('"plain"', "plain"), ('{"text": " ", "raw": "r"}', "r"), ('{"title": "T", "n": 1}', "T"), ('{"x": "ab", "y": "cd", "z": "e"}', "ab"), ('{"n": 1}', ""), ('{"content": "c", "text": "t"}', "t")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert [(r[0], r[1]) for r in df.select(readers.record_text(F.col("v")), "want").collect()] == [(w, w) for _, w in cases]


def test_collect_filters_before_the_limit(spark):
    df = spark.createDataFrame([(i, json.dumps({"text": "x" * (60 if i % 2 else 5)})) for i in range(10)], "pos int, value string")
    assert [r.pos for r in readers.collect_texts(df, 3).collect()] == [1, 3, 5]


def test_strict_and_tolerant_records(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "chosen": "b", "rejected": "c"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "p.jsonl"), schemas.PREFERENCE).collect()
    assert readers.tolerant_jsonl(spark, str(tmp_path / "p.jsonl"), schemas.PREFERENCE).filter("prompt IS NOT NULL").count() == 1
    assert readers.optional_json(spark, str(tmp_path / "none.json"), schemas.PREFERENCE).count() == 0


def test_runs_logs_and_scores(spark, tmp_path):
    for run in ("b", "a"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "loss_log.csv").write_text("step,epoch,loss,rewards/chosen,rewards/rejected,rewards/margins,rewards/accuracies,learning_rate\n1,0.1,0.5,,,0.7,,\n2,0.2,0.4,,,,,\n")
    (tmp_path / "c").mkdir()
    assert [r.run for r in readers.runs(spark, str(tmp_path)).collect()] == ["a", "b"]
    log = readers.training_log(spark, str(tmp_path / "a" / "loss_log.csv"), schemas.DPO_LOG)
    assert [r["rewards/margins"] for r in log.orderBy("step").collect()] == [0.7, None]
    with pytest.raises(FileNotFoundError):
        readers.latest_scores(spark, str(tmp_path))
    (tmp_path / "scores_x.json").write_text('{"t": 0.5}')
    assert [(r.task, r.acc) for r in readers.latest_scores(spark, str(tmp_path)).collect()] == [("t", 0.5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n b"), (2, None)], "k int, text string")
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert {r.value for r in spark.read.text(str(tmp_path / "lines")).collect()} >= {"a b"}
    assert sinks.append_new(df, str(tmp_path / "t"), ["k"]).count() == 2
    more = spark.createDataFrame([(2, "x"), (3, "y")], "k int, text string")
    sinks.append_new(more, str(tmp_path / "t"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
    assert sinks.write_once(df, str(tmp_path / "o")) and not sinks.write_once(more, str(tmp_path / "o"))
    sinks.write_log(df, str(tmp_path / "log"), ["k", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).columns == ["k", "missing"]
    assert sinks.markdown(df.filter("k = 2")) == "| k | text |\n| --- | --- |\n| 2 | — |"
    sinks.write_report(df.filter("k = 1"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["k"] == 1


def test_stream_equals_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "1.txt").write_text("Iter 10: Train loss 2.5, It/sec 1\nIter 10: Val loss 2.1\nnoise\n")
    stream = ingest.losses(spark, str(src))
    ingest.append(stream, str(out), str(ck), ["iter", "kind"]).awaitTermination()
    (src / "2.txt").write_text("Iter 10: Train loss 2.5\nIter 20: Train loss 2.0\n")
    ingest.append(ingest.losses(spark, str(src)), str(out), str(ck), ["iter", "kind"]).awaitTermination()
    assert sorted((r.iter, r.kind, r.loss) for r in spark.read.parquet(str(out)).collect()) == [(10, "train", 2.5), (10, "val", 2.1), (20, "train", 2.0)]
