"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
import pytest
from lmdata.llm import mixing, toxicity
from test_near_copies import kept as kept_near

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, clean = docs.columns, {r.doc_id for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    scores = toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    rejected = {r.doc_id for r in scores.filter("predicted = 1").collect()}
    kept = stage["toxicity"](spark, docs, DATA)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == clean - rejected
    lines = stage["line_dedup"](spark, kept, DATA)
    assert lines.columns == columns and lines.count() == kept.count() and lines.filter("n_chars <> length(text)").count() == 0
    near = stage["simhash"](spark, lines, DATA)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == kept_near([(r.doc_id, r.text) for r in lines.collect()])
    mix = stage["mixing"](spark, near, DATA)
    want = Counter({r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies})
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == want
    packed = stage["packing"](spark, mix, DATA)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == want


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, id long, size long, p int, key string"


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "mixing", "packing"])
def test_stage_takes_empty_and_awkward_tables(spark, name):
    """Nulls in any column, empty texts, repeated rows and clashing columns; and no row at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage(spark, spark.createDataFrame([], COLUMNS), DATA)
    assert empty.count() == 0
    rows = [(None,) * 10, (1, None, None, None, None, "n", 1, 2, 3, "k"), (1, None, None, None, None, "n", 1, 2, 3, "k"), (2, "", "en", "a", 0, None, None, None, None, None), (3, "one two three", "en", "a", 13, "n", 1, 2, 3, "k"), (None, "one two three four", "en", None, 18, "n", 1, 2, 3, "k")]
    out = stage(spark, spark.createDataFrame(rows, COLUMNS), DATA)
    found = out.collect()
    if name == "packing":
        assert len(found) == len(rows)
    else:
        assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        want = {"toxicity": 6, "line_dedup": 6, "simhash": 3}.get(name)
        assert want is None or len(found) == want


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {"pipeline", *(n for n in found if n.startswith("op"))} >= {"pipeline"} and [sum(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)] == [1] * 10
