"""Cases that once went wrong, and the recall of the bands."""

import pytest
from pyspark.sql import functions as F

from lmdata.functions import text as T
from lmdata.operators import clean, dedup, ranks, tokens


def test_null_fields_of_pairs_differ(spark):
    rows = [(1, "p", None, "x"), (2, "p", "x", None), (3, "p", "x", None), (4, None, None, None), (5, None, None, None), (6, "p", "", "x")]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")
    assert sorted(r.pair_id for r in dedup.exact_pairs(df).collect()) == [1, 2, 4, 6]


def test_invalid_bytes_decode_like_the_library(spark):
    cases = [b"abc", b"\xff\xfe", b"a\xc3", b"\xe6\xbc", b"\xf0\x9f\x98", b"\xed\xa0\x80z", b"\xc0\xaf", "é漢😀".encode(), b"", b"x\x80y\xe6\xbc\xa2\xf0"]
    df = spark.createDataFrame([(i, list(c)) for i, c in enumerate(cases)], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", tokens.decode_bytes(F.col("ids")).alias("t")).collect()}
    assert got == {i: c.decode("utf-8", errors="replace") for i, c in enumerate(cases)}


def test_ordered_sum_keeps_null_orders(spark):
    df = spark.createDataFrame([(5, 1), (None, 2), (9000, 4)], "seq long, v int")
    assert {r.seq: r.s for r in ranks.ordered_sum(df, "seq", F.col("v"), "s").collect()} == {5: 0, 9000: 1, None: 5}


def test_bands_follow_the_threshold():
    assert dedup.bands(0.8) == (9, 13) and dedup.bands(0.85) == (8, 16)
    assert dedup.bands(0.5)[1] < dedup.bands(0.8)[1] < dedup.bands(0.95)[1]
    with pytest.raises(ValueError):
        dedup.bands(1.5)


def test_pairwise_prompt_as_published(spark):
    said = spark.range(1).select(T.pairwise_prompt(F.lit("q"), F.lit("a"), F.lit("b"))).first()[0]
    assert said.startswith("Compare these two answers for the same question.\n\nQuestion: q\n\nAnswer A: a\nAnswer B: b\n\nWhich answer is better?")


def test_band_recall_against_exact(spark):
    docs = dedup.exact_text(clean.length_filter(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS seq", "text")))
    buckets = dedup.band_buckets(docs, 0.8)
    found = buckets.alias("x").join(buckets.alias("y"), ["band", "value"]).filter("x.doc < y.doc").select("x.doc", "y.doc").distinct()
    found = {tuple(r) for r in found.collect()}
    edges = {(r.a, r.b) for r in dedup.jaccard_edges(docs, 0.8).collect()}
    assert edges and len(edges & found) >= 0.6 * len(edges)
    print("recall of bands", len(edges & found) / len(edges))
