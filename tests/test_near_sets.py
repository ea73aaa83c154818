import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lmdata import session
from lmdata.operators import dedup, near_sets

RATE, DATA = 0.8, "/root/testdata/sf0.001"


def near_texts(n, words=120, seed=3):
    """(texts, sets): groups of near copies, some beyond the threshold, and tokens that many texts share."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"t{i}x{k}" for k in range(words - 30)] + rng.sample([f"c{k}" for k in range(60)], 30)
        if i % 3 and texts:
            own = list(texts[rng.randrange(len(texts))])
            for _ in range(rng.choice([1, 5, 9, 14, 20])):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**9)}"
        texts.append(own)
    return [" ".join(t) for t in texts], [set(t) for t in texts]


def brute(sets):
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= RATE * len(sets[a] | sets[b])}


def staged_bytes(spark, before=()):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {p: p.stat().st_size for p in top.rglob("*.parquet") if p not in before}


def test_edges_write_sets_once_and_find_all(spark):
    texts, sets = near_texts(240)
    before = staged_bytes(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(2)
    got = {(r.a, r.b): r.jaccard for r in dedup.jaccard_edges(df, RATE).collect()}
    assert got == brute(sets)
    large = [n for n in staged_bytes(spark, before).values() if n > 20_000]
    assert sum(large) < 1.3 * 8 * sum(map(len, sets))  # nothing of the tokens but one table of sets is written


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "TILE_SETS", 4)
    monkeypatch.setattr(near_sets, "TILE_TOKENS", 500)
    texts, sets = near_texts(150, 40, seed=5)
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    assert {(r.a, r.b) for r in dedup.jaccard_edges(df, RATE).collect()} == set(brute(sets))


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_that_tie_are_null_or_no_numbers(spark, kind):
    rows = [(1, "a b c d"), (2, "a b"), (2, "c d"), (3, "a b c d e"), (None, "a b c d"), (4, None), (5, " ")]
    df = spark.createDataFrame(rows, "seq int, text string").selectExpr(f"cast(seq as {kind}) seq", "text")
    got = {(r.a, r.b): r.jaccard for r in dedup.jaccard_edges(df, RATE).collect()}
    one, two, three = (str(i) if kind == "string" else i for i in (1, 2, 3))
    assert got == {(one, two): 1.0, (one, three): 0.8, (two, three): 0.8}


def test_novel_is_near_no_existing_row(spark):
    text = [" ".join(f"{x}{i}" for i in range(20)) for x in "abcd"]
    new = spark.createDataFrame([(1, text[0]), (2, text[1]), (3, text[2]), (5, text[2] + " x"), (7, text[3])], "seq int, text string")
    existing = spark.createDataFrame([(4, text[0] + " y"), (6, text[1]), (7, text[1] + " z")], "seq int, text string")
    assert sorted(r.seq for r in dedup.novel(new, existing).collect()) == [3, 7]


def test_greedy_exact_writes_sets_once(spark):
    texts, sets = near_texts(240, seed=11)
    before = staged_bytes(spark)
    got = {r.seq for r in dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(2), RATE, "exact").collect()}
    kept: list[int] = []
    near = brute(sets)
    for i in range(len(sets)):
        if not any((a, i) in near for a in kept):
            kept.append(i)
    assert got == set(kept)
    large = [n for n in staged_bytes(spark, before).values() if n > 20_000]
    assert sum(large) < 1.3 * 8 * sum(map(len, sets))


def test_first_rows_in_place_are_the_same_and_move_few_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " a", "A", "a", *(f"Word {rng.randrange(70)} " for _ in range(200))]
    rows = [(rng.choice([None, i, i, i, 7]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, text string").repartition(5)
    for bits in (1 << 27, 1 << 3):  # a filter that is full, too
        monkeypatch.setattr(session, "MOST_BITS", bits)
        for order in ("seq", "name"):
            asked = df.withColumn("name", F.col("seq").cast("string"))
            want, got = dedup.exact_text(asked, order=order), dedup.exact_text_in_place(asked, order=order)
            key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
            assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_texts_of_the_exact_queries_stay_where_they_are(spark, monkeypatch):
    import __spark_entry__

    seen = []
    monkeypatch.setattr(dedup, "jaccard_edges", lambda df, *a: seen.append(df) or spark.createDataFrame([], "a long, b long, jaccard double"))
    for name in ("d4_jaccard_edges", "d4_greedy_exact"):
        __spark_entry__.queries()[name](spark, DATA)
    for df in seen:  # one branch of the union has texts that no exchange moves
        plan = df._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union" and "LeftSemi" not in plan.children().apply(0).toString()
    assert len(seen) == 2
