"""Operators against plain restatements, and on the cases that are easily got wrong."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lmdata.operators import chat, clean, dedup, evals, prefs, select, sweeps, tokens
from lmdata.operators.ranks import hash_rank, ordered_sum


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_keep_first_is_by_order_and_null_safe(spark):
    df = frame(spark, [(3, "A "), (1, "a"), (2, None), (4, None), (5, "b")], "seq int, text string")
    assert sorted(r.seq for r in dedup.exact_text(df).collect()) == [1, 2, 5]


def test_greedy_keeps_the_ends_of_a_chain(spark):
    nodes, edges = frame(spark, [(i,) for i in range(4)], "seq int"), frame(spark, [(0, 1), (1, 2)], "a int, b int")
    assert sorted(r.seq for r in dedup.greedy(nodes, edges).collect()) == [0, 2, 3]


def test_greedy_equals_one_pass(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)})
    kept = []
    for n in range(60):
        if not any((k, n) in set(edges) for k in kept):
            kept.append(n)
    got = dedup.greedy(frame(spark, [(i,) for i in range(60)], "seq int"), frame(spark, edges, "a int, b int"))
    assert sorted(r.seq for r in got.collect()) == kept


def test_greedy_buckets_equals_one_pass(spark):
    rng = random.Random(6)
    rows = [(d, b, rng.randrange(25)) for d in range(60) for b in range(2)]
    of = {d: {(b, v) for x, b, v in rows if x == d} for d in range(60)}
    kept = []
    for d in range(60):
        if not any(of[d] & of[k] for k in kept):
            kept.append(d)
    got = dedup.greedy_buckets(frame(spark, [(i,) for i in range(60)], "seq int"), frame(spark, rows, "doc int, band int, value int"))
    assert sorted(r.seq for r in got.collect()) == kept


def test_lsh_drops_copies(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = frame(spark, [(1, text), (2, text + " x"), (3, "something else entirely here"), (4, text)], "seq int, text string")
    assert sorted(r.seq for r in dedup.near_dedup(df, 0.8, "lsh").collect())[0:2] == [1, 3]


def test_jaccard_edges_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    sets = {i: set(t.split()) for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = dedup.jaccard_edges(frame(spark, docs, "seq int, text string"), 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_clean_counts_each_step(spark):
    body = "word " * 40
    rows = [(1, f"<p>{body}</p>"), (2, body), (3, "short"), (4, "x" * 60), (5, None)]
    left, steps = clean.clean(frame(spark, rows, "seq int, text string"), near=None)
    assert [r.seq for r in left.collect()] == [1]
    r = clean.report(steps).first()
    assert (r.input, r.output, r.breakdown) == (5, 1, {"boilerplate": 2, "length": 1, "exact_dedup": 1})
    assert clean.domain("nobody knows") == clean.DOMAINS["medical"]


@pytest.mark.parametrize("xs", [[], [3.0], [1.0, 2.0], [2.0, 2.0, 2.0, 5.0, 9.5]])
def test_summary(spark, xs):
    got = prefs.summary(frame(spark, [(x,) for x in xs], "x double"), {"m": F.col("x")}).collect()
    if not xs:
        assert got == []
        return
    k = 0.95 * (len(xs) - 1)
    p95 = sorted(xs)[int(k)] + (sorted(xs)[min(int(k) + 1, len(xs) - 1)] - sorted(xs)[int(k)]) * (k - int(k))
    r = got[0]
    assert (r.n, r.mean, r.median, r.stdev) == (len(xs), pytest.approx(statistics.mean(xs), abs=0.006), statistics.median(xs), pytest.approx(statistics.stdev(xs) if len(xs) > 1 else 0.0, abs=0.006))
    assert r.p95 == pytest.approx(p95, abs=0.006)


def test_drop_reason_is_the_first_that_applies(spark):
    long = "a" * 20001
    rows = [(None, "b", "c"), (" ", "b", "c"), ("p" * 10, "same text here", " same text here"), ("p", "some text here", "other text here"), ("p" * 10, long, "other text here"), ("p" * 10, "some text here", "other text here")]
    got = [r[0] for r in frame(spark, rows, "prompt string, chosen string, rejected string").select(prefs.drop_reason()).collect()]
    assert got == ["missing_fields", "empty_field", "chosen_eq_rejected", "too_short", "too_long", None]


def test_noise_flips_exactly(spark):
    df = frame(spark, [(i, "p", f"c{i}", f"r{i}") for i in range(11)], "pair_id int, prompt string, chosen string, rejected string")
    rows = prefs.inject_noise(df, 0.5, 1).collect()
    assert sum(r.flipped for r in rows) == 6  # 5.5 goes to the even neighbour
    assert all(r.chosen == (f"r{r.pair_id}" if r.flipped else f"c{r.pair_id}") for r in rows)


@pytest.mark.parametrize(("n", "length", "overlap"), [(5, 8, 0), (8, 8, 0), (9, 8, 0), (40, 8, 0), (40, 8, 1), (40, 8, 7), (100, 16, 5)])
def test_pack_equals_slices(spark, n, length, overlap):
    docs = [(i, "general" if i % 2 else "domain", "x" * (i * 3 % 7)) for i in range(1, 60)]
    docs = [(i, "domain", chr(97 + i % 26) * (i % 5)) for i in range(1, 200)]
    stream = "".join(t for _, _, t in docs)[:n]
    cut, left = [], n
    for i, s, t in docs:
        cut.append((i, s, t[:left]))
        left = max(0, left - len(t))
    got = tokens.pack(tokens.mixed_stream(frame(spark, cut, "seq int, stream string, text string"), "100-0"), length, overlap)
    want = [list(stream.encode()[s : s + length]) for s in range(0, n - length + 1, length - overlap)]
    assert [r.ids for r in got.orderBy("chunk").collect()] == want


def test_pack_rejects_bad_lengths(spark):
    for length, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            tokens.check(length, overlap)
    with pytest.raises(ValueError):
        tokens.take_by_ratio(F.lit(1), F.lit(1), "0-100")


@pytest.mark.parametrize(("d", "g", "ratio", "want"), [(100, 1000, "70-30", (100, 42)), (1000, 30, "70-30", (70, 30)), (10, 10, "100-0", (10, 0)), (10, 10, "50-50", (10, 10)), (9, 100, "30-70", (9, 21))])
def test_take_by_ratio(spark, d, g, ratio, want):
    a, b = tokens.take_by_ratio(F.lit(d).cast("long"), F.lit(g).cast("long"), ratio)
    assert tuple(spark.range(1).select(a, b).first()) == want


def test_byte_ids_round_trip(spark):
    r = frame(spark, [("é漢a",), ("",), (None,)], "t string").select(tokens.byte_ids(F.col("t")).alias("ids")).withColumn("back", tokens.decode_bytes(F.col("ids"))).collect()
    assert (r[0].ids, r[0].back) == (list("é漢a".encode()), "é漢a") and r[1].ids == [] and r[2].ids is None


def test_ordered_sum_and_hash_rank(spark):
    df = spark.range(10_000).select(F.col("id").alias("seq"))
    assert ordered_sum(df, "seq", F.lit(2), "s").filter("s <> 2 * seq").count() == 0
    assert hash_rank(df, F.col("seq"), 1).agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (10_000, 1, 10_000)


def samples(spark, rows):
    return frame(spark, rows, "question_id int, sample_idx int, gold string, letter string, text string, correct boolean, score int")


def test_best_of_n_ties_and_fallback(spark):
    s = samples(spark, [
        (1, 0, "A", "A", "so A it is", True, None), (1, 1, "A", "A", "A", True, None), (1, 2, "A", "A", "A", True, 5),
        (2, 0, "B", "C", "C", False, 3), (3, 0, "B", "C", "C", False, None), (4, 0, "B", "B", "B x", True, 2), (4, 1, "B", "C", "C", False, 5),
    ])
    t = frame(spark, [(2, "B\nt"), (3, "")], "question_id int, teacher_answer string")
    by = lambda df: {r.question_id: (r.completion, r.source) for r in df.collect()}
    assert by(select.rs_mcq(s, t)) == {1: ("A", "student"), 2: ("B\nt", "teacher_fallback"), 4: ("B x", "student")}
    assert by(select.rs_teacher(s, t)) == {1: ("A", "student"), 2: ("C", "student"), 4: ("C", "student")}
    assert by(select.rs_both(s, t)) == {1: ("A", "student"), 2: ("B\nt", "teacher_fallback"), 4: ("B x", "student")}
    pairs = {r.question_id: (r.chosen, r.rejected, r.status) for r in select.onpolicy_pairs(s).collect()}
    assert pairs[4] == ("B x", "C", "pairs") and pairs[2][2] == "skip_nodata" and pairs[1][2] == "skip_same"


def test_pairs_skip_wrong_but_unscored(spark):
    s = samples(spark, [(1, 0, "A", "A", "A", True, 4), (1, 1, "A", "B", "B", False, None)])
    assert select.onpolicy_pairs(s).first().status == "skip_nodata"


def test_train_minutes(spark):
    lines = ["[23:59:00] ---- TRAIN a ----", "[00:01:00] ✓ TRAIN a OK", "[01:00:00] ---- TRAIN b ----", "[01:10:00] ---- TRAIN b ----", "[01:30:00] ✗ TRAIN b FAIL", "[02:00:00] ---- TRAIN b ----", "[02:06:00] ✓ TRAIN b OK", "[03:00:00] ✓ TRAIN c OK", "noise", "[04:00:00] ---- TRAIN d ----"]
    got = sweeps.train_minutes(frame(spark, list(enumerate(lines)), "pos int, line string"))
    assert {r.run: r.minutes for r in got.collect()} == {"a": 2.0, "b": 6.0}


def test_classify(spark):
    rows = [("beta_0.3", None, None, 0.3, "control"), ("x", 0.1, None, 0.3, "noise"), ("ipo", 0.0, "ipo", 0.3, "ipo"), ("beta_10", None, None, 10.0, "extreme-beta"), ("beta_0.1", None, None, 0.1, "beta-scan"), ("beta_q", None, None, None, "other")]
    df = frame(spark, rows, "run string, noise double, loss string, beta double, want string")
    assert df.select(sweeps.classify(F.col("run"), F.col("noise"), F.col("loss"), F.col("beta")).alias("got"), "want").filter("got <> want").count() == 0


def test_win_rates_have_empty_buckets(spark):
    df = frame(spark, [(1.0, 10, 0.5, 10), (1.0, 0, 2.0, 3)], "chosen_sum double, chosen_n int, rejected_sum double, rejected_n int")
    got = {r.bucket: (r.n, r.sum_wr) for r in evals.win_rates(df).collect()}
    assert got == {"all": (1, 1.0), "matched": (1, 1.0), "mid": (0, None), "skewed": (0, None)}


def test_advantages_scale(spark):
    df = frame(spark, [(1, 1.0), (1, 0.0), (2, 1.0)], "question_id int, reward double")
    assert [round(r.advantage, 3) for r in evals.advantages(df, scale="none").orderBy("question_id", "reward").collect()] == [-0.5, 0.5, 0.0]
    assert evals.advantages(df).filter("question_id = 2").first().advantage == 0.0


def test_published_figures(spark):
    gains = frame(spark, [("base", "domain", "t", 0.5663), ("tuned", "domain", "t", 0.5613)], "model string, task_group string, task string, acc double")
    assert evals.deltas(evals.group_means(gains), "base").first().delta == -0.005
    assert spark.range(1).select(sweeps.drift(F.lit(13.855), F.lit(0.1)), sweeps.drift(F.lit(1.0), F.lit(0.0))).first()[:] == (138.55, None)


def test_masks(spark):
    m = [("user", "hi"), ("assistant", "yo"), ("user", "x"), ("assistant", "é")]
    df = spark.createDataFrame([(m,), ([("user", "a")],), ([],)], "messages array<struct<role:string,content:string>>")
    text = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in m).encode()
    spans = {k: [[(s.start, s.end) for s in r[0]] for r in df.select(chat.loss_spans(F.col("messages"), k)).collect()] for k in ("all", "last", "next")}
    assert [text[a:b] for a, b in spans["all"][0]] == [b"\nyo", "\né".encode()]
    assert [text[a:b] for a, b in spans["last"][0]] == ["é<|im_end|>\n".encode()]
    assert text[slice(*spans["next"][0][0])].startswith(b"yo<|im_end|>\n<|im_start|>user")
    assert spans["last"][1] == [(0, len(b"<|im_start|>user\na<|im_end|>\n"))] and spans["all"][1] == [] and spans["all"][2] == [] and spans["next"][2] == []
