"""Text and array functions on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from lmdata.functions import arrays as A
from lmdata.functions import text as T


def run(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(build(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_strip_takes_unicode_space(spark):
    assert run(spark, T.strip, ["　 a b\xa0\n", "", None, "\t"]) == ["a b", "", None, ""]
    assert run(spark, T.collapse, ["  a　\n b "]) == ["a b"]


@pytest.mark.parametrize(
    ("said", "letter"),
    [("D是", None), ("A\n解析", "A"), ("（B）对", "B"), ("　A.", "A"), ("选择C", "C"), ("答案是D", "D"), ("正确答案为：b", "B"), ("_A", None), ("A1", None), ("是A，B对", None), ("éA", None), ("", None), (None, None), ("so (c) it is", "C")],
)
def test_extract_answer(spark, said, letter):
    assert run(spark, T.extract_answer, [said]) == [letter]


def test_parse_score(spark):
    assert run(spark, T.parse_score, ["分数：4", "分数: 2", "5 很好", "理由\n3", "10", "无", None, ""]) == [4, 2, 5, 3, 1, None, None, None]


def test_parse_winner(spark):
    said = ["获胜者: A", "Winner: B", "获胜者：A", "获胜者: A和B", "获胜者: 平局", "no line", "x\n Winner: A \nWinner: B", "Winner: Tie"]
    assert run(spark, T.parse_winner, said) == ["A", "B", "tie", "tie", "tie", "tie", "A", "tie"]


def test_strip_think(spark):
    said = ["<think>a</think> x", "<think>a</think>y<think>b</think>z", "<think>a\nb</think>\nq", "r <think>open", "plain", ""]
    assert run(spark, T.strip_think, said) == ["x", "yz", "q", "r", "plain", ""]


def test_distill_completion(spark):
    got = run(spark, lambda c: T.distill_completion(c, F.lit("E")), ["A\nwhy", "答案是B", "none of it"])
    assert [tuple(r) for r in got] == [("A\nwhy", "A", "compliant"), ("B\n答案是B", "B", "recovered_teacher"), ("E\nnone of it", "E", "recovered_gold")]


def test_best_accuracy(spark):
    df = spark.sql("select explode(array(map('acc,none', '0.5', 'x', 'y'), map('acc_norm', '0.3', 'acc', '0.2'), map('my_acc_stderr', '1', 'my_acc', '0.7'), map('a', 'b'))) as m")
    assert [r[0] for r in df.select(T.best_accuracy(F.col("m"))).collect()] == [0.5, 0.2, 0.7, None]


def test_filled_template(spark):
    got = run(spark, lambda c: T.pairwise_prompt(c, F.lit("a"), F.lit("b")), ["q"])[0]
    assert "Question: q" in got and '{"winner"' in got and "{accuracy: N" in got


def kl(spark, t, s, temperature=1.0):
    return spark.range(1).select(A.restricted_kl(F.array(*map(F.lit, t)), F.array(*map(F.lit, s)), temperature)).first()[0]


def test_kl_properties(spark):
    assert kl(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]) == pytest.approx(0)
    assert kl(spark, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]) > 0
    assert kl(spark, [1000.0, 0.0], [0.0, 1000.0]) == pytest.approx(1000)
    total = spark.range(1).select(A.kd_total(F.lit(9.0), F.lit(2.0), 0.0, 3.0), A.kd_total(F.lit(9.0), F.lit(2.0), 1.0, 3.0)).first()
    assert tuple(total) == (18.0, 9.0)
    masked = spark.range(1).select(A.masked_mean(F.array(F.lit(2.0), F.lit(99.0)), F.array(F.lit(True), F.lit(False)))).first()[0]
    assert masked == 2.0


def test_losses_do_not_overflow(spark):
    r = spark.range(1).select(A.dpo_loss(F.lit(-1e5), 1.0), A.dpo_loss(F.lit(1e5), 1.0), A.ipo_loss(F.lit(1.0), 0.5), A.k3(F.lit(0.0))).first()
    assert tuple(r) == (1e5, 0.0, 0.0, 0.0)


def test_lr_schedule(spark):
    r = spark.range(41).select(A.warmup_cosine(F.col("id"), 10, 30, 1.0, 0.1).alias("x")).collect()
    assert r[0][0] == pytest.approx(1 / 11) and r[10][0] == pytest.approx(1.0) and r[20][0] == pytest.approx(0.1 + 0.45 * (1 + math.cos(math.pi / 2))) and r[40][0] == 0.1


def test_top_k_ties_keep_the_earlier_token(spark):
    assert [tuple(x) for x in spark.range(1).select(A.top_k(F.array(*map(F.lit, [1.0, 3.0, 3.0])), 2)).first()[0]] == [(1, 3.0), (2, 3.0)]
