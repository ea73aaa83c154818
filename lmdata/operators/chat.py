"""Conversations: validation, grading, the chat template, and which of its bytes a loss counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.functions.arrays import let

ROLES = ("system", "user", "assistant")


def messages(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, messages)."""
    turns = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def _assistant(m: Column) -> Column:
    return F.filter(m, lambda x: x["role"] == "assistant")


def sft_reason(m: Column) -> Column:
    """Why a conversation is no training example, null where it is: the first answer that is too short or long decides."""
    wrong = F.get(F.filter(F.transform(_assistant(m), lambda x: F.when(F.length(x["content"]) < 20, "too_short").when(F.length(x["content"]) > 2000, "too_long")), lambda r: r.isNotNull()), F.lit(0))
    first = F.get(m, F.lit(0))["role"]
    return F.when(F.size(m) < 2, "too_few_turns").when(wrong.isNotNull(), wrong).when(~F.coalesce(first.isin("system", "user"), F.lit(False)), "bad_first_role")


def grade(m: Column) -> Column:
    """A, B or C by the mean length of the answers and the number of turns."""
    own = _assistant(m)
    mean = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"])) / F.size(own)
    return F.when(F.size(own) == 0, "C").when((mean > 200) & (F.size(m) >= 3), "A").when(mean > 100, "B").otherwise("C")


def well_formed(m: Column) -> Column:
    each = lambda x: x["role"].isNotNull() & x["content"].isNotNull() & x["role"].isin(*ROLES)
    return F.coalesce(F.forall(m, each), F.lit(False)) & m.isNotNull()


def good_enough(m: Column) -> Column:
    total = F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"]))
    return (total >= 20) & (F.size(_assistant(m)) > 0) & F.forall(_assistant(m), lambda x: F.length(x["content"]) >= 10)


def turn_text(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def render(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: turn_text(x["role"], x["content"])), "")


def loss_spans(m: Column, mode: str = "all") -> Column:
    """[(start, end)] in bytes of the rendered text that a loss counts.

    all: each answer with the line end before it, up to its end mark.  last: from the last answer to the end of the text;
    everything if there is none.  next: a known defect kept for comparison, from each answer to the next answer's mark, so
    that what the user says between them counts too.
    """
    if mode not in ("all", "last", "next"):
        raise ValueError("mode: all, last or next")
    head, tail = F.octet_length(F.lit("<|im_start|>assistant")), F.octet_length(F.lit("<|im_end|>\n"))
    span = lambda lo, hi: F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    add = lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("lo"), (s["at"] + x["n"]).alias("hi"), x["on"].alias("on"))).alias("out"))
    turns = F.transform(m, lambda x: F.struct(F.octet_length(turn_text(x["role"], x["content"])).alias("n"), (x["role"] == "assistant").alias("on")))
    placed = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int,on:boolean>>").alias("out")), add)

    def of(p: Column) -> Column:
        answers = F.filter(p["out"], lambda t: t["on"])
        if mode == "all":
            return F.transform(answers, lambda t: span(t["lo"] + head, t["hi"] - tail))
        if mode == "last":
            return F.array(F.when(F.size(answers) > 0, span(F.element_at(answers, -1)["lo"] + head + 1, p["at"])).otherwise(span(F.lit(0), p["at"])))
        return let(answers, lambda a: F.transform(a, lambda t, k: span(t["lo"] + head + 1, F.coalesce(F.get(a, k + 1)["lo"], p["at"]))))

    return F.when(F.size(m) > 0, let(placed, of)).otherwise(none)


def labels(ids: Column, spans: Column) -> Column:
    """Ids where a span covers them, else -100."""
    covers = lambda s, i: (i >= s["start"]) & (i < s["end"])
    return let(F.struct(ids.alias("ids"), spans.alias("spans")), lambda r: F.transform(r["ids"], lambda x, i: F.when(F.exists(r["spans"], lambda s: covers(s, i)), x).otherwise(F.lit(-100))))


def loss_share(df: DataFrame, mode: str = "all") -> DataFrame:
    """Bytes, those a loss counts, and their share, for dialogs of one answer and of more."""
    rows = df.select(F.when(F.size(_assistant(F.col("messages"))) > 1, "multi").otherwise("single").alias("kind"), F.octet_length(render(F.col("messages"))).alias("n"), F.aggregate(loss_spans(F.col("messages"), mode), F.lit(0), lambda s, x: s + x["end"] - x["start"]).alias("on"))
    agg = rows.groupBy("kind").agg(F.sum("n").alias("total"), F.sum("on").alias("contributing"))
    return agg.withColumn("masked", F.col("total") - F.col("contributing")).withColumn("contributing_pct", F.round(F.col("contributing") * 100.0 / F.col("total"), 2))
