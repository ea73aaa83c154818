"""Arithmetic on arrays and losses given log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x.cast("double") / temperature)
    topped = let(scaled, lambda a: F.struct(a.alias("a"), F.array_max(a).alias("top")))
    normed = let(topped, lambda t: F.struct(t["a"].alias("a"), (t["top"] + F.log(F.aggregate(t["a"], F.lit(0.0), lambda s, x: s + F.exp(x - t["top"])))).alias("norm")))
    return let(normed, lambda n: F.transform(n["a"], lambda x: x - n["norm"]))


def restricted_kl(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """KL of the teacher from the student over the tokens that are there."""
    return _sum(F.zip_with(log_softmax(teacher, temperature), log_softmax(student, temperature), lambda t, s: F.exp(t) * (t - s)))


def kd_total(ce: Column, kl: Column, alpha: float, temperature: float) -> Column:
    return alpha * ce + (1 - alpha) * temperature**2 * kl


def masked_mean(values: Column, mask: Column) -> Column:
    return _sum(F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0))) / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def top_k(logits: Column, k: int) -> Column:
    """[(token, logit)] of the k largest; the earlier token first where they tie."""
    ranked = F.array_sort(F.transform(logits, lambda v, i: F.struct((-v).alias("neg"), i.alias("token"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["token"].alias("token"), (-x["neg"]).alias("logit")))


def logp_sum(logps: Column, start: Column) -> Column:
    return _sum(F.slice(logps, start + 1, F.size(logps)))


def logp_mean(logps: Column, start: Column) -> Column:
    return logp_sum(logps, start) / F.greatest(F.size(logps) - start, F.lit(1))


def dpo_loss(delta: Column, beta: float) -> Column:
    """-log sigmoid(beta * delta), without overflow for either sign."""
    z = delta * beta
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def ipo_loss(delta: Column, beta: float) -> Column:
    return F.pow(delta - 1 / (2 * beta), F.lit(2.0))


def k3(delta: Column) -> Column:
    return F.exp(delta) - delta - 1


def warmup_cosine(step: Column, warmup: int, total: int, top: float, low: float) -> Column:
    """Linear up to ``warmup`` steps, then half a cosine down to ``low`` at ``total``, which stays."""
    share = (step - warmup) / F.lit(float(max(1, total - warmup)))
    down = F.lit(low) + (F.cos(F.pi() * F.least(share, F.lit(1.0))) + 1) * (0.5 * (top - low))
    return F.when(step < warmup, (step + 1) * top / F.lit(float(warmup + 1))).when(step > total, F.lit(low)).otherwise(down)


def warmup_constant(step: Column, warmup: int, top: float) -> Column:
    return F.when(step < warmup, (step + 1) * top / F.lit(float(warmup))).otherwise(F.lit(top))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def padded(ids: Column, length: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def at_completion(values: Column, prompt_len: Column, length: int) -> Column:
    """Teacher values put where the sequence predicts them: value t at place prompt_len - 1 + t; zero elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get(values, i - prompt_len + 1), F.lit(0.0)))
