"""Byte tokens, mixing two streams to an exact ratio, and packing into chunks of one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.functions.text import ratio_parts
from lmdata.operators.ranks import hash_rank, ordered_sum


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as numbers; the empty text has none."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def decode_bytes(ids: Column) -> Column:
    """The text of byte ids; what is no UTF-8 becomes U+FFFD."""
    packed = F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    return F.make_valid_utf8(packed.cast("string"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(char, id): the different characters by code point, numbered from 0."""
    chars = df.select(F.explode(F.split(F.col(text), "")).alias("char")).filter("char != ''").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) - 1).cast("long").alias("id"))


def take_by_ratio(n_domain: Column, n_general: Column, ratio: str) -> tuple[Column, Column]:
    """How many tokens of either stream a ratio takes; what runs out first decides."""
    dp, gp = ratio_parts(ratio)
    if gp == 0:
        return n_domain, F.lit(0).cast("long")
    if dp == 0:
        raise ValueError("a ratio needs a domain part")
    need = n_domain * gp / dp
    enough = need <= n_general
    return F.when(enough, n_domain).otherwise((n_general * dp / gp).cast("long")), F.when(enough, need.cast("long")).otherwise(n_general)


def ratio_report(df: DataFrame, ratio: str, length: int, overlap: int = 0, tokenizer: str = "byte") -> DataFrame:
    """What mixing (stream, text) to a ratio and packing it gives, in one row."""
    check(length, overlap)
    dp, gp = ratio_parts(ratio)
    n = df.agg(F.coalesce(F.sum(F.when(F.col("stream") == "domain", byte_count(F.col("text")))), F.lit(0)).alias("d"), F.coalesce(F.sum(F.when(F.col("stream") == "general", byte_count(F.col("text")))), F.lit(0)).alias("g"))
    d, g = take_by_ratio(F.col("d"), F.col("g"), ratio)
    n = n.select(d.alias("domain_tokens"), g.alias("general_tokens")).withColumn("total_tokens", F.col("domain_tokens") + F.col("general_tokens"))
    return n.select(
        F.lit(ratio).alias("ratio"), F.lit(tokenizer).alias("tokenizer"), F.lit(length).alias("seq_length"), F.lit(overlap).alias("overlap"),
        chunk_count(F.col("total_tokens"), length, overlap).alias("n_chunks"), "total_tokens", "domain_tokens", "general_tokens",
        F.round(F.col("domain_tokens") / F.greatest("total_tokens", F.lit(1)), 3).alias("actual_domain_ratio"), F.round(F.lit(dp / (dp + gp)), 3).alias("target_domain_ratio"),
    )


def check(length: int, overlap: int) -> None:
    if length <= 0 or not 0 <= overlap < length:
        raise ValueError("length > 0 and 0 <= overlap < length are needed")


def chunk_count(total: Column, length: int, overlap: int = 0) -> Column:
    return F.greatest(F.lit(0), F.floor((total - length) / (length - overlap)) + 1).cast("long")


def mixed_stream(df: DataFrame, ratio: str) -> DataFrame:
    """(seq, stream, text) to the documents the ratio takes, with their place: (seq, ids, at), at counting tokens from 0."""
    sized = df.select("seq", "stream", "text", byte_count(F.col("text")).alias("n")).filter("n > 0")
    totals = sized.agg(F.coalesce(F.sum(F.when(F.col("stream") == "domain", F.col("n"))), F.lit(0)).alias("d"), F.coalesce(F.sum(F.when(F.col("stream") == "general", F.col("n"))), F.lit(0)).alias("g"))
    d, g = take_by_ratio(F.col("d"), F.col("g"), ratio)
    row = totals.select(d.alias("_d"), g.alias("_g"))
    placed = ordered_sum(sized, "seq", F.col("n"), "_before", ["stream"]).crossJoin(F.broadcast(row))  # one row
    take = F.when(F.col("stream") == "domain", F.col("_d")).otherwise(F.col("_g"))
    left = F.least(F.col("n"), take - F.col("_before"))
    start = F.col("_before") + F.when(F.col("stream") == "domain", F.lit(0)).otherwise(F.col("_d"))
    return placed.withColumn("_left", left).filter("_left > 0").select("seq", F.slice(byte_ids(F.col("text")), F.lit(1), F.col("_left").cast("int")).alias("ids"), start.alias("at"), (F.col("_d") + F.col("_g")).alias("total"))


def pack(stream: DataFrame, length: int, overlap: int = 0) -> DataFrame:
    """(ids, at, total) to (chunk, ids, n_tokens).  Documents follow each other without a separator; the tail is dropped."""
    check(length, overlap)
    step = length - overlap
    n = F.size("ids")
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - length + 1) / step)).cast("long")
    last = F.least(F.floor((F.col("at") + n - 1) / step), chunk_count(F.col("total"), length, overlap) - 1).cast("long")
    parts = stream.withColumn("_f", first).withColumn("_l", last).filter("_f <= _l").withColumn("chunk", F.explode(F.sequence("_f", "_l")))
    begin = F.col("chunk") * step
    lo, hi = F.greatest(begin - F.col("at"), F.lit(0)), F.least(begin + length - F.col("at"), n)
    parts = parts.select("chunk", F.col("at").alias("_at"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_ids"))
    chunks = parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_p"))  # at most `length` parts
    return chunks.select("chunk", F.flatten(F.transform("_p", lambda p: p["_ids"])).alias("ids")).withColumn("n_tokens", F.size("ids"))


def mix_documents(df: DataFrame, ratio: str) -> DataFrame:
    """The first documents of either stream: a ratio by document count."""
    dp, gp = ratio_parts(ratio)
    ranked = ordered_sum(df, "seq", F.lit(1), "_row", ["stream"])
    counts = df.groupBy(F.col("stream").alias("_stream")).agg(F.count(F.lit(1)).alias("_n"))
    both = ranked.join(F.broadcast(counts), F.col("stream") == F.col("_stream"))  # a row per stream
    part = F.when(F.col("stream") == "domain", F.col("_n") * dp / (dp + gp)).otherwise(F.col("_n") * gp / (dp + gp))
    return both.filter(F.col("_row") < F.floor(part)).select(*df.columns)


def head_split(df: DataFrame, share: float = 0.1, least: int = 1, order: str = "seq") -> DataFrame:
    """Adds split: the first rows are valid, as many as the share asks, at least ``least``, at most half."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    n_valid = F.greatest(F.lit(1), F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * share)), F.floor(F.col("_n") / 2)))
    ranked = ordered_sum(df, order, F.lit(1), "_row").crossJoin(F.broadcast(total))  # one row
    return ranked.select(*df.columns, F.when(F.col("_row") < n_valid, "valid").otherwise("train").alias("split"))


def hash_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split by a seeded hash: each row's is its own, whatever else the table holds."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(h < share, "valid").otherwise("train"))


def holdout(df: DataFrame, key: str, n: int, seed: int = 123) -> DataFrame:
    """Adds part: ``n`` rows by a seeded shuffle are holdout, the rest train."""
    return hash_rank(df, F.col(key), seed, "_rank").withColumn("part", F.when(F.col("_rank") <= n, "holdout").otherwise("train")).drop("_rank")


def sample(df: DataFrame, key: str, n: int, seed: int = 123) -> DataFrame:
    return hash_rank(df, F.col(key), seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def window_pairs(ids: Column, start: Column, size: int) -> Column:
    """struct(x, y): a block of ids and the same shifted by one."""
    return F.struct(F.slice(ids, start + 1, F.lit(size)).alias("x"), F.slice(ids, start + 2, F.lit(size)).alias("y"))
