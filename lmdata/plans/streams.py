"""Queries of token streams, mixing, packing and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.operators import tokens
from lmdata.plans.registry import query
from lmdata.plans.views import table, view, with_views

RATIOS = ("100-0", "70-30", "50-50", "30-70")
LENGTH, OVERLAP = 2048, 256
_TOTALS = "n AS (SELECT coalesce(sum(strlen(text)) FILTER (WHERE stream = 'domain'), 0)::BIGINT AS d, coalesce(sum(strlen(text)) FILTER (WHERE stream = 'general'), 0)::BIGINT AS g FROM v_stream)"


def _taken(ratio: str) -> str:
    dp, gp = tokens.ratio_parts(ratio)
    if gp == 0:
        return "SELECT d AS d, 0::BIGINT AS g FROM n"
    return f"SELECT CASE WHEN d * {gp} / {dp} <= g THEN d ELSE trunc(g * {dp} / {gp})::BIGINT END AS d, CASE WHEN d * {gp} / {dp} <= g THEN trunc(d * {gp} / {dp})::BIGINT ELSE g END AS g FROM n"


def _report(ratio: str) -> str:
    dp, gp = tokens.ratio_parts(ratio)
    return f"""SELECT '{ratio}' AS ratio, 'byte' AS tokenizer, {LENGTH} AS seq_length, {OVERLAP} AS overlap,
  greatest(0, floor((d + g - {LENGTH}) / {LENGTH - OVERLAP}) + 1)::BIGINT AS n_chunks, (d + g)::BIGINT AS total_tokens, d AS domain_tokens, g AS general_tokens,
  round(d / greatest(d + g, 1), 3) AS actual_domain_ratio, round({dp} / {dp + gp}, 3) AS target_domain_ratio FROM ({_taken(ratio)}) t{dp}"""


@query("g19_ratio_report", with_views(_TOTALS + " " + " UNION ALL ".join(_report(r) for r in RATIOS), "v_stream").replace("\nn AS", ",\nn AS", 1))
def g19(spark, sf_dir):
    v, out = view(spark, sf_dir, "v_stream"), None
    for r in RATIOS:
        one = tokens.ratio_report(v, r, LENGTH, OVERLAP)
        out = one if out is None else out.unionByName(one)
    return out


@query("f8_token_counts", "SELECT doc_id, strlen(text) AS n_tokens FROM documents")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.byte_count(F.col("text")).alias("n_tokens"))


@query("f6_byte_roundtrip", "SELECT doc_id, md5(text) AS digest, strlen(text) AS n FROM documents")
def f6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.byte_ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.md5(tokens.decode_bytes(F.col("ids"))).alias("digest"), F.size("ids").cast("long").alias("n"))


@query("f9_vocabulary", "SELECT c AS char, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) x WHERE c <> ''")
def f9(spark, sf_dir):
    return tokens.vocabulary(table(spark, sf_dir, "documents"))


def _chunks(ratio: str) -> str:
    """Chunks as digests of their bytes in hexadecimal digits."""
    step = LENGTH - OVERLAP
    return with_views(
        f"""{_TOTALS}, take AS ({_taken(ratio)}),
d AS (SELECT coalesce(string_agg(hex(encode(text)), '' ORDER BY seq), '') AS h FROM v_stream WHERE stream = 'domain'),
g AS (SELECT coalesce(string_agg(hex(encode(text)), '' ORDER BY seq), '') AS h FROM v_stream WHERE stream = 'general'),
s AS (SELECT substr(d.h, 1, 2 * take.d) || substr(g.h, 1, 2 * take.g) AS h, take.d + take.g AS n FROM d, g, take)
SELECT i AS chunk, md5(substr(h, 2 * {step} * i + 1, 2 * {LENGTH})) AS digest, {LENGTH} AS n_tokens
FROM (SELECT h, unnest(range(0, greatest(0, floor((n - {LENGTH}) / {step}) + 1)::BIGINT)) AS i FROM s) x""",
        "v_stream",
    ).replace("\nn AS", ",\nn AS", 1)


@query("h4_pack_chunks", _chunks("70-30"))
def h4(spark, sf_dir):
    chunks = tokens.pack(tokens.mixed_stream(view(spark, sf_dir, "v_stream"), "70-30"), LENGTH, OVERLAP)
    hexed = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i.cast("long")), 2, "0")), "")
    return chunks.select("chunk", F.md5(hexed).alias("digest"), "n_tokens")


@query(
    "h3b_mix_documents",
    with_views("""SELECT seq, stream FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn, count(*) OVER (PARTITION BY stream) AS n FROM v_stream) x
WHERE rn <= floor(CASE WHEN stream = 'domain' THEN n * 70 / 100 ELSE n * 30 / 100 END)""", "v_stream"),
)
def h3b(spark, sf_dir):
    return tokens.mix_documents(view(spark, sf_dir, "v_stream"), "70-30").select("seq", "stream")


@query("h5_head_split", with_views("SELECT seq, CASE WHEN row_number() OVER (ORDER BY seq) <= greatest(1, least(greatest(1, floor(count(*) OVER () * 0.1)), floor(count(*) OVER () / 2))) THEN 'valid' ELSE 'train' END AS split FROM v_stream", "v_stream"))
def h5(spark, sf_dir):
    return tokens.head_split(view(spark, sf_dir, "v_stream")).select("seq", "split")


@query("h6_token_split", with_views(_TOTALS + ", s AS (SELECT seq, strlen(text) AS n, coalesce(sum(strlen(text)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v_stream) SELECT seq, greatest(0, least(s.n, floor((d + g) * 0.9) - b))::BIGINT AS train_tokens FROM s, n", "v_stream").replace("\nn AS", ",\nn AS", 1))
def h6(spark, sf_dir):
    v = view(spark, sf_dir, "v_stream").select("seq", tokens.byte_count(F.col("text")).alias("n"))
    placed = tokens.ordered_sum(v, "seq", F.col("n"), "b").crossJoin(F.broadcast(v.agg(F.sum("n").alias("total"))))  # one row
    return placed.select("seq", F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("total") * 0.9) - F.col("b"))).cast("long").alias("train_tokens"))


@query("h11_hash_split", with_views("SELECT seq, CASE WHEN (('0x' || substr(md5('42:' || seq), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 < 0.1 THEN 'valid' ELSE 'train' END AS split FROM v_stream", "v_stream"))
def h11(spark, sf_dir):
    return tokens.hash_split(view(spark, sf_dir, "v_stream"), "seq").select("seq", "split")


@query("h12_block_windows")
def h12(spark, sf_dir):
    ids = tokens.byte_ids(F.col("text"))
    rows = view(spark, sf_dir, "v_stream").filter(F.octet_length("text") > 65).withColumn("ids", ids)
    start = F.pmod(F.xxhash64("seq"), (F.size("ids") - 65).cast("long")).cast("int")
    return rows.select("seq", tokens.window_pairs(F.col("ids"), start, 64).alias("w")).select("seq", F.size("w.x").alias("nx"), F.size("w.y").alias("ny"))
