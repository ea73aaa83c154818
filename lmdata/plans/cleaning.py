"""Queries of cleaning and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lmdata.functions.text import WS, collapse, strip
from lmdata.operators import clean, dedup
from lmdata.plans.registry import query
from lmdata.plans.views import table, view, with_views

_STRIP = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
_MARKUP = _STRIP % r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_KEY = "md5(lower(" + _STRIP % "text" + "))"
_FIRST = f"""
long AS (SELECT * FROM v_stream WHERE length(text) BETWEEN 100 AND 50000),
firsts AS (SELECT seq, stream, text, row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) AS rn FROM long)"""


@query("c1_boilerplate", f"SELECT page_id, t AS text FROM (SELECT page_id, {_MARKUP} AS t FROM pages) x WHERE length(t) > 50")
def c1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return clean.remove_boilerplate(pages)


@query("c2_length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 100 AND 50000")
def c2(spark, sf_dir):
    return clean.length_filter(table(spark, sf_dir, "documents")).select("doc_id", "n_chars")


@query("d1_exact_dedup", with_views("", "v_stream").rstrip() + "," + _FIRST + " SELECT seq, stream FROM firsts WHERE rn = 1")
def d1(spark, sf_dir):
    return dedup.exact_text(clean.length_filter(view(spark, sf_dir, "v_stream"))).select("seq", "stream")


@query(
    "c4_clean_stats",
    with_views("", "v_stream").rstrip() + "," + _FIRST + """,
counts AS (SELECT (SELECT count(*) FROM v_stream) AS i, (SELECT count(*) FROM v_stream WHERE length(text) > 50) AS b,
                  (SELECT count(*) FROM long) AS l, (SELECT count(*) FROM firsts WHERE rn = 1) AS o)
SELECT i AS input, o AS output, round((i - o) / greatest(i, 1), 3) AS drop_rate, i - b AS boilerplate, b - l AS length, l - o AS exact_dedup FROM counts""",
)
def c4(spark, sf_dir):
    _, steps = clean.clean(view(spark, sf_dir, "v_stream"), near=None)
    return clean.report(steps).select("input", "output", "drop_rate", *[F.col("breakdown")[s].alias(s) for s in ("boilerplate", "length", "exact_dedup")])


_SETS = f"""
docs AS (SELECT seq, text FROM firsts WHERE rn = 1),
sets AS (SELECT DISTINCT seq, t FROM (SELECT seq, unnest(string_split_regex({_STRIP % "text"}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{3000}}]+')) AS t FROM docs) x WHERE t <> ''),
sizes AS (SELECT seq, count(*) AS n FROM sets GROUP BY seq),
common AS (SELECT a.seq AS a, b.seq AS b, count(*) AS c FROM sets a JOIN sets b ON a.t = b.t AND a.seq < b.seq GROUP BY a.seq, b.seq)"""


@query(
    "d4_jaccard_edges",
    with_views("", "v_stream").rstrip() + "," + _FIRST + "," + _SETS + """
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM common JOIN sizes x ON x.seq = a JOIN sizes y ON y.seq = b WHERE c / (x.n + y.n - c) >= 0.8""",
)
def d4_edges(spark, sf_dir):
    docs = dedup.exact_text_in_place(clean.length_filter(view(spark, sf_dir, "v_stream")))
    return dedup.jaccard_edges(docs, 0.8).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "d4_greedy_exact",
    with_views("", "v_stream").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + _FIRST + "," + _SETS + """,
edges AS (SELECT a, b FROM common JOIN sizes x ON x.seq = a JOIN sizes y ON y.seq = b WHERE c / (x.n + y.n - c) >= 0.8),
nodes AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k, list_sort(list(a) FILTER (WHERE a IS NOT NULL)) AS earlier
          FROM (SELECT DISTINCT a AS seq FROM edges UNION SELECT DISTINCT b FROM edges) n LEFT JOIN edges ON b = seq GROUP BY seq),
pass AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
         UNION ALL
         SELECT p.k + 1, CASE WHEN list_has_any(coalesce(n.earlier, []), p.kept) THEN p.kept ELSE list_append(p.kept, n.seq) END
         FROM pass p JOIN nodes n ON n.k = p.k + 1),
kept AS (SELECT unnest(kept) AS seq FROM (SELECT kept FROM pass ORDER BY k DESC LIMIT 1) q)
SELECT seq FROM docs WHERE seq NOT IN (SELECT seq FROM nodes) OR seq IN (SELECT seq FROM kept)""",
)
def d4_greedy(spark, sf_dir):
    docs = dedup.exact_text_in_place(clean.length_filter(view(spark, sf_dir, "v_stream")))
    return dedup.near_dedup(docs, 0.8, "exact").select("seq")


@query("d4_minhash_lsh")
def d4_lsh(spark, sf_dir):
    docs = dedup.exact_text(clean.length_filter(view(spark, sf_dir, "v_stream")))
    return dedup.near_dedup(docs, 0.8, "lsh").select("seq")


@query("c3_clean_pipeline")
def c3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("text"))
    return clean.clean(pages, clean.domain("general"))[0]


@query("d2_pair_dedup", with_views("SELECT pair_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(prompt || chr(31) || chosen || chr(31) || rejected) ORDER BY pair_id) AS rn FROM v_pref) x WHERE rn = 1", "v_pref"))
def d2(spark, sf_dir):
    return dedup.exact_pairs(view(spark, sf_dir, "v_pref")).select("pair_id")


@query("d3_record_dedup", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id) AS rn FROM events) x WHERE rn = 1")
def d3(spark, sf_dir):
    return dedup.exact_records(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id").select("event_id")


_D5 = "v_split x WHERE split = 'train' AND " + _STRIP % "text" + " %s (SELECT " + _STRIP % "text" + " FROM v_split WHERE split = 'test')"


@query("d5_decontaminate", with_views("SELECT seq FROM " + _D5 % "NOT IN", "v_split"))
def d5(spark, sf_dir):
    s = view(spark, sf_dir, "v_split")
    return dedup.decontaminate(s.filter("split = 'train'"), s.filter("split = 'test'"), "text").select("seq")


@query("d5_excluded", with_views("SELECT count(*) AS excluded FROM " + _D5 % "IN", "v_split"))
def d5_excluded(spark, sf_dir):
    s = view(spark, sf_dir, "v_split")
    return dedup.contaminated(s.filter("split = 'train'"), s.filter("split = 'test'"), "text").agg(F.count(F.lit(1)).alias("excluded"))


@query("d6_union_streams", with_views("SELECT row_number() OVER (ORDER BY CASE WHEN stream = 'domain' THEN 0 ELSE 1 END, seq) - 1 AS place, seq FROM v_stream", "v_stream"))
def d6(spark, sf_dir):
    from lmdata.operators.ranks import ordered_sum

    v = view(spark, sf_dir, "v_stream")
    domain, general = v.filter("stream = 'domain'"), v.filter("stream <> 'domain'")
    n = domain.agg(F.count(F.lit(1)).alias("n"))
    a, b = ordered_sum(domain, "seq", F.lit(1), "place"), ordered_sum(general, "seq", F.lit(1), "place")
    return a.select(F.col("place").cast("long"), "seq").unionByName(b.crossJoin(F.broadcast(n)).select((F.col("place") + F.col("n")).cast("long").alias("place"), "seq"))


@query("b4_collapsed_lines", f"SELECT doc_id, regexp_replace({_STRIP % 'text'}, '{WS}+', ' ', 'g') AS line FROM documents")
def b4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("line"))


@query("d9_novel", None)
def d9(spark, sf_dir):
    s = view(spark, sf_dir, "v_split")
    return dedup.novel(s.filter("split = 'test'"), s.filter("split = 'train'")).select("seq")


@query("c28_keywords", "SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT)::INT AS hits FROM documents")
def c28(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.keyword_hits(F.col("text"), ["license", "token"]).cast("int").alias("hits"))


@query("f10_strip", f"SELECT doc_id, {_STRIP % 'text'} AS text FROM documents")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strip(F.col("text")).alias("text"))
