"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window is a shortest run of consecutive lines with at least ``least_words`` words: one starts and one ends at each
line.  The position of the smallest line hash of a window is a fingerprint, so two documents that share a run that long also
share a fingerprint in it.  Positions are joined on the fingerprints that occur more than once, and each match is extended
line by line both ways, as far as a window that holds the position can reach.  If what is common has ``least_words`` words, the later
of the two runs is deleted.  Longer runs go piece by piece: each of their windows has its fingerprint inside.

Positions with equal surroundings are one: the first stands for all, and the others lose the whole of it.  So a passage that
very many documents repeat costs a row each.  A fingerprint that has more than SURROUNDINGS different ones, such as a short
line that is everywhere, is made longer: it is joined on the hash of its whole window instead, which pairs each with the first alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.llm.common import NULL_ID, boxed, documents, joined_with, staged
from lmdata.llm.mixing import words

LEAST_WORDS = 50
#: A fingerprint's positions are compared all with all, up to this many different surroundings.
SURROUNDINGS = 16


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """A row per line with words: its place, size and hashes, how far windows around it reach, and the windows that start and end there.

    ``ahead`` and ``back`` are (s, e, p, mark): first and last line of the window, and place and hash of its smallest line.
    """
    at = F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    rows = docs.select("id", "body", at).withColumn("n", words(F.col("line"))).filter("n > 0")
    rows = rows.select("id", "body", "pos", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))
    doc = Window.partitionBy("id", "body")
    by_pos = doc.orderBy("pos")
    rows = rows.withColumn("_twice", F.lag("pos").over(by_pos)).filter("_twice IS NULL OR _twice <> pos").drop("_twice")  # a repeated row
    rows = rows.withColumns({"i": F.row_number().over(by_pos) - 1, "upto": F.sum("n").over(by_pos.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("before", F.col("upto") - F.col("n"))
    ahead, ahead_of = (doc.orderBy("before").rangeBetween(*r) for r in ((0, least_words - 1), (1 - least_words, 0)))
    back, back_of = (doc.orderBy("upto").rangeBetween(*r) for r in ((1 - least_words, 0), (0, least_words - 1)))
    least = F.min(F.struct("h1", "i"))
    rows = rows.withColumns({
        "_an": F.sum("n").over(ahead), "_ae": F.max("i").over(ahead), "_am": least.over(ahead), "_bn": F.sum("n").over(back), "_bs": F.min("i").over(back), "_bm": least.over(back),
        "lo": F.least(F.min("i").over(ahead_of), F.min("i").over(back)), "hi": F.greatest(F.max("i").over(ahead), F.max("i").over(back_of)),
    })
    window = lambda s, e, m: F.struct(F.col(s).alias("s"), F.col(e).alias("e"), F.col(f"{m}.i").alias("p"), F.col(f"{m}.h1").alias("mark"))
    return rows.select(
        "id", "body", "i", "pos", "n", "h1", "h2", "lo", "hi",
        F.when(F.col("_an") >= least_words, window("i", "_ae", "_am")).alias("ahead"), F.when(F.col("_bn") >= least_words, window("_bs", "i", "_bm")).alias("back"),
    )


def _windows(lines: DataFrame) -> DataFrame:
    """Rows (id, body, s, e, p, mark)."""
    both = lines.select("id", "body", F.explode(F.array("ahead", "back")).alias("w")).filter("w IS NOT NULL")
    return both.select("id", "body", "w.s", "w.e", "w.p", "w.mark")


def _surroundings(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fingerprints (id, body, p, mark) to (id, body, p, mark, c, run, k1, k2): the lines around, p's place among them, and their hashes."""
    line = F.struct("i", "pos", "n", "h1", "h2", "lo", "hi")
    whole = lines.groupBy("id", "body").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    asked = seeds.groupBy("id", "body").agg(F.collect_list(F.struct("p", "mark")).alias("ps"))

    def one(x: Column) -> Column:
        own = F.get("ls", x["p"])
        run = F.slice("ls", own["lo"] + 1, own["hi"] - own["lo"] + 1)
        return F.struct(x["p"].alias("p"), x["mark"].alias("mark"), (x["p"] - own["lo"]).alias("c"), F.transform(run, lambda y: F.struct(y["pos"].alias("pos"), y["n"].alias("n"), y["h1"].alias("h1"), y["h2"].alias("h2"))).alias("run"))

    rows = whole.join(asked, ["id", "body"]).select("id", "body", F.explode(F.transform("ps", one)).alias("x")).select("id", "body", "x.*")
    return rows.withColumns({"k1": F.xxhash64("c", "run.h1"), "k2": F.xxhash64("c", "run.h2")})


def _extended(x: Column, y: Column, least_words: int) -> Column:
    """The positions of x's lines that equal y's from the fingerprint on, both ways; none if they have too few words."""
    same = lambda u, v: (u["h1"] == v["h1"]) & (u["h2"] == v["h2"])
    count = lambda acc, e: F.struct((acc["n"] + F.when(acc["on"] & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n"), (acc["on"] & F.coalesce(e, F.lit(False))).alias("on"))
    common = lambda a, b: F.aggregate(F.zip_with(a, b, same), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), count, lambda acc: acc["n"])
    right = common(F.slice(x["run"], x["c"] + 1, F.size(x["run"])), F.slice(y["run"], y["c"] + 1, F.size(y["run"])))
    left = common(F.reverse(F.slice(x["run"], F.lit(1), x["c"])), F.reverse(F.slice(y["run"], F.lit(1), y["c"])))
    run = F.slice(x["run"], x["c"] + 1 - left, left + right)
    return F.when((right > 0) & (F.aggregate(run, F.lit(0).cast("long"), lambda s, u: s + u["n"]) >= least_words), F.transform(run, lambda u: u["pos"])).otherwise(F.array().cast("array<int>"))


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents (id, body, text) to (id, body, gone): the positions of the lines to delete, for documents that have any."""
    lines = staged(_lines(docs, least_words), "lines")
    windows = _windows(lines)
    marked = staged(windows.select("id", "body", "p", "mark").distinct(), "fingerprints")
    marks = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeds = joined_with(marked, marks, ["mark"], marked.count()).drop("n")
    around = staged(_surroundings(lines, seeds), "surroundings")
    total = around.count()

    # Equal surroundings: all but the first go.
    key = ["mark", "k1", "k2"]
    firsts = around.groupBy(*key).agg(F.min(F.struct("id", "body", "p")).alias("origin"), F.count(F.lit(1)).alias("n"))
    kinds = firsts.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds"))
    own = F.struct("id", "body", "p")
    copies = joined_with(around, firsts.filter("n > 1"), key, total).filter(own > F.col("origin")).select("id", "body", F.explode("run.pos").alias("pos"))

    # Different ones of a fingerprint: each is extended against those before it.
    first = around.join(firsts.select("mark", "k1", "k2", F.col("origin.id").alias("id"), F.col("origin.body").alias("body"), F.col("origin.p").alias("p")), [*key, "id", "body", "p"], "left_semi")
    several = staged(joined_with(first, kinds.filter("kinds > 1").withColumn("n", F.col("kinds")), ["mark"], total).select("mark", "kinds", "id", "body", "p", "c", "run"), "different")
    few = several.filter(F.col("kinds") <= SURROUNDINGS).groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("id", "body", "p", "c", "run"))).alias("all"))  # at most SURROUNDINGS
    later = few.select("all", F.posexplode("all").alias("k", "x")).filter("k > 0")
    extended = later.select("x.id", "x.body", F.explode(F.array_distinct(F.flatten(F.transform(F.slice("all", F.lit(1), F.col("k")), lambda y: _extended(F.col("x"), y, least_words))))).alias("pos"))

    # A fingerprint with too many: by its whole windows, each held against the first.
    many = windows.join(several.filter(F.col("kinds") > SURROUNDINGS), ["id", "body", "p", "mark"])
    many = many.select("id", "body", "p", "mark", F.slice("run", F.col("c") - F.col("p") + F.col("s") + 1, F.col("e") - F.col("s") + 1).alias("part"))
    many = many.withColumns({"k1": F.xxhash64("part.h1"), "k2": F.xxhash64("part.h2")})
    oldest = many.groupBy(*key).agg(F.min(own).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = joined_with(many, oldest, key, 2 * lines.count())  # a line begins at most one window and ends one
    cut = cut.filter(own > F.col("origin")).select("id", "body", F.explode("part.pos").alias("pos"))

    gone = copies.unionByName(extended).unionByName(cut)
    return gone.groupBy("id", "body").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs cut out of text, and n_lines and n_removed.

    Defined cases: lines end at U+000A alone, and a text without any is one line, however long; lines without words neither
    match nor end a run, and stay; a run shorter than ``least_words`` words stays; a null text stays null; a null doc_id sorts after every other; rows that repeat both
    doc_id and text are one document and get equal results; a document all of whose lines are repeats keeps an empty
    text; an empty table gives an empty result; other columns pass through, whatever their names.
    """
    keyed = docs.select(boxed(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("body"), F.col("text").alias("text"))
    gone = repeated_lines(keyed.select("id", "body", "text"), least_words).select(F.col("id").alias("_id"), F.col("body").alias("_body"), "gone")
    rows = keyed.select("_own", "id", "body").join(gone, (F.col("id") == F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    lines = lines_of(F.col("_own.text"))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
    end = lambda k: F.coalesce(F.get("gone", k), F.size("_lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("_lines", start(k) + 1, end(k) - start(k))))
    rows = rows.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
    text = F.when(F.col("gone").isNull(), F.col("_own.text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == "text" else F.col(f"_own.`{c}`").alias(c) for c in docs.columns]
    breaks = F.length(F.col("_own.text")) - F.length(F.replace(F.col("_own.text"), F.lit("\n"), F.lit("")))
    return rows.select(*out, F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)),
sums AS (
  SELECT doc_id, pos, n, md5(line) AS h, sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM lines WHERE n > 0),
runs AS (
  SELECT doc_id, list(h) OVER a AS hs, list(pos) OVER a AS ps, sum(n) OVER a AS n FROM sums
  WINDOW a AS (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, list(h) OVER b AS hs, list(pos) OVER b AS ps, sum(n) OVER b AS n FROM sums
  WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
marked AS (SELECT doc_id, ps, row_number() OVER (PARTITION BY array_to_string(hs, '') ORDER BY doc_id, ps[1]) AS nth FROM runs WHERE n >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(ps) AS pos FROM marked WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
