"""Ordered dedup: the first row of each key stays; near copies are dropped against the rows that were kept before them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lmdata.functions.text import strip
from lmdata.operators import near_sets
from lmdata.session import filter_blocks, staged

PERMUTATIONS = 128


@cache
def bands(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Number of bands and rows in each, for the least sum of the false and the missed share, each the area on its side of the threshold."""
    if not 0 < threshold < 1:
        raise ValueError("0 < threshold < 1 is needed")

    def error(b: int, r: int) -> float:
        found = lambda s: 1 - (1 - s**r) ** b
        area = lambda f, lo, hi: sum(f(lo + (hi - lo) * (i + 0.5) / 1000) for i in range(1000)) * (hi - lo) / 1000
        return area(found, 0.0, threshold) + area(lambda s: 1 - found(s), threshold, 1.0)

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda x: error(*x))



def keep_first(df: DataFrame, keys: list[Column], order: str = "seq", first: DataFrame | None = None) -> DataFrame:
    """The rows that come first for their keys.  Minima are combined before the shuffle, so a hot key costs one row a task.

    Null keys are equal; rows that tie in ``order`` stay together; null orders come last.  ``first`` has the minima (_k0, ..., _first) if they are known.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select("*", *named)
    first = rows.groupBy(*names).agg(F.min(order).alias("_first")) if first is None else first
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(first[n])
    return rows.join(first, same & rows[order].eqNullSafe(first["_first"]), "left_semi").drop(*names)


def exact_text(df: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """By stripped, lower-cased text."""
    return keep_first(df, [F.md5(F.lower(strip(F.col(text))))], order)


def keep_first_in_place(df: DataFrame, keys: list[Column], order: str = "seq") -> DataFrame:
    """The rows of ``keep_first``, moving few of the others' columns: for long texts, of which the larger part stays.

    Keys and order are staged and compared alone.  A filter of bounded size marks the orders of the rows that go; rows it does not mark stay
    where they are, and the marked ones, a few that stay among them, are looked up.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    small = staged(df.select(F.col(order).alias("_order"), *named), "keys")
    first = staged(small.groupBy(*names).agg(F.min("_order").alias("_first")), "firsts")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    stays = same & F.col("a._order").eqNullSafe(F.col("b._first"))
    gone = small.alias("a").join(first.alias("b"), stays, "left_anti").select(F.xxhash64("_order").alias("h"))
    bits, blocks = filter_blocks(staged(gone, "gone"))
    at = F.xxhash64(order).bitwiseAND(F.lit(bits - 1))
    rows = df.withColumns({"_at": at.bitwiseAND(F.lit((1 << 15) - 1)), "_block": F.shiftright(at, 15)}).join(F.broadcast(blocks), F.col("_block") == F.col("block"), "left")  # at most 4096 blocks of 4 kB
    byte = F.ascii(F.decode(F.substring("m", F.shiftright("_at", 3).cast("int") + 1, 1), "ISO-8859-1"))
    marked = F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    asked = rows.filter(marked).select(*df.columns)
    return rows.filter(~marked).select(*df.columns).unionByName(keep_first(asked, keys, order, first))


def exact_text_in_place(df: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """The rows of ``exact_text``, where texts move only if they may go."""
    return keep_first_in_place(df, [F.md5(F.lower(strip(F.col(text))))], order)


def exact_pairs(df: DataFrame, order: str = "pair_id") -> DataFrame:
    """By prompt, chosen and rejected: one prompt with different answers is kept on purpose.  A null field equals only a null one."""
    return keep_first(df, [F.md5(c) for c in ("prompt", "chosen", "rejected")], order)


def exact_records(df: DataFrame, order: str) -> DataFrame:
    """By the whole record, as JSON with its columns in the order of their names."""
    return keep_first(df, [F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != order])))], order)


def tokens(text: Column) -> Column:
    """The set of white-space separated tokens."""
    return F.array_distinct(F.filter(F.split(strip(text), r"[\s\x{0B}\x{85}\x{A0}\x{3000}]+"), lambda x: x != ""))


def jaccard_edges(df: DataFrame, threshold: float, text: str = "text", order: str = "seq") -> DataFrame:
    """Pairs (a, b, jaccard), a before b, with at least ``threshold`` of their token sets in common: all of them, exactly.

    Tokens are compared by their 64-bit hashes; sets are written once and read by what ``near_sets`` does with them.
    Rows that tie in ``order`` count as one text; a null order, or a text without tokens, has no pair.
    """
    kind = df.schema[order].dataType
    if not isinstance(kind, IntegralType):  # ids of our own stand for what can't be one
        names = staged(df.select(F.col(order).alias("_name")).filter("_name IS NOT NULL").distinct().withColumn("_id", F.monotonically_increasing_id()), "names")
        found = jaccard_edges(df.join(names, F.col(order) == F.col("_name")).select(F.col("_id"), F.col(text).alias("_text")), threshold, "_text", "_id")
        x, y = (names.select(F.col("_id").alias(s), F.col("_name").alias("_" + s)) for s in "ab")
        return found.join(x, "a").join(y, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard")
    sets = df.select(F.col(order).cast("long").alias("id"), F.sort_array(F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t))).alias("set"))
    sets = staged(sets.filter("id IS NOT NULL AND size(set) > 0"), "sets")
    tied = sets.groupBy("id").count().filter("count > 1").select("id")
    if not tied.isEmpty():
        one = sets.join(tied, "id", "left_semi").groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("set")))).alias("set"))
        sets = staged(sets.join(tied, "id", "left_anti").unionByName(one), "sets")
    out = near_sets.near_pairs(sets, threshold)
    return out.select(F.col("a").cast(kind), F.col("b").cast(kind), "jaccard")


def band_buckets(df: DataFrame, threshold: float, text: str = "text", order: str = "seq") -> DataFrame:
    """Rows (doc, band, value): documents that share a band's value count as near copies; they are not verified.

    Signatures are made inside the row: no token leaves it.  Texts without tokens share all their bands.
    """
    n, each = bands(threshold)
    hashed = F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t))
    least = lambda i: F.array_min(F.transform("h", lambda x: F.xxhash64(x, i)))
    value = lambda b: F.xxhash64(F.transform(F.sequence(b * each, (b + 1) * each - 1), least))
    rows = df.select(F.col(order).alias("doc"), hashed.alias("h"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(b.alias("band"), value(b).alias("value")))
    return rows.select("doc", F.explode(keys).alias("bucket")).select("doc", "bucket.band", "bucket.value")


def greedy(nodes: DataFrame, edges: DataFrame, order: str = "seq") -> DataFrame:
    """The rows of ``nodes`` that stay when each is dropped that has an edge to one kept before it.

    That is the lexicographically first maximal independent set.  Each round keeps every undecided node without an
    undecided earlier neighbour and drops the neighbours of what it kept; only ids move, and each round is a staged table.
    """
    open_ = staged(edges.select("a", "b"), "edges")
    dropped = None
    while True:
        later = open_.select(F.col("b").alias("n")).distinct()
        kept = open_.select(F.col("a").alias("n")).distinct().join(later, "n", "left_anti")
        out = open_.join(kept.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        out = staged(out, "dropped")
        if out.isEmpty():
            break
        dropped = out if dropped is None else dropped.union(out)
        gone = out
        rest = open_.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b")
        open_ = staged(rest, "edges")
    if dropped is None:
        return nodes
    return nodes.join(dropped.withColumnRenamed("n", "_gone"), F.col(order) == F.col("_gone"), "left_anti")


def greedy_buckets(nodes: DataFrame, buckets: DataFrame, order: str = "seq") -> DataFrame:
    """The same where an edge is a shared bucket (doc, band, value), without making the pairs.

    A node is kept once it comes first among the undecided in all its buckets; what shares a bucket with a kept one is dropped.
    """
    open_ = staged(buckets, "buckets")
    dropped = None
    while True:
        key = ["band", "value"]
        first = open_.groupBy(*key).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = open_.join(first.filter("n > 1"), key)
        waits = shared.filter("doc > first").select("doc").distinct()
        kept = shared.select("doc").distinct().join(waits, "doc", "left_anti")
        won = shared.join(kept, "doc", "left_semi").select(*key).distinct()
        out = staged(shared.join(won, key, "left_semi").join(kept, "doc", "left_anti").select("doc").distinct(), "dropped")
        if out.isEmpty():
            break
        dropped = out if dropped is None else dropped.union(out)
        open_ = staged(shared.select("doc", *key).join(out, "doc", "left_anti").join(won, key, "left_anti"), "buckets")
    if dropped is None:
        return nodes
    return nodes.join(dropped.withColumnRenamed("doc", "_gone"), F.col(order) == F.col("_gone"), "left_anti")


def near_dedup(df: DataFrame, threshold: float = 0.8, mode: str = "lsh", text: str = "text", order: str = "seq") -> DataFrame:
    """Rows without a near copy among the rows kept before them.  ``lsh``: a band collision; ``exact``: the Jaccard similarity."""
    if mode == "exact":
        return greedy(df, jaccard_edges(df, threshold, text, order), order)
    return greedy_buckets(df, band_buckets(df, threshold, text, order), order)


def decontaminate(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Train rows whose stripped value is in no test row."""
    held = test.select(strip(F.col(column)).alias("_held")).distinct()
    return train.join(held, strip(F.col(column)) == F.col("_held"), "left_anti")


def contaminated(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    held = test.select(strip(F.col(column)).alias("_held")).distinct()
    return train.join(held, strip(F.col(column)) == F.col("_held"), "left_semi")


def novel(new: DataFrame, existing: DataFrame, threshold: float = 0.8, text: str = "text", order: str = "seq") -> DataFrame:
    """Extension: new rows that are near no existing row, whatever its place, and no new row kept before them.

    ``order`` is a whole number below 2^62; the two frames may use the same ones.
    """
    key = lambda is_new: (F.col(order).cast("long") * 2 + is_new).alias("_key")
    both = existing.select(key(0), F.col(text)).unionByName(new.select(key(1), F.col(text)))
    edges = staged(jaccard_edges(both, threshold, text, "_key").select("a", "b"), "novel")
    is_new = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    mixed = edges.filter(is_new("a") != is_new("b"))
    known = staged(mixed.select(F.when(is_new("a"), F.col("a")).otherwise(F.col("b")).alias("_known")).distinct(), "known")
    rest = edges.filter(is_new("a") & is_new("b")).join(known, F.col("a") == F.col("_known"), "left_anti").join(known, F.col("b") == F.col("_known"), "left_anti")
    left = new.select(order, text, key(1)).join(known, F.col("_key") == F.col("_known"), "left_anti")
    return greedy(left, rest, "_key").drop("_key")
