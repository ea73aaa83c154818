"""All pairs of token sets with at least a given Jaccard similarity, exactly, without moving whole sets for pairs that are not near.

A prefix filter: sets so alike share one of their first tokens in one order of all tokens, here from rare to frequent.  How
frequent a token is comes from a table of bounded size, in which tokens may share an entry: the order decides the cost alone,
but that a token whose entry counts one set is in no other.  A pair is taken up where its first common token can be, and goes
if the tokens before it, or the parity bits of the sets, differ in more tokens than a near pair's can.  What is left is verified on
whole sets in tiles, so that the pairs of a large group of copies share the few places their sets are sent to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.session import bit_filter, shipped, staged

#: Entries of the table of frequencies, one byte each, and of one of its blocks.
ENTRIES, BLOCK = 1 << 24, 1 << 12
#: Tokens that a task tallies at once.
TALLIED = 1 << 22
#: Tokens and sets that a tile holds; sets that one set is verified with at once.
TILE_TOKENS, TILE_SETS, AT_ONCE = 1 << 17, 1 << 10, 256
#: Token rows that a partition takes.
ROWS_EACH = 1 << 20
MIXER = np.uint64(0x9E3779B97F4A7C15)
SLACK = 1e-6  # of comparisons in floating point that may only let too much pass


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists of hashes."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (set) to rows (block, at, n): how many of a task's sets have a token of each entry of a block."""

    def sent(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entry, n = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.flatnonzero(np.diff(entry // BLOCK)) + 1
        blocks = [int(x[0]) // BLOCK for x in np.split(entry, cuts)]
        at = [(x % BLOCK).astype("<u2").tobytes() for x in np.split(entry, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(at, pa.binary()), pa.array([x.astype("<u4").tobytes() for x in np.split(n, cuts)], pa.binary())], names=["block", "at", "n"])

    parts, held = [], 0
    for b in batches:
        bounds, values = _lists(b.column(0))
        parts.append(values[bounds[0] : bounds[-1]] & (ENTRIES - 1))
        held += len(parts[-1])
        if held >= TALLIED:
            yield from sent(parts)
            parts, held = [], 0
    if held:
        yield from sent(parts)


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, n) of whole blocks to (block, classes): a byte per entry, its number of sets up to 128, then in steps of an eighth of a doubling."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums.setdefault(block, np.zeros(BLOCK, dtype=np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    for block, n in sums.items():
        steps = np.where(n <= 128, n, 128 + np.floor(8 * np.log2(np.maximum(n, 128) / 128)))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(steps, 255).astype(np.uint8).tobytes()], pa.binary())], names=["block", "classes"])


def frequencies(sets: DataFrame, parts: int) -> bytes:
    """The table of all tokens' frequencies: 16 MB, whatever the input."""
    dealt = sets.select("set").mapInArrow(tallies, "block int, at binary, n binary").repartition(parts, "block")
    table = np.zeros(ENTRIES, dtype=np.uint8)
    for r in dealt.mapInArrow(classes, "block int, classes binary").collect():  # at most 4096 rows of 4 kB
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["classes"], np.uint8)
    return table.tobytes()


def prefixes(frequency: bytes, threshold: float):
    """Rows (id, set) to rows (token, id, size, place, one, two) of the first tokens that other sets may have; one and two are the two such tokens before."""
    table = np.frombuffer(frequency, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, values = _lists(b.column(1))
            values = values[bounds[0] : bounds[-1]]
            size = np.diff(bounds).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            rank = table[values & (ENTRIES - 1)]
            order = np.lexsort((values, rank, row))
            values, rank = values[order], rank[order]
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            first = size - np.ceil(size * threshold - SLACK).astype(np.int64) + 1
            use = np.flatnonzero((place < first[row]) & (rank > 1))
            row, place, token = row[use], place[use], values[use]
            before = []
            for k in (1, 2):
                was = np.r_[np.zeros(min(k, len(token)), dtype=np.int64), token[:-k]]
                none = np.r_[np.ones(min(k, len(token)), dtype=bool), row[k:] != row[:-k]]
                before.append(pa.array(was, mask=none))
            yield pa.RecordBatch.from_arrays([pa.array(token), b.column(0).take(pa.array(row)), pa.array(size[row], pa.int32()), pa.array(place, pa.int32()), *before], names=["token", "id", "size", "place", "one", "two"])

    return run


def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, set) to (id, size, bits): a bit says whether the tokens that fall on it are odd in number; there are as many as tokens, or more, a power of two."""
    for b in batches:
        bounds, values = _lists(b.column(1))
        found = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            n = max(64, 1 << int(e - s - 1).bit_length())
            at = ((values[s:e].view(np.uint64) * MIXER) >> np.uint64(32)) & np.uint64(n - 1)
            odd = (np.bincount(at.astype(np.int64), minlength=n) & 1).astype(np.uint8)
            found.append(np.packbits(odd, bitorder="little").view("<i8"))
        flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        bits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in found]]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int32()), bits], names=["id", "size", "bits"])


def _differ(x: Column, y: Column) -> Column:
    """Bits in which parities differ: never more than tokens that one set has alone.  The longer of two is folded once."""
    half = lambda c, n: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda p, q: p.bitwiseXOR(q))
    count = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    n, m = F.size(x), F.size(y)
    return F.when(n == m, count(x, y)).when(n == 2 * m, count(half(x, m), y)).when(m == 2 * n, count(x, half(y, n))).otherwise(F.lit(0))


def passed(bits: int, marked: bytes):
    """Rows whose id, the first column, the filter passes."""
    table = np.frombuffer(marked, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() & (bits - 1)
            yield b.filter(pa.array((table[at >> 3] >> (at & 7) & 1).astype(bool)))

    return run


def _verified(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    a, b = rows.column("a").to_numpy(), rows.column("b")
    is_set = b.is_null().to_numpy()
    held = rows.filter(pa.array(is_set))
    bounds, values = _lists(held.column("set"))
    node = held.column("a").to_numpy()
    order = np.argsort(node, kind="stable")
    at = lambda x: order[np.searchsorted(node, x, sorter=order)]
    x, y = a[~is_set], b.filter(pa.array(~is_set)).to_numpy()
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    common = np.zeros(len(x), dtype=np.int64)
    left, right = at(x), at(y)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=np.int64)
    for s, e in zip(starts, np.r_[starts[1:], len(x)], strict=True):
        mine = values[bounds[left[s]] : bounds[left[s] + 1]]
        for k in range(s, e, AT_ONCE):
            sets = [values[bounds[o] : bounds[o + 1]] for o in right[k : min(k + AT_ONCE, e)]]
            theirs = np.concatenate(sets)
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common[k : k + len(sets)] = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *[len(v) for v in sets[:-1]]]))
    size = np.diff(bounds).astype(np.int64)
    jaccard = common / (size[left] + size[right] - common)
    near = jaccard >= threshold
    return pa.RecordBatch.from_arrays([pa.array(x[near]), pa.array(y[near]), pa.array(jaccard[near], pa.float64())], names=["a", "b", "jaccard"])


def verified(threshold: float):
    """Rows (one, other, a, b, set), sorted by the tiles (one, other), to near pairs (a, b, jaccard); rows without b hold the set of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            one, other = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((one[1:] != one[:-1]) | (other[1:] != other[:-1]))
            if len(new):  # all but the last pair of tiles is whole
                end = held.num_rows - batch.num_rows + int(new[-1]) + 1
                yield _verified(held.slice(0, end), threshold)
                held = held.slice(end)
        if held is not None:
            yield _verified(held, threshold)

    return run


def _tiled(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """``pairs`` verified: sets with the same smallest neighbour are in the same tiles, and go once to each pair of tiles that asks for them."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"), F.col("na").alias("size")).union(pairs.select("b", "a", "nb"))
    labels = staged(both.groupBy("node").agg(F.least(F.min("label"), F.col("node")).alias("label"), F.first("size").alias("size")), "labels")
    tiles = labels.groupBy("label").agg(F.greatest(F.ceil(F.sum("size") / TILE_TOKENS), F.ceil(F.count(F.lit(1)) / TILE_SETS)).alias("tiles"))
    cells = labels.join(tiles, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "tiles")).alias("cell"))
    cells = staged(cells, "cells")
    one, other = cells.select(F.col("node").alias("a"), F.col("cell").alias("one")), cells.select(F.col("node").alias("b"), F.col("cell").alias("other"))
    some = sets.mapInArrow(passed(*bit_filter(labels.select("node"), labels.count())), sets.schema)  # few others move
    asked = staged(pairs.select("a", "b").join(one, "a").join(other, "b").select("one", "other", "a", "b"), "asked")
    members = asked.select("one", "other", "a").union(asked.select("one", "other", "b")).distinct()
    given = members.join(some.withColumnRenamed("id", "a"), "a").select("one", "other", "a", F.lit(None).cast("long").alias("b"), "set")
    rows = given.unionByName(asked.withColumn("set", F.lit(None).cast("array<long>")))
    rows = rows.repartition(parts, "one", "other").sortWithinPartitions("one", "other")
    return rows.mapInArrow(verified(threshold), "a long, b long, jaccard double")


def near_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Staged rows (id long, set array<long>), different ids and sorted sets of different hashes, to all pairs (a, b, jaccard), a < b, of ``threshold`` or more."""
    spark = shipped(sets.sparkSession)
    total = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_EACH)
    rows = sets.mapInArrow(prefixes(frequencies(sets, parts), threshold), "token long, id long, size int, place int, one long, two long")
    named = lambda x: [F.col("token"), *[F.col(c).alias(c + x) for c in ("id", "size", "place", "one", "two")]]
    apart = (1 - threshold) / (1 + threshold) * (F.col("size_a") + F.col("size_b")) + SLACK  # tokens that only one set of a near pair has, at most
    alike = (F.col("id_a") < F.col("id_b")) & (F.col("size_a") >= F.col("size_b") * threshold - SLACK) & (F.col("size_b") >= F.col("size_a") * threshold - SLACK)
    alike = alike & (F.col("place_a") + F.col("place_b") <= apart)
    for x in ("one", "two"):
        for y in ("one", "two"):
            alike = alike & ~F.coalesce(F.col(x + "_a") == F.col(y + "_b"), F.lit(False))  # there is a common token before
    met = rows.select(*named("_a")).join(rows.select(*named("_b")), "token").filter(alike)
    pairs = staged(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
    bits = sets.mapInArrow(parities, "id long, size int, bits array<long>")
    x, y = (bits.select(F.col("id").alias(s), F.col("size").alias("n" + s), F.col("bits").alias("bits_" + s)) for s in "ab")
    close = _differ(F.col("bits_a"), F.col("bits_b")) <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + SLACK
    left = staged(pairs.join(x, "a").join(y, "b").filter(close).select("a", "b", "na", "nb"), "close")
    return _tiled(left, sets, threshold, parts)
