"""SimHash near-dedup of sets of five-word shingles: documents with a Jaccard similarity of 0.8 or more, all of them.

Sets so alike have fingerprints that differ in few bits, but not in so few that equal blocks of bits would find all pairs.
So tiles are made from texts that share a shingle which is among the first 20 % of both, in one order of all shingles: sets
with a similarity of 0.8 have one in common.  (Common shingles come last in that order; which ones count as common
decides only the cost.)  Within these the fingerprints are compared exactly, tile against tile, and what is within the
radius is verified on the whole sets.

A group of near copies is compared in two turns.  First each text of a large group is held against the one whose fingerprint is
nearest, and against the most central of those within the radius, which for copies of one original is the original.  In the
second turn only texts that are still in different components are compared, all of them, so that no link within the radius
is lost.  What they send is a spanning forest of the pairs within the radius; the clusters that it connects are cut into tiles of
texts with their sets, and each pair of tiles is verified where it lies and sends a forest again.  So no group's pairs are
ever rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmdata.llm.common import NULL_ID, bit_filter, boxed, joined_with, staged, unboxed
from lmdata.llm.components import components
from lmdata.llm.simhash import TILE, forest, majority, near_pairs

SHINGLE, SEED = 5, 42
#: A fingerprint has 256 bits.  Of sets with a similarity of 0.8, 39 differ, with a deviation of 5.8; beyond the radius are
#: about two pairs in 10^7.  Sets of fewer than SMALL shingles, whose bits vary more, are compared without it.
BITS, RADIUS, SMALL = 256, 70, 32
PARTS = BITS // 64
MIXERS = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(PARTS))
#: Groups of so many texts give all their pairs in the first turn.
GROUP = 4
#: Common shingles are sought in about SOUGHT texts; at most COMMON of them are sent to the tasks.
SOUGHT, COMMON = 8192, 65536
STEP = 1024
#: Rows that a task takes, and links of one text that are verified in one task.
ROWS_EACH, LINKS_EACH, MOST_HOT = 1 << 20, 64, 10_000
#: Shingles that a tile of a cluster holds, but for its last text, and texts that one text is verified with at once.
TILE_SHINGLES, AT_ONCE = 1 << 17, 256


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a text of fewer words is one shingle."""
    words = b" ".join(text.lower().split())  # bytes: only A-Z are lowered, as for the fingerprints
    space = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
    starts, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(words)]
    if len(starts) < n:
        return np.array([xxhash.xxh64_intdigest(words, SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(words[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=False)], dtype=np.uint64))


def fingerprint(own: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes, in parts of 64 bits: a bit is 1 if it is set in over half of them."""
    out = []
    for by in MIXERS:
        h = own * by
        h ^= h >> np.uint64(32)
        h *= MIXERS[0]
        out.append(majority(h ^ (h >> np.uint64(29))))
    return out


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


PRINTS = [f"f{i}" for i in range(PARTS)]
SKETCH = "id long, node long, n long, " + ", ".join(f"{f} long" for f in PRINTS) + ", prefix array<long>"


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(v) for v in values]]), pa.int32()), pa.array(flat))


def sketches(common: np.ndarray):
    """Rows (id, node, text) to (id, node, n, the fingerprint's parts, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, STEP):
                part = b.slice(start, STEP)
                sizes, prints, prefixes = [], [], []
                for t in part.column(2):
                    own = shingles((t.as_py() or "").encode())
                    last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(len(own), dtype=bool)
                    sizes.append(len(own))
                    prints.append(fingerprint(own))
                    prefixes.append(np.concatenate([own[~last], own[last]])[: prefix_size(len(own))])
                columns = np.array(prints, dtype=np.uint64).view(np.int64).T
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), *map(pa.array, columns), _lists(prefixes)], names=["id", "node", "n", *PRINTS, "prefix"])

    return run


def whole_sets(bits: int, needed: bytes):
    """Rows (node, text) to (node, set) of the texts that the filter names, each once a task."""
    table = np.frombuffer(needed, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node = b.column(0).to_numpy()
            at = node & (bits - 1)
            for rows in np.array_split(np.flatnonzero(table[at >> 3] >> (at & 7) & 1), b.num_rows // STEP + 1):
                rows = [i for i in rows.tolist() if not (node[i] in seen or seen.add(node[i]))]
                if rows:
                    found = [shingles((b.column(1)[i].as_py() or "").encode()) for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), _lists(found)], names=["node", "set"])

    return run


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    table = pa.Table.from_batches(found) if (found := list(batches)) else None
    return [table.column(c).to_numpy() if table else np.empty(0, dtype=np.int64) for c in names]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    starts = np.flatnonzero(np.r_[True, new])
    return starts, np.diff(np.r_[starts, len(keys[0])])


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, label) of whole keys to (key, part, node, label) of those that more than one label shares.

    A key that more than TILE texts hold is cut into parts, each with the first tile of the largest label and a tile of
    the others; tiles of one label are not paired.
    """
    names = ["key", "part", "node", "label"]
    key, node, label = _whole(batches, ["key", "node", "label"])
    order = np.lexsort((node, label, key))
    key, node, label = key[order], node[order], label[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]  # equal texts count once
    key, node, label = key[fresh], node[fresh], label[fresh]
    starts, sizes = _groups(key)
    mixed = label[starts] != label[starts + sizes - 1] if len(starts) else np.empty(0, dtype=bool)
    few = np.repeat(mixed & (sizes <= TILE), sizes)
    if few.any():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[few], np.zeros(few.sum(), dtype=np.int64), node[few], label[few])], names=names)
    for g in np.flatnonzero(mixed & (sizes > TILE)):
        own, said = node[starts[g] : starts[g] + sizes[g]], label[starts[g] : starts[g] + sizes[g]]
        tiles, part = range(0, len(own), TILE), 0
        for a in tiles:
            for b in tiles[a // TILE :]:
                if said[a] != said[min(b + TILE, len(own)) - 1]:
                    rows = np.unique(np.r_[a : min(a + TILE, len(own)), b : min(b + TILE, len(own))])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(rows), key[starts[g]]), np.full(len(rows), part), own[rows], said[rows])], names=names)
                    part += 1


def deal_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) of whole keys to (key, part, node) of those that several texts hold.

    A key that more than TILE texts hold is cut into parts, each with the first tile and another.
    """
    names = ["key", "part", "node"]
    key, node = _whole(batches, ["key", "node"])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    key, node = key[fresh], node[fresh]
    starts, sizes = _groups(key)
    few = np.repeat((sizes > 1) & (sizes <= TILE), sizes)
    if few.any():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[few], np.zeros(few.sum(), dtype=np.int64), node[few])], names=names)
    for g in np.flatnonzero(sizes > TILE):
        own = node[starts[g] : starts[g] + sizes[g]]
        for part, at in enumerate(range(TILE, len(own), TILE)):
            rows = np.r_[own[:TILE], own[at : at + TILE]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(rows), key[starts[g]]), np.full(len(rows), part), rows)], names=names)


def match(first: bool, group: int = GROUP):
    """Rows (key, part, node, label, n, the fingerprint's parts) of whole parts to pairs (a, b), a < b, and to rows (key, node).

    In the first turn small groups give all their pairs, and large ones of each text the pairs with
    the nearest and the most central; the rows (key, node) are those of large groups.  In the second turn the pairs given connect
    what all pairs of texts with different labels connect.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "key", "node")])

    def sent(a, b, key, node) -> pa.RecordBatch:
        both = np.stack([a, b])
        none, blank = pa.nulls(len(key), pa.int64()), pa.nulls(both.shape[1], pa.int64())
        return pa.table([pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x, y]) for x, y in ((pa.array(both[0]), none), (pa.array(both[1]), none), (blank, pa.array(key)), (blank, pa.array(node)))], schema=schema).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "node", "label", "n", *PRINTS]
        key, part, node, label, n, *prints = _whole(batches, names)
        if not len(key):
            return
        fp = np.stack(prints, axis=1).view(np.uint64)
        order = np.lexsort((node, part, key))
        key, part, node, label, n, fp = key[order], part[order], node[order], label[order], n[order], fp[order]
        starts, sizes = _groups(key, part)
        pairs_a, pairs_b, open_keys, open_nodes = [], [], [], []

        def alike(i, j):
            """Whether the sets at i and j may be near: by size, and by fingerprint unless one is small."""
            ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (label[i] != label[j])
            return ok & ((np.bitwise_count(fp[i] ^ fp[j]).sum(axis=-1, dtype=np.int64) <= RADIUS) | (np.minimum(n[i], n[j]) < SMALL))

        small = sizes <= max(group, 2)
        for off in range(1, max(group, 2)):  # many small groups at once
            for k in range(max(group, 2) - off):
                i = starts[small & (sizes > off + k)] + k
                i = i[alike(i, i + off)]
                pairs_a.append(node[i])
                pairs_b.append(node[i + off])
        for g in np.flatnonzero(~small):
            s, e = starts[g], starts[g] + sizes[g]
            size = int(sizes[g])
            nearest = np.full(size, BITS * size)  # bits that differ, and which of the group
            close = np.zeros(size, dtype=np.int64)  # how many are near to each, and how near
            root = np.arange(size)
            for i, j, bits in near_pairs(fp[s:e], np.where(n[s:e] < SMALL, BITS, RADIUS)):
                ok = alike(s + i, s + j)
                i, j, bits = i[ok], j[ok], bits[ok]
                if first:
                    np.minimum.at(nearest, j, bits * size + i)
                    np.minimum.at(nearest, i, bits * size + j)
                    for x in (i, j):
                        close += np.bincount(x, weights=BITS - bits, minlength=size).astype(np.int64)
                else:
                    root = forest(size, np.r_[np.arange(size), i], np.r_[root, j])
            if first:
                used = np.flatnonzero(nearest < BITS * size)
                pairs_a.append(node[s + nearest[used] % size])
                pairs_b.append(node[s + used])
                place = np.empty(size, dtype=np.int64)  # the most central first
                place[np.lexsort((node[s:e], -close))] = np.arange(size)
                central = np.full(size, size)
                for i, j, _ in near_pairs(fp[s:e], np.where(n[s:e] < SMALL, BITS, RADIUS)):
                    ok = alike(s + i, s + j)
                    np.minimum.at(central, i[ok], place[j[ok]])
                    np.minimum.at(central, j[ok], place[i[ok]])
                pairs_a.append(node[s + np.argsort(place)[central[used]]])
                pairs_b.append(node[s + used])
                if size > TILE:  # a part of a key that was cut: its texts have not met those of other parts
                    used = np.arange(size)
                open_keys.append(key[s + used])
                open_nodes.append(node[s + used])
            else:
                away = np.flatnonzero(root != np.arange(size))
                pairs_a.append(node[s + root[away]])
                pairs_b.append(node[s + away])
        some = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        a, b, k, o = some(pairs_a), some(pairs_b), some(open_keys), some(open_nodes)
        if len(a) or len(k):
            yield sent(np.minimum(a, b), np.maximum(a, b), k, o)

    return run


def _links(rows: pa.Table, own: bool) -> pa.RecordBatch:
    """A spanning forest, across labels, of the verified pairs of one pair of tiles; ``own`` if it is a tile with itself."""
    node, label, n, tile, *prints = (rows.column(c).to_numpy() for c in ("node", "label", "n", "tile", *PRINTS))
    fp = np.stack(prints, axis=1).view(np.uint64)
    lists = rows.column("set").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    said, of = np.unique(label, return_inverse=True)
    root = np.arange(len(said))
    out: list[tuple[int, int]] = []
    for x, y, _ in near_pairs(fp, np.where(n < SMALL, BITS, RADIUS)):
        ok = (of[x] != of[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        ok &= own | (tile[x] != tile[y])
        order = np.argsort(x[ok], kind="stable")
        x, y = x[ok][order], y[ok][order]
        for s, size in zip(*_groups(x), strict=True):
            one = x[s]
            mine = flat[ends[one] : ends[one + 1]]
            for at in range(s, s + size, AT_ONCE):
                others = y[at : min(at + AT_ONCE, s + size)]
                others = others[root[of[others]] != root[of[one]]]
                if not len(others):
                    continue
                sets = [flat[ends[o] : ends[o + 1]] for o in others]
                theirs = np.concatenate(sets)
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *[len(v) for v in sets[:-1]]]))
                for o in others[9 * shared >= 4 * (n[one] + n[others])]:
                    if root[of[o]] != root[of[one]]:
                        out.append((node[one], node[o]))
                        root[root == root[of[o]]] = root[of[one]]
    both = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])


def verified_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, tile, node, label, n, the fingerprint's parts, set), sorted by (cluster, i, j), to links (u, v)."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("cluster", "i", "j")]
        for s, size in zip(*_groups(*keys), strict=True):
            here = tuple(int(k[s]) for k in keys)
            if held and here != at:
                yield _links(pa.Table.from_batches(held), at[1] == at[2])
                held = []
            at = here
            held.append(batch.slice(s, size))
    if held:
        yield _links(pa.Table.from_batches(held), at[1] == at[2])


def cluster_links(members: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(u, v): verified links that connect all that verified pairs of ``members`` (cluster, node, label, n, the fingerprint's parts) of one cluster connect.

    A cluster is cut into tiles by its nodes' hashes, as many as its shingles ask for, and each pair of tiles goes to a task of its own.
    """
    rows = members.withColumnRenamed("n", "size")
    tiles = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / TILE_SHINGLES).alias("tiles"))
    rows = joined_with(rows, tiles, ["cluster"], rows.count()).drop("n").withColumnRenamed("size", "n")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).join(sets, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("cluster", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "label", "n", *PRINTS, "set")
    return rows.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(verified_tiles, "u long, v long")


def _common(texts: DataFrame) -> np.ndarray:
    """The commonest shingles of about SOUGHT texts."""
    every = max(1, texts.count() // SOUGHT)
    some = texts.filter(F.pmod("node", F.lit(every)) == 0).select("node", "text").dropDuplicates(["node"])
    sets = some.mapInArrow(whole_sets(8, b"\xff"), "node long, set array<long>")
    top = sets.select(F.explode("set").alias("token")).groupBy("token").count().filter(F.col("count") > 2).orderBy(F.col("count").desc(), "token").limit(COMMON)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], dtype=np.int64).view(np.uint64))


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the texts that ``nodes`` names.  A filter of bounded size keeps most others from being read again."""
    bits, table = bit_filter(nodes, nodes.count())
    found = texts.select("node", "text").mapInArrow(whole_sets(bits, table), "node long, set array<long>").dropDuplicates(["node"])
    return staged(found.join(nodes, "node", "left_semi"), "sets")


def _met(pairs: DataFrame, sets: DataFrame, side: str, name: str, n_pairs: int) -> DataFrame:
    """``pairs`` with the set of one side; a text with very many pairs is copied, and its pairs dealt over the copies."""
    each = max(LINKS_EACH, n_pairs // MOST_HOT)
    hot = pairs.groupBy(F.col(side).alias("h")).agg(F.ceil(F.count(F.lit(1)) / each).alias("copies")).filter("copies > 1")
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    other = "b" if side == "a" else "a"
    asked = pairs.join(hot, F.col(side) == F.col("h"), "left").withColumn("turn", F.when(F.col("h").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(other), "copies"))).drop("h", "copies")
    given = sets.join(hot, F.col("node") == F.col("h"), "left").select(F.col("node").alias("_node"), F.col("set").alias(name), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("_turn"))
    return asked.join(given, (F.col(side) == F.col("_node")) & (F.col("turn") == F.col("_turn"))).drop("_node", "_turn", "turn")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    n = pairs.count()
    both = _met(_met(pairs, sets, "b", "y", n), sets, "a", "x", n)
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) of the different texts of ``docs`` with their smallest id, and (node, root) of those that others are near to."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), _node().alias("node"), "text")
    known = staged(texts.mapInArrow(sketches(_common(texts)), SKETCH), "sketches")
    total = known.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // ROWS_EACH)
    rows = known.select(F.explode("prefix").alias("key"), "node").repartition(parts, "key")
    dealt = staged(rows.mapInArrow(deal_first, "key long, part long, node long"), "dealt")
    meta = known.select("node", "n", *PRINTS).dropDuplicates(["node"])

    def turn(dealt: DataFrame, first: bool) -> DataFrame:
        full = dealt.join(meta, "node").select("key", "part", "node", "label", "n", *PRINTS).repartition(parts, "key", "part")
        return full.mapInArrow(match(first), "a long, b long, key long, node long")

    found = staged(turn(dealt.withColumn("label", F.col("node")), True), "candidates")
    pairs = staged(found.filter("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    nodes = staged(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    sets = _sets(texts, nodes)
    edges = staged(verified(pairs, sets), "near")
    labels = components(edges)
    rest = found.filter("key IS NOT NULL").select("key", "node").distinct().join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    left = staged(rest.repartition(parts, "key").mapInArrow(deal, "key long, part long, node long, label long"), "left")
    if not left.isEmpty():
        alike = staged(turn(left, False).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "alike")
        own = F.coalesce("root", "node").alias("label")
        found = components(alike).select("node", F.col("root").alias("cluster"))
        found = found.union(found.select(F.col("cluster").alias("node"), "cluster").distinct())  # a root has no row of its own there
        members = found.join(meta, "node").join(labels, "node", "left")
        members = staged(members.select("cluster", "node", own, "n", *PRINTS), "members")
        unread = members.select("node").distinct().join(nodes, "node", "left_anti")
        if not unread.isEmpty():  # texts of keys that were cut
            sets = sets.unionByName(_sets(texts, staged(unread, "unread")))
        more = staged(cluster_links(members, sets, parts), "near")
        if not more.isEmpty():
            labels = components(edges.union(more))
    return known.groupBy("node").agg(F.min("id").alias("id")), labels


def _node():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group that is connected by links of 0.8 or more, the row with the smallest doc_id.

    Defined cases: null and empty texts and those without words are near each other; equal texts leave one row; a null doc_id
    sorts after every other; of rows that tie in doc_id the text with the smallest hash stays, once; an empty table
    gives an empty result; other columns pass through, whatever their names.  Texts are named by a 64-bit hash.
    """
    nodes, labels = near_groups(docs)
    firsts = nodes.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "node")).alias("f")).select(F.col("f.id").alias("_id"), F.col("f.node").alias("_node"))
    own = docs.select(boxed(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), _node().alias("_node"))
    one = Window.partitionBy("_id", "_node").orderBy(F.col("_own.text").asc_nulls_last())
    return own.join(firsts, ["_id", "_node"]).withColumn("_row", F.row_number().over(one)).filter("_row = 1").select(*unboxed(docs))
