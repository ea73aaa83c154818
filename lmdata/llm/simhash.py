"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared exactly: 64-bit exclusive-or and bit counts in numpy, tile against tile, where a tile holds
fingerprints of like population count and a pair of tiles is skipped if their counts differ by more than the radius.

Two fingerprints within a radius of 3 agree on at least one of four 16-bit blocks.  So tiles are made within the
fingerprints that share a block value, which loses no link and keeps the work far below all pairs.  Block values
that very many fingerprints share are cut into tiles by population count, and the pairs of tiles are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmdata.llm.common import NULL_ID, boxed, documents, staged, unboxed, with_rank
from lmdata.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = RADIUS + 1
#: Fingerprints of one block value that a task compares at once; more are cut into tiles of this many.
TILE = 4096
STEP = 512
PIECES = 16


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = b" ".join(text.lower().split())  # bytes: only A-Z are lowered, and white space is the contract's
    if not words:
        return 0
    space = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
    starts, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(words)]
    if len(starts) < n:
        return xxhash.xxh64_intdigest(words, SEED)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter([digest(words[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=False)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        whole = len(part) // 255 * 255
        for bit, rows in ((part[:whole], 255), (part[whole:], len(part) - whole)):
            if len(bit):
                bits = np.unpackbits(bit.view(np.uint8).reshape(-1, rows, 8), axis=2, bitorder="little")
                counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint((t.as_py() or "").encode(), n) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])

    return run


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of two arrays sorted by population count, step by step; steps too far apart are skipped."""
    counts = np.bitwise_count(left), np.bitwise_count(right)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(left), STEP):
        a, pa_ = left[i : i + STEP], counts[0][i : i + STEP]
        lo = np.searchsorted(counts[1], int(pa_[0]) - radius, "left")
        hi = np.searchsorted(counts[1], int(pa_[-1]) + radius, "right")
        for j in range(int(lo), int(hi), STEP):
            c = right[j : min(j + STEP, int(hi))]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ c[None, :]) <= radius)
            out.append((x + i, y + j))
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_pairs(prints: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs i < j, and how many bits differ, of wide fingerprints (a row of 64-bit parts each) within the radius of either, a pair of tiles at a time.

    Tiles hold fingerprints of like population count; pairs of tiles are skipped if their counts differ by more than the radius.
    """
    counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    prints, counts, radius, widest = prints[order], counts[order], radius[order], int(radius.max())
    for i in range(0, len(prints), STEP):
        a, most = prints[i : i + STEP], radius[i : i + STEP]
        for j in range(i, len(prints), STEP):
            if counts[j] - counts[min(i + STEP, len(prints)) - 1] > widest:
                break
            c = prints[j : j + STEP]
            differ = np.zeros((len(a), len(c)), dtype=np.uint16)
            for k in range(prints.shape[1]):
                differ += np.bitwise_count(a[:, None, k] ^ c[None, :, k])
            x, y = np.nonzero(differ <= np.maximum(most[:, None], radius[None, j : j + STEP]))
            bits = differ[x, y].astype(np.int64)
            x, y = order[x + i], order[y + j]
            fresh = x != y if i != j else x < y
            x, y = x[fresh], y[fresh]
            yield np.minimum(x, y), np.maximum(x, y), bits[fresh]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches: as many links as nodes say all that the pairs say."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def compare(radius: int):
    """Rows (block, a, b, tile, fp) to links (u, v), a spanning forest of those within the radius in each pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        block, a, b, tile, signed = (table.column(c).to_numpy() for c in ("block", "a", "b", "tile", "fp"))
        fp = signed.view(np.uint64)
        order = np.lexsort((np.bitwise_count(fp), tile, b, a, block))
        block, a, b, tile, fp = block[order], a[order], b[order], tile[order], fp[order]
        ends = np.flatnonzero(np.r_[(np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0), True]) + 1
        sizes = np.diff(np.r_[0, ends])
        starts = ends - sizes
        found: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.flatnonzero((sizes > 1) & (sizes <= 8))
        for off in range(1, 8):  # many small groups at once
            use = small[sizes[small] > off]
            for k in range(8 - off):
                at = starts[use[sizes[use] > off + k]] + k
                near = np.bitwise_count(fp[at] ^ fp[at + off]) <= radius
                found.append((fp[at[near]], fp[at[near] + off]))
        for g in np.flatnonzero(sizes > 8):
            s, e = starts[g], ends[g]
            own, split = fp[s:e], int(np.searchsorted(tile[s:e], b[s], "left")) if a[s] != b[s] else 0
            x, y = linked(own[:split], own[split:], radius) if split else linked(own, own, radius)
            root = forest(len(own), x, y + split)
            away = root != np.arange(len(own))
            found.append((own[away], own[root[away]]))
        u = np.concatenate([x for x, _ in found]).view(np.int64)
        v = np.concatenate([y for _, y in found]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) that connect exactly what is connected within the radius."""
    bits = 64 // (radius + 1)
    blocks = F.array(*[F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit((1 << bits) - 1)) * (radius + 1) + i for i in range(radius + 1)])
    rows = nodes.select("fp", F.explode(blocks).alias("block"))
    hot = rows.groupBy("block").count().filter(F.col("count") > TILE).select(F.col("block").alias("_hot"))
    cold = rows.join(hot, F.col("block") == F.col("_hot"), "left_anti").select("block", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("tile"), "fp")
    many = rows.join(hot, F.col("block") == F.col("_hot"), "left_semi").withColumn("pop", F.bit_count("fp"))
    many = many.withColumn("_place", F.col("pop") * PIECES + F.pmod(F.xxhash64("fp"), F.lit(PIECES)))
    tiled = with_rank(many, ["block"], "_place", [F.col("fp")], "_rank").withColumn("tile", F.floor(F.col("_rank") / TILE).cast("int"))
    spans = tiled.groupBy("block", "tile").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    l, r = spans.select("block", F.col("tile").alias("a"), F.col("hi")), spans.select("block", F.col("tile").alias("b"), F.col("lo"))
    pairs = l.join(r, "block").filter((F.col("a") <= F.col("b")) & (F.col("lo") - F.col("hi") <= radius)).select("block", "a", "b")
    pairs = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("a", "b"))))
    dealt = tiled.join(pairs, ["block", "tile"]).select("block", "a", "b", "tile", "fp")
    return cold.unionByName(dealt).repartition("block", "a", "b").mapInArrow(compare(radius), "u long, v long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Defined cases: null and empty texts have fingerprint zero; a null doc_id sorts after every other, and a component of
    such rows alone has a null component_id; rows that repeat get a row each; an empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    rows = staged(rows.mapInArrow(prints(shingle), "id long, fp long"), "prints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component")
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    out = rows.join(named, F.col("fp") == F.col("_fp"))
    return out.select(real("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("component").alias("component_id"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id, once.

    Defined cases: as in ``groups``; of rows that tie in doc_id the smallest text stays, null last; other columns pass through.
    """
    found = groups(docs, **options)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    own = docs.select(boxed(docs))
    rows = own.join(keep, F.col("_own.doc_id").eqNullSafe(F.col("_id")))
    first = Window.partitionBy("_id").orderBy(F.col("_own.text").asc_nulls_last())
    return rows.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select(*unboxed(docs))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
