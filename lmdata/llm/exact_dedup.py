"""Exact dedup with a log-structured merge index.

Each task keeps a memtable of digests.  A full memtable is flushed as a run sorted by digest, with a Bloom filter;
runs of similar length are compacted, keeping the smallest id and the sum of the counts.  A digest that a filter and
then a run report as present is only a hit: the texts themselves are compared before two rows count as equal.

The index runs twice: over each input partition, so that a group of copies leaves a task as one row however large it
is, and over the partitions by digest, which merge what the tasks sent.  Texts in the index are held compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmdata.llm.common import NULL_ID, documents

MEMTABLE_BYTES = 8 << 20
FAN_IN = 4
RUN = pa.schema([("digest", pa.int64()), ("text_sha256", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


class Filter:
    """Bloom filter over 64-bit digests: 10 bits a digest, four probes."""

    def __init__(self, digests: np.ndarray):
        self.size = np.uint64(max(64, 10 * len(digests)))
        self.bits = np.zeros(int(self.size), dtype=bool)
        for p in self.probes(digests.view(np.uint64)):
            self.bits[p] = True

    def probes(self, d: np.ndarray) -> Iterator[np.ndarray]:
        step = (d >> np.uint64(32)) | np.uint64(1)
        for i in range(4):
            yield (d + np.uint64(i) * step) % self.size

    def may_hold(self, d: np.ndarray) -> np.ndarray:
        out = np.ones(len(d), dtype=bool)
        for p in self.probes(d.view(np.uint64)):
            out &= self.bits[p]
        return out


class Run:
    """Entries sorted by digest; entries that share a digest differ in text."""

    def __init__(self, entries: list[list]):
        self.entries = sorted(entries, key=lambda e: e[0])
        self.digests = np.array([e[0] for e in self.entries], dtype=np.int64)
        self.filter = Filter(self.digests)

    def find(self, digest: int) -> list[list]:
        i = int(np.searchsorted(self.digests, digest))
        out = []
        while i < len(self.entries) and self.entries[i][0] == digest:
            out.append(self.entries[i])
            i += 1
        return out


class Index:
    """Entries are [digest, sha256, smallest id, count, packed text]."""

    def __init__(self, memtable_bytes: int = MEMTABLE_BYTES):
        self.limit, self.held, self.memtable, self.runs = memtable_bytes, 0, {}, []
        self.pack, self.unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

    def add_batch(self, digests: np.ndarray, shas: list, ids: list, counts: list, texts: list, packed: bool) -> None:
        maybe = np.zeros(len(digests), dtype=bool)
        known = len(self.runs)
        for run in self.runs:
            maybe |= run.filter.may_hold(digests)
        for i, d in enumerate(digests.tolist()):
            found = self.memtable.get(d, ())
            if maybe[i] or known != len(self.runs):
                found = [*found, *(e for run in self.runs for e in run.find(d))]
            entry = next((e for e in found if self.equal(e, texts[i], packed)), None)
            if entry is not None:
                entry[2], entry[3] = min(entry[2], ids[i]), entry[3] + counts[i]
                continue
            z = texts[i] if packed else self.pack(texts[i])
            self.memtable.setdefault(d, []).append([d, shas[i], ids[i], counts[i], z])
            self.held += len(z) + 200
            if self.held > self.limit:
                self.flush()

    def equal(self, entry: list, text: bytes, packed: bool) -> bool:
        """Byte verification."""
        return entry[4] == text if packed and entry[4] == text else self.unpack(entry[4]) == (self.unpack(text) if packed else text)

    def flush(self) -> None:
        if self.memtable:
            self.runs.append(Run([e for es in self.memtable.values() for e in es]))
            self.memtable, self.held = {}, 0
            while len(self.runs) >= FAN_IN and len(self.runs[-FAN_IN].entries) <= 2 * FAN_IN * len(self.runs[-1].entries):
                self.compact(FAN_IN)

    def compact(self, last: int) -> None:
        """Merge the newest runs; an entry met twice keeps its smallest id and the sum of its counts."""
        merged: dict[int, list[list]] = {}
        for e in (e for run in self.runs[-last:] for e in run.entries):
            twin = next((x for x in merged.get(e[0], ()) if self.equal(x, e[4], True)), None)
            if twin is None:
                merged.setdefault(e[0], []).append(e)
            else:
                twin[2], twin[3] = min(twin[2], e[2]), twin[3] + e[3]
        self.runs[-last:] = [Run([e for es in merged.values() for e in es])]

    def entries(self) -> list[list]:
        self.flush()
        if len(self.runs) > 1:
            self.compact(len(self.runs))
        return self.runs[0].entries if self.runs else []


def _sent(entries: list[list], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(entries), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*entries[i : i + rows], strict=True), RUN, strict=True)], schema=RUN)


def _columns(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(n).to_pylist() for n in names]


def collect_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one input partition (digest, text_sha256, id, norm) to one sorted run."""
    index = Index()
    for b in batches:
        shas, ids = _columns(b, "text_sha256", "id")
        texts = b.column("norm").cast(pa.binary()).to_pylist()
        index.add_batch(b.column("digest").to_numpy(), shas, ids, [1] * len(ids), texts, False)
    yield from _sent(index.entries())


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several tasks sent for the same digests, compacted."""
    index = Index()
    for b in batches:
        shas, ids, counts, texts = _columns(b, "text_sha256", "id", "n", "packed")
        index.add_batch(b.column("digest").to_numpy(), shas, ids, counts, texts, True)
    for b in _sent(index.entries()):
        yield b.select(["text_sha256", "id", "n"])


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text.  A lone space needs no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: null and empty texts are equal; a null doc_id sorts after every other; rows that repeat both doc_id
    and text count one by one in group_size, and exactly one of them is kept if theirs is the smallest id; an empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("id", F.sha2("norm", 256).alias("text_sha256"), "norm")
    runs = rows.withColumn("digest", F.xxhash64("norm")).mapInArrow(collect_runs, "digest long, text_sha256 string, id long, n long, packed binary")
    groups = runs.repartition("digest").mapInArrow(merge_runs, "text_sha256 string, id long, n long")
    groups = groups.select(F.col("text_sha256").alias("_sha"), F.col("id").alias("_keep"), F.col("n").alias("group_size"))
    first = Window.partitionBy("text_sha256", "id").orderBy("id")
    marked = rows.select("id", "text_sha256").withColumn("_row", F.row_number().over(first))
    out = marked.join(groups, marked["text_sha256"] == groups["_sha"])
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return out.select(real("id").alias("doc_id"), real("_keep").alias("keep_id"), "group_size", ((F.col("id") == F.col("_keep")) & (F.col("_row") == 1)).alias("kept"), "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
