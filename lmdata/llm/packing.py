"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only the number of pieces of each length matters for the plan, and there are at most ``capacity`` lengths.  So the plan
is made on that histogram, as bin patterns with a multiplicity; documents then take their places by their rank within
their length.  The driver sees the histogram, never documents, and the plan is bounded by the capacity.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import documents, staged, with_rank

CAPACITY = 2048
END_ID = 0
#: Pieces of a length are ranked in blocks: at least this many, and none with many more rows than the second.
PIECES, BLOCK_ROWS = 64, 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as uint32 arrays, as the tokenizer file gives them without special tokens added.

    A byte-level BPE whose ids follow the order of its merges is run by the faster of the two installed libraries; it is
    built from the same file.  Any other file is run by the library whose format it has.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self.ranked(spec) if self.is_plain(spec) else None
        self.library = None
        if self.fast is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    @staticmethod
    def is_plain(spec: dict) -> bool:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return plain and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(pairs))

    @staticmethod
    def ranked(spec: dict):
        import public_tokenizers
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def token_pieces(path: str, capacity: int):
    """Rows (doc_id, text) to rows (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([END_ID], dtype="<u4")
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                n = len(ids)
                first = n - (n - 1) // capacity * capacity
                starts = [0, *range(first, n, capacity)]
                out += [(i, k, s, e - s, zlib.crc32(ids[s:e])) for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
            if out:
                types = (b.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def two_fit(room: int, left: np.ndarray, used: dict[int, int], least: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is largest within ``room`` and above ``least``."""
    free = left[: room + 1].copy()
    for n, k in used.items():
        if n <= room:
            free[n] -= k
    free[0] = 0
    there = np.flatnonzero(free > 0)
    if not len(there):
        return None
    below = np.zeros(room + 1, dtype=np.int64)
    below[there] = there
    below = np.maximum.accumulate(below)
    a = there[there < room]
    b = np.minimum(below[room - a], a)
    twice = (b == a) & (free[a] < 2)
    b[twice] = below[a[twice] - 1]
    sums = np.where(b > 0, a + b, 0)
    if not len(sums) or sums.max() <= least:
        return None
    k = int(sums.argmax())
    return int(a[k]), int(b[k])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bin patterns {length: pieces of it in a bin} and the number of bins of each.

    A bin starts with the longest piece that is left and is filled greedily by the longest that fits.  Then its smallest
    piece gives way to two unpacked ones wherever they fill the gap that this opens more tightly.  The pattern is used
    as often as the histogram allows, so that the work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    out = []
    longest = capacity
    while True:
        while longest and left[longest] == 0:
            longest -= 1
        if not longest:
            return out
        used, room = {longest: 1}, capacity - longest
        at = min(room, longest)
        while room > 0 and at > 0:
            k = min(int(left[at]) - used.get(at, 0), room // at)
            if k > 0:
                used[at] = used.get(at, 0) + k
                room -= k * at
            at = min(at - 1, room)
        while room > 0 and sum(used.values()) > 1:
            least = min(used)
            used[least] -= 1
            pair = two_fit(room + least, left, used, least)
            used[least] += 1
            if pair is None:
                break
            used[least] -= 1
            used = {n: k for n, k in used.items() if k}
            for n in pair:
                used[n] = used.get(n, 0) + 1
            room += least - sum(pair)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        out.append((used, times))


def slots(patterns: list[tuple[dict[int, int], int]]) -> pa.Table:
    """Which ranks of a length go where: ranks lo to hi - 1 fill ``per`` places a bin, from ``place``, in bins from ``bin`` on."""
    rows, taken, bins = [], {}, 0
    for used, times in patterns:
        place = 0
        for n in sorted(used, reverse=True):
            lo, per = taken.get(n, 0), used[n]
            taken[n] = lo + per * times
            rows.append((n, lo, taken[n], per, place, bins))
            place += per * n
        bins += times
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["s_length", "lo", "hi", "per", "place", "bin"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null text is empty and becomes the single end id; a null doc_id is a document like any other; rows
    that repeat are packed one by one; an empty table gives an empty result; other columns than doc_id and text are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(token_pieces(tokenizer or tokenizer_path(), capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = staged(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    blocks = max(PIECES, max(histogram.values(), default=0) // BLOCK_ROWS)
    placed = F.broadcast(spark.createDataFrame(slots(plan(histogram, capacity)), "s_length long, lo long, hi long, per long, place long, bin long"))
    ranked = with_rank(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))), ["length"], "_part", [F.col("doc_id").asc_nulls_last(), F.col("piece")], "_rank")
    there = (F.col("length") == F.col("s_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    nth = F.col("_rank") - F.col("lo")
    return ranked.join(placed, there).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + nth % F.col("per") * F.col("length")).alias("offset"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
