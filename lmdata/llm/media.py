"""Media columns: text payloads as 8-bit audio, stored as content-defined chunks.

A gear hash rolls over each payload and cuts it where some of its bits are zero, so that equal passages tend to give equal
chunks whatever stands before them.  A payload is an ordered list of chunk digests.

1. The lists of all different payloads are made, and a Spark aggregate finds the digests that more than one place holds.
2. Payloads are dealt to parts with the bytes of the chunks that are theirs alone.  Shared chunks go to the store, which is dealt by
   digest and keeps each once.  A filter of bounded size says which chunks those are; when it is full, more go through the store.
3. The lists are joined with the store: it sends each part the chunks that the part's payloads name, each once.
4. Payloads are put together in the order of their lists, wrapped as WAV files, read back through the audio reader, and verified
   against the payload's digest before any feature is computed.

Cuts are found once for the lists and again where bytes are sent: moving the bytes twice would cost more.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import wave
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import bit_filter, documents, part_keys, parts_of, staged

BLOCK = 64
SAMPLE_RATE = 8000
#: Chunk sizes: the hash cuts every ``AVERAGE`` bytes on average, between the other two.
LEAST, AVERAGE, MOST = 128, 512, 8192
LEVEL = 6
DIGEST = 16
#: Bytes of shared chunks that a task holds before it sends them.
HELD = 8 << 20
GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), dtype="<u4")


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    span = 1
    while span < 32:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n]
    found = np.flatnonzero(gear(np.frombuffer(data, dtype=np.uint8)) < np.uint32((1 << 32) // AVERAGE)) + 1  # the top bits are zero
    out, start = [], 0
    for at in [*found.tolist(), n]:
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST or at == n and at > start:
            out.append(at)
            start = at
    return out


def payload(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def feature(samples: bytes) -> str:
    """Level, loudness, zero crossings and entropy of the samples, and peaks of four equal parts."""
    x = np.frombuffer(samples, dtype=np.uint8)
    centred = x.astype(np.int32) - 128
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    crossings = int(np.count_nonzero(np.signbit(centred[1:]) != np.signbit(centred[:-1])))
    peaks = "/".join(str(int(np.abs(part).max())) for part in np.array_split(centred, 4))
    return f"mean={x.mean():.4f};rms={np.sqrt((centred.astype(np.int64) ** 2).mean()):.4f};zc={crossings};entropy={-(p * np.log2(p)).sum():.4f};peaks={peaks}"


def chunks(data: bytes) -> tuple[list[int], list[bytes]]:
    """Ends and digests of a payload's chunks."""
    ends = cuts(data)
    return ends, [hashlib.blake2b(data[s:e], digest_size=DIGEST).digest() for s, e in zip([0, *ends], ends, strict=False)]


def part_of(key: bytes, parts: list[int]) -> int:
    return parts[int.from_bytes(key[:4], "big") % len(parts)]


def _shared(digests: list[bytes], bits: int, table: np.ndarray) -> np.ndarray:
    """Which chunks the filter takes for shared."""
    at = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, DIGEST // 8)[:, 0].astype(np.int64) & (bits - 1)
    return (table[at >> 3] >> (at & 7) & 1).astype(bool)


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to rows (key, digests), a payload once a task."""
    seen: set[bytes] = set()
    for b in batches:
        out = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if key not in seen:
                seen.add(key)
                out.append((key, chunks(payload((text.as_py() or "").encode()))[1]))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.list_(pa.binary()))], names=["key", "digests"])


def send(parts: list[int], bits: int, filled: bytes):
    """Rows (key, text) to messages (p, key, z): a payload's own chunks to its part, shared chunks, without a key, to the store's."""
    schema = pa.schema([("p", pa.int32()), ("key", pa.binary()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, table = zstandard.ZstdCompressor(level=LEVEL).compress, np.frombuffer(filled, dtype=np.uint8)
        seen: set[bytes] = set()
        store: dict[bytes, bytes] = {}
        held = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(schema.types)], schema=schema)

        def flush() -> pa.RecordBatch:
            by = defaultdict(dict)
            for d, x in store.items():
                by[part_of(d, parts)][d] = x
            store.clear()
            return rows([(p, None, pack(pickle.dumps(some))) for p, some in by.items()])

        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    raw = (text.as_py() or "").encode()
                    data = payload(raw)
                    ends, digests = chunks(data)
                    parted = [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                    own = []
                    for x, d, shared in zip(parted, digests, _shared(digests, bits, table).tolist(), strict=True):
                        if not shared:
                            own.append(x)
                        elif d not in store:
                            store[d] = x
                            held += len(x)
                    sizes = np.diff([0, *ends]).astype("<u2" if MOST < 65536 else "<u4")
                    out.append((part_of(key, parts), key, pack(len(raw).to_bytes(8, "little") + len(ends).to_bytes(8, "little") + sizes.tobytes() + b"".join(digests) + b"".join(own))))
            yield rows(out)
            if held > HELD:
                yield flush()
                held = 0
        if store:
            yield flush()

    return run


def ask(parts: list[int], bits: int, filled: bytes):
    """Rows (key, digests) to (p, digest, to): which part of the store has to send what to which part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(filled, dtype=np.uint8)
        for b in batches:
            found = set()
            for key, digests in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = part_of(key, parts)
                found.update((d, to) for d, shared in zip(digests, _shared(digests, bits, table).tolist(), strict=True) if shared)
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([part_of(d, parts) for d, _ in rows], pa.int32()), pa.array([d for d, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.int32())], names=["p", "digest", "to"])

    return run


def _unpack(z: bytes) -> bytes:
    return zstandard.decompress(z)


def give(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """A part of the store and what is asked of it to messages (p, z), one to each part that asks."""
    store: dict[bytes, bytes] = {}
    for key, z in zip(rows.column("key").to_pylist(), rows.column("z").to_pylist(), strict=True):
        if key is None:
            store |= pickle.loads(_unpack(z))
    out = defaultdict(dict)
    for digest, to in zip(asked.column("digest").to_pylist(), asked.column("to").to_pylist(), strict=True):
        out[to][digest] = store[digest]
    return pa.table([pa.array(list(out), pa.int32()), pa.array([zstandard.compress(pickle.dumps(some), LEVEL) for some in out.values()], pa.binary())], names=["p", "z"])


RESTORED = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("media", pa.binary())])


def rebuild(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """A part's payloads, put together from their own chunks and those of the store, stored, read back and verified."""
    foreign: dict[bytes, bytes] = {}
    for z in fetched.column("z").to_pylist():
        foreign |= pickle.loads(_unpack(z))
    held = {k: z for k, z in zip(rows.column("key").to_pylist(), rows.column("z").to_pylist(), strict=True) if k is not None}  # several tasks may have sent a payload
    out = []
    for key, z in held.items():
        packed = _unpack(z)
        n_bytes, n = (int.from_bytes(packed[at : at + 8], "little") for at in (0, 8))
        width = 2 if MOST < 65536 else 4
        sizes = np.frombuffer(packed, dtype=f"<u{width}", count=n, offset=16).tolist()
        at, data = 16 + width * n + DIGEST * n, []
        for k, size in enumerate(sizes):
            digest = packed[16 + width * n + DIGEST * k : 16 + width * n + DIGEST * (k + 1)]
            if (x := foreign.get(digest)) is None:
                x = packed[at : at + size]
                at += size
            data.append(x)
        stored = to_wav(b"".join(data))
        samples = from_wav(stored)
        if hashlib.sha256(samples[:n_bytes]).digest() != key or any(samples[n_bytes:]):
            raise ValueError(f"payload {key.hex()} was not restored")
        out.append((key, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), feature(samples), stored))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(RESTORED.types)], schema=RESTORED)


def recipes(docs: DataFrame) -> DataFrame:
    """(key, digests): the ordered chunk list of each different payload; key is the text's SHA-256."""
    return _keyed(docs).mapInArrow(lists, "key binary, digests array<binary>").dropDuplicates(["key"])


def shared_digests(lists_: DataFrame) -> DataFrame:
    """(digest, n) of the chunks that more than one place holds."""
    return lists_.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))


def restored(docs: DataFrame) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, feature, media) of each different payload, read back from chunks."""
    rows = _keyed(docs)
    parts = part_keys(docs.sparkSession, parts_of(rows.select("text")))
    dealt = lambda df: df.repartition(len(parts), "p")
    made = staged(recipes(docs), "recipes")
    shared = staged(shared_digests(made), "shared")
    bits, table = bit_filter(shared.select(F.conv(F.hex(F.substring("digest", 5, 4)), 16, 10).cast("long").alias("at")), shared.count())
    sent = dealt(rows.mapInArrow(send(parts, bits, table), "p int, key binary, z binary"))
    asked = dealt(made.mapInArrow(ask(parts, bits, table), "p int, digest binary, to int").distinct())
    given = dealt(sent.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(give, "p int, z binary"))
    kinds = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, media binary"
    return sent.groupBy("p").cogroup(given.groupBy("p")).applyInArrow(rebuild, kinds)


def _by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    keys = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("_key"))
    return keys.join(found, keys["_key"] == found["key"]).drop("_key", "key")


def media(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, its stored payload (media, a WAV file), and what that gives when it is read back.

    Defined cases: a null text is empty, and an empty one is stored as 64 zero bytes; rows with equal texts share one
    stored payload; null ids and repeated rows keep a row each; an empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    return _by_document(docs, restored(docs))


def digests(docs: DataFrame) -> DataFrame:
    """``media`` with the stored form's size and digest in its place, which are all that moves."""
    found = restored(docs)
    stored = [F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    return _by_document(docs, found.select("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *stored, "feature"))


def op6_media(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
