"""Repeated byte strings by enhanced suffix arrays, and documents without their later copies.

The maximal repeats of a set of strings are the nodes of the tree of common-prefix intervals of its suffix array whose
occurrences differ in the byte to their left.  A stack scan over the array of common prefixes visits that tree, and each
node gives its string's length and all its occurrences.

A suffix array of a whole corpus fits no machine, so it is dealt out by content.  Every window of ``least`` bytes has an
anchor, its substring of ``ANCHOR`` bytes with the smallest hash, which is the same wherever the window stands.

1. Tasks send the hashes of their anchors to shards; a shard reports those that more than one text holds.
2. Texts cut out the context of each such anchor, which is all windows that hold it; equal contexts of a task are sent once,
   with the smallest document id.
3. A shard builds the suffix array of its contexts and scans its intervals: of each context, which windows also start in a
   context of a smaller id.
4. Texts put the answers together and cut the bytes out.

Anchors that very many texts hold send their windows one by one, dealt by the window's own hash, so that a passage which is
in a third of all documents, or whose surroundings differ in each, is in no shard as a whole.  Equal texts are one class
from the start.  Rows that move are packed and compressed arrays.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import NULL_ID, documents, numbered_parts, part_keys, parts_of

LEAST = 50
ANCHOR = 24
#: An anchor in more texts than this sends single windows.
HOT = 2000
#: Texts are dealt to parts, and as many groups of this many shards judge their anchors and contexts.
SHARDS_EACH = 4
BATCH_BYTES = 2 << 20
BASE, MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x94D049BB133111EB
U64 = np.uint64


# --- the suffix array and its tree


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of each node of the interval tree with at least ``least`` common bytes and diverse left bytes.

    lcp[i] is what suffixes i - 1 and i have in common; left[i] is the byte before suffix i, or a value of its own at an edge.
    Open intervals are on the stack as [length, first, one left byte or None if they differ].
    """
    stack: list[list] = []
    values, n = lcp.tolist(), len(lcp)
    before = left.tolist()
    for i in range(1, n + 1):
        common = values[i] if i < n else -1
        low, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > common:
            length, low, own = stack.pop()
            byte = own if own == byte else None
            if byte is None:
                yield length, low, i
        if common >= least:
            if stack and stack[-1][0] == common:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([common, low, byte])
        elif stack:
            raise AssertionError("an interval stayed open")


def suffix_order(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of the suffixes data[at:ends], which are short."""
    width = int((ends - at).max())
    wide = -(-width // 8) * 8
    grid = at[:, None] + np.arange(wide)
    inside = grid < ends[:, None]
    chars = np.where(inside, data[np.minimum(grid, len(data) - 1)], 0).astype(np.uint8)
    keys = chars.reshape(len(at), wide // 8, 8).view(">u8")[:, :, 0].astype(U64)
    order = np.lexsort((ends - at, *keys.T[::-1]))
    chars, sizes = chars[order], (ends - at)[order]
    differ = chars[1:] != chars[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.zeros(len(at), dtype=np.int64)
    lcp[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return order, lcp


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``size`` bytes, by doubling."""
    now, n, done, have = (data.astype(U64) + U64(1)) * U64(MIX1), 1, None, 0
    now ^= now >> U64(29)
    while True:
        if size & n:
            if done is None:
                done, have = now, n
            else:
                done, have = done[: len(now) - have] * U64(pow(BASE, n, 1 << 64)) + now[have:], have + n
        if 2 * n > size:
            break
        now, n = now[:-n] * U64(pow(BASE, n, 1 << 64)) + now[n:], 2 * n
    out = done ^ (done >> U64(32))
    out *= U64(MIX2)
    return out ^ (out >> U64(29))


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Smallest or largest of each ``size`` neighbours, by doubling."""
    n = 1
    while 2 * n <= size:
        values, n = best(values[:-n], values[n:]), 2 * n
    return best(values[: -(size - n)], values[size - n :]) if n < size else values


def repeat_groups(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, position)]) of each maximal repeat of ``least`` bytes or more, all occurrences.  For texts that fit a task."""
    data, offs, at, ends = _laid_out(texts, least)
    if not len(at):
        return
    order, lcp = suffix_order(data, at, ends)
    at = at[order]
    of = np.searchsorted(offs, at, "right") - 1
    left = np.where(at == offs[of], -1 - np.arange(len(at)), data[at - 1])
    for length, lo, hi in intervals(lcp, left, least):
        yield length, sorted((int(of[i]), int(at[i] - offs[of[i]])) for i in range(lo, hi))


def _laid_out(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, their offsets, and where suffixes of ``least`` bytes or more begin and end."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offs = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - least + 1, 0)
    at = np.repeat(offs, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, offs, at, np.repeat(offs + sizes, n)


def earlier_windows(contexts: list[bytes], ids: np.ndarray, least: int) -> list[int]:
    """Of each context, a bit per window: whether the window also starts in a context of a smaller id."""
    masks = [0] * len(contexts)
    data, offs, at, ends = _laid_out(contexts, least)
    if not len(at):
        return masks
    of = np.searchsorted(offs, at, "right") - 1
    # Suffixes that share their first window with no other have no interval; nor, with their likes, do those whose left bytes agree.
    key = rolling(data, least)[at]
    order = np.argsort(key, kind="stable")
    key, at, ends, of = key[order], at[order], ends[order], of[order]
    edge = at == offs[of]
    left = np.where(edge, 256, data[at - 1])
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    diverse = (np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)) | np.maximum.reduceat(edge, starts)
    use = np.repeat((size > 1) & diverse, size)
    at, ends, of, left, edge = at[use], ends[use], of[use], left[use], edge[use]
    if not len(at):
        return masks
    order, lcp = suffix_order(data, at, ends)
    at, of, own = at[order], of[order], np.where(edge, -1 - np.arange(len(at)), left)[order]
    first, owner = (at - offs[of]).tolist(), of.tolist()
    rank = ids[of]
    for length, lo, hi in intervals(lcp, own, least):
        some = rank[lo:hi]
        run = (1 << (length - least + 1)) - 1
        for i in np.flatnonzero(some > some.min()).tolist():
            masks[owner[lo + i]] |= run << first[lo + i]
    return masks


# --- packed rows


def _pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def _pack_sorted(values: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as their differences, byte by byte, which compress well."""
    return np.diff(values, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()


def _unpack_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view("<u8")[:, 0], dtype=U64)


def _sent(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], names=["p", "z"])


MESSAGE = "p int, z binary"


# --- anchors


def anchors(data: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in data, hash) of the anchors of texts that lie end to end in ``data``."""
    if len(data) < least:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=U64),)
    of = np.repeat(np.arange(len(sizes)), sizes)
    h = rolling(data, ANCHOR) | U64(1)
    width = least - ANCHOR + 1
    lowest = sliding(h, width, np.minimum)
    inside = of[: len(lowest)] == of[least - 1 :]
    edge = np.zeros(width - 1, dtype=U64)
    seen = sliding(np.concatenate([edge, np.where(inside, lowest, U64(0)), edge]), width, np.maximum)
    at = np.flatnonzero(seen == h)
    return of[at], at, h[at]


def _batches(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, the texts end to end, their sizes), several times ``limit`` bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit or i + 1 == len(texts):
            part = texts[start : i + 1]
            yield start, np.frombuffer(b"".join(part), dtype=np.uint8), np.array([len(x) for x in part], dtype=np.int64)
            start, held = i + 1, 0


def send_anchors(parts: int | list[int], least: int):
    """Rows (cls, text) to messages: to each group the anchors that its shards have to count, with their texts' classes."""
    keys = numbered_parts(parts)
    shards = SHARDS_EACH * len(keys)

    def flush(classes: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        text, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((text, h, h % U64(shards)))
        text, h = text[order], h[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
        text, h = text[fresh], h[fresh]
        shard = (h % U64(shards)).astype(np.int64)
        ends = np.flatnonzero(np.r_[shard[1:] != shard[:-1], True]) + 1
        known, rows, start = np.array(classes, dtype=np.int64), defaultdict(list), 0
        for end in ends.tolist():
            used, local = np.unique(text[start:end], return_inverse=True)
            s = int(shard[start])
            rows[keys[s % len(keys)]].append((s, known[used], local.astype(np.uint16 if len(used) < 65536 else np.uint32), _pack_sorted(h[start:end])))
            start = end
        return _sent([(g, _pack(*found)) for g, found in rows.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        classes, found, held = [], [], 0
        for b in batches:
            texts, names = [], []
            for cls, text in zip(b.column("cls").to_pylist(), b.column("text"), strict=True):
                if cls not in seen:
                    seen.add(cls)
                    texts.append((text.as_py() or "").encode())
                    names.append(int.from_bytes(cls[:8], "little", signed=True))
            for start, data, sizes in _batches(texts):
                text, _, h = anchors(data, sizes, least)
                found.append((text + start + len(classes), h))
                held += len(h)
            classes += names
            if held > 4_000_000:
                yield from flush(classes, found).to_batches()
                classes, found, held = [], [], 0
        if held:
            yield from flush(classes, found).to_batches()

    return run


def count_anchors(parts: int | list[int]):
    """One group's messages to messages: to each part the anchors of its texts that several texts hold, and which of them are hot."""
    keys = numbered_parts(parts)

    def repeated(messages: list[tuple]) -> Iterator[tuple[int, tuple]]:
        h = np.concatenate([_unpack_sorted(planes) for _, _, planes in messages])
        c = np.concatenate([known[local] for known, local, _ in messages])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        h, c = h[fresh], c[fresh]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[starts, len(h)])
        n = np.repeat(n, n)
        h, c, hot = h[n > 1], c[n > 1], (n > HOT)[n > 1]
        part = c % len(keys)
        order = np.lexsort((h, part))
        part, h, hot = part[order], h[order], hot[order]
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, [p, p + 1])
            u, at = np.unique(h[lo:hi], return_index=True)
            yield keys[p], (_pack_sorted(u), np.packbits(hot[lo:hi][at]))

    def run(table):
        shards, rows = defaultdict(list), defaultdict(list)
        for z in table.column("z").to_pylist():
            for s, *message in _unpack(z):
                shards[s].append(message)
        for s in sorted(shards):
            for p, found in repeated(shards.pop(s)):
                rows[p].append(found)
        return _sent([(p, _pack(*found)) for p, found in rows.items()])

    return run


def send_texts(parts: int | list[int]):
    """Rows (cls, id, text) to rows (p, cls, id, z): a class once per task, with its smallest id."""
    keys = numbered_parts(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for b in batches:
            ids, texts, names = [], [], []
            for cls, i, text in zip(b.column("cls").to_pylist(), b.column("id").to_pylist(), b.column("text"), strict=True):
                if cls not in least:
                    names.append(cls)
                    texts.append(zstandard.compress((text.as_py() or "").encode(), 3))
                    ids.append(i)
                elif i < least[cls]:  # the class has been sent with another id: only the id follows
                    names.append(cls)
                    texts.append(None)
                    ids.append(i)
                least[cls] = min(i, least.get(cls, i))
            ps = [keys[int.from_bytes(c[:8], "little", signed=True) % len(keys)] for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(names, pa.binary()), pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["p", "cls", "id", "z"])

    return run


class Part:
    """The texts of a part, and the contexts of their repeated anchors by shard."""

    def __init__(self, rows: pa.Table, news: pa.Table, parts: int, least: int):
        ids: dict[bytes, int] = {}
        packed: dict[bytes, bytes] = {}
        for cls, i, z in zip(*(rows.column(c).to_pylist() for c in ("cls", "id", "z")), strict=True):
            ids[cls] = min(i, ids.get(cls, i))
            if z is not None:
                packed[cls] = z
        self.classes = sorted(packed)
        self.ids = [ids[c] for c in self.classes]
        self.packed = [packed[c] for c in self.classes]
        self.shards, self.least = SHARDS_EACH * parts, least
        told = [found for z in news.column("z").to_pylist() for found in _unpack(z)]
        hs = [_unpack_sorted(planes) for planes, _ in told]
        h = np.concatenate(hs) if hs else np.empty(0, dtype=U64)
        hot = np.concatenate([np.unpackbits(bits)[: len(x)] for x, (_, bits) in zip(hs, told, strict=True)]) if hs else np.empty(0, dtype=np.uint8)
        order = np.argsort(h)
        self.h, self.hot = h[order], hot[order].astype(bool)

    def batches(self) -> Iterator[tuple[int, list[bytes], bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first class, texts, them end to end, class, begin, end and shard of each context)."""
        start, texts, held = 0, [], 0
        for i, z in enumerate(self.packed):
            texts.append(zstandard.decompress(z))
            held += len(texts[-1])
            if held >= BATCH_BYTES or i + 1 == len(self.packed):
                yield start, texts, *self.contexts(texts)
                start, texts, held = i + 1, [], 0

    def contexts(self, texts: list[bytes]) -> tuple:
        whole = b"".join(texts)
        data, sizes = np.frombuffer(whole, dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
        text, at, h = anchors(data, sizes, self.least)
        if not len(self.h):
            none = np.empty(0, dtype=np.int64)
            return whole, none, none, none, none
        place = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[place] == h
        text, at, h, hot = text[known], at[known], h[known], self.hot[place[known]]
        begins = np.cumsum(sizes) - sizes
        lo = np.maximum(at - (self.least - ANCHOR), begins[text])
        hi = np.minimum(at + self.least, begins[text] + sizes[text])
        shard = (h % U64(self.shards)).astype(np.int64)
        if hot.any():  # single windows, each once, by their own hash
            n = (hi - lo - self.least + 1)[hot]
            ws = np.unique(np.repeat(lo[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            own = np.searchsorted(begins, ws, "right") - 1
            by = (rolling(data, self.least)[ws] % U64(self.shards)).astype(np.int64)
            text, lo, hi, shard = np.r_[text[~hot], own], np.r_[lo[~hot], ws], np.r_[hi[~hot], ws + self.least], np.r_[shard[~hot], by]
        return whole, text, lo, hi, shard


def send_contexts(parts: int | list[int], least: int):
    """A part's texts and the repeated anchors to messages: to each group, by shard, the part's different contexts, sorted, with their smallest ids."""

    keys = numbered_parts(parts)

    def run(key, rows, news):
        part = Part(rows, news, len(keys), least)
        found: dict[int, dict[bytes, int]] = defaultdict(dict)
        for start, _, whole, text, lo, hi, shard in part.batches():
            for t, a, b, s in zip(text.tolist(), lo.tolist(), hi.tolist(), shard.tolist(), strict=True):
                c, i, own = whole[a:b], part.ids[start + t], found[s]
                if own.get(c, i) >= i:
                    own[c] = i
        out = defaultdict(list)
        for s in sorted(found):
            out[keys[s % len(keys)]].append((s, *_listed(found.pop(s))))
        me = key[0].as_py()
        return _sent([(g, _pack(me, *lists)) for g, lists in out.items()])

    return run


def _listed(own: dict[bytes, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    names = sorted(own)
    return b"".join(names), np.array([len(c) for c in names], dtype=np.uint8), np.array([own[c] for c in names], dtype=np.int64)


def judge_contexts(least: int):
    """One group's contexts to messages: to each part, by shard and in the order it sent them, the smallest id and the earlier windows of each."""

    def run(table):
        shards, out = defaultdict(list), defaultdict(list)
        for z in table.column("z").to_pylist():
            sender, *lists = _unpack(z)
            for s, *found in lists:
                shards[s].append((sender, *found))
        for s in sorted(shards):
            ids: dict[bytes, int] = {}
            lists = []
            for sender, whole, sizes, own in shards.pop(s):
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                names = [whole[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
                lists.append((sender, names))
                for c, i in zip(names, own.tolist(), strict=True):
                    if ids.get(c, i) >= i:
                        ids[c] = i
            contexts = sorted(ids)
            masks = dict(zip(contexts, earlier_windows(contexts, np.array([ids[c] for c in contexts], dtype=np.int64), least), strict=True))
            for p, names in lists:
                out[p].append((s, np.array([ids[c] for c in names], dtype=np.int64), np.array([masks[c] for c in names], dtype=U64)))
        return _sent([(p, _pack(*found)) for p, found in out.items()])

    return run


RESULT = ("cls", "first", "n_removed", "n_spans", "kept_sha256")


def cut_texts(parts: int | list[int], least: int, whole_texts: bool = False):
    """A part's texts, the repeated anchors and the shards' answers to a row per class: what is cut and what stays."""
    n_parts = len(numbered_parts(parts))

    def run(rows, told):
        first = told.column("kind").to_numpy(zero_copy_only=False) == 0
        part = Part(rows, told.filter(pa.array(first)), n_parts, least)
        numbers: dict[int, dict[bytes, int]] = defaultdict(dict)
        batches = []
        for start, texts, whole, text, lo, hi, shard in part.batches():
            mine = np.empty(len(text), dtype=np.int64)
            for j, (a, b, s) in enumerate(zip(lo.tolist(), hi.tolist(), shard.tolist(), strict=True)):
                own = numbers[s]
                mine[j] = own.setdefault(whole[a:b], len(own))
            batches.append((start, texts, whole, text, lo, hi, shard, mine))
        offset, ids, masks, n = np.zeros(part.shards, dtype=np.int64), [], [], 0
        for shard, least_ids, earlier in (found for z in told.filter(pa.array(~first)).column("z").to_pylist() for found in _unpack(z)):
            own, offset[shard] = numbers.pop(shard), n
            place = np.empty(len(own), dtype=np.int64)
            place[[own[c] for c in sorted(own)]] = np.arange(len(own))  # the answer's order is that of the sorted contexts
            ids.append(least_ids[place])
            masks.append(earlier[place])
            n += len(own)
        if numbers:
            raise ValueError("a shard did not answer")
        ids = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
        masks = np.concatenate(masks) if masks else np.empty(0, dtype=U64)
        known = np.array(part.ids, dtype=np.int64)
        out = []
        for start, texts, whole, text, lo, hi, shard, mine in batches:
            at = offset[shard] + mine
            later = ids[at] < known[start + text]
            begin, end = [lo[later]], [hi[later]]
            some = np.flatnonzero(~later & (masks[at] != 0))
            lo, masked = lo[some], masks[at[some]]
            for w in range(least - ANCHOR + 1):
                hit = lo[(masked >> U64(w)) & U64(1) == 1] + w
                begin.append(hit)
                end.append(hit + least)
            cover = np.bincount(np.concatenate(begin), minlength=len(whole) + 1) - np.bincount(np.concatenate(end), minlength=len(whole) + 1)
            gone = np.cumsum(cover[:-1]) > 0
            data, at = np.frombuffer(whole, dtype=np.uint8), 0
            for k, t in enumerate(texts):
                g = gone[at : at + len(t)]
                kept = t if not g.any() else data[at : at + len(t)][~g].tobytes()
                spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if len(g) else 0
                row = (part.classes[start + k], part.ids[start + k], int(g.sum()), spans, hashlib.sha256(kept).hexdigest())
                if whole_texts:
                    edges = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    row += ([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], kept)
                out.append(row)
                at += len(t)
        types = dict(zip(RESULT, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))
        if whole_texts:
            types |= {"spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST, whole_texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``whole_texts`` also spans, what was cut, and kept, the bytes that are left.

    A byte goes if a string of ``least`` bytes that covers it also starts in a document of a smaller doc_id.  Defined cases:
    a null text is empty; texts shorter than ``least`` bytes lose nothing; a null doc_id sorts after every other; documents of
    the same doc_id take nothing from each other; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    if not ANCHOR < least <= 80:
        raise ValueError("least: 25 to 80 bytes")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(F.sha2(text, 256)).alias("cls"), text.alias("text"))
    parts = part_keys(spark, parts_of(rows.select("text")))
    dealt = lambda df: df.repartition(len(parts), "p")
    counted = dealt(rows.select("cls", "text").mapInArrow(send_anchors(parts, least), MESSAGE)).groupBy("p").applyInArrow(count_anchors(parts), MESSAGE)
    texts = dealt(rows.mapInArrow(send_texts(parts), "p int, cls binary, id long, z binary"))
    contexts = texts.groupBy("p").cogroup(dealt(counted).groupBy("p")).applyInArrow(send_contexts(parts, least), MESSAGE)
    answers = dealt(contexts).groupBy("p").applyInArrow(judge_contexts(least), MESSAGE)
    told = dealt(counted.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1))))
    more = ", spans array<struct<start:long,end:long>>, kept binary" if whole_texts else ""
    found = texts.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(cut_texts(parts, least, whole_texts), "cls binary, first long, n_removed long, n_spans long, kept_sha256 string" + more)
    keys = rows.select("id", F.col("cls").alias("_cls"), F.octet_length("text").cast("long").alias("n_bytes"))
    out = keys.join(found, F.col("cls") == F.col("_cls"))
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= least)
    return out.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([
            F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.col("spans")).alias("spans"),
            F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        ] if whole_texts else []),
    )


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
