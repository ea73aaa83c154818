"""The pipeline's near dedup against all pairs by brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from lmdata.llm import near_copies, simhash


def kept(rows):
    """Ids that stay when one text of each group that links of 0.8 connect is kept, the first."""
    sets = [(i, set(near_copies.shingles((t or "").encode()).tolist())) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if root[i] == i)


def texts(seed=5):
    draw = random.Random(seed)
    base = [[str(draw.randrange(10_000)) for _ in range(120)] for _ in range(8)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(8, 88):  # one changed word takes five of 116 shingles on either side
        words = list(base[0] if i < 48 else base[i % 8])
        for _ in range(draw.randrange(1, 5)):
            words[draw.randrange(120)] = "x%d" % draw.randrange(10_000)
        rows.append((i, " ".join(words)))
    for i in range(100, 110):  # a chain: each is near the one before, the ends are far apart
        words = list(base[7])
        words[: 3 * (i - 99)] = ["y%d" % k for k in range(3 * (i - 99))]
        rows.append((i, " ".join(words)))
    return [*rows, (90, ""), (91, " \n"), (92, "one two"), (93, "One  two"), (94, rows[0][1]), (95, "a b c d e f g h"), (96, "a b c d e f g h i"), (97, None)]


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect())


@pytest.mark.parametrize(("group", "tile", "shingles"), [(2, 5, 100), (4, 4096, 1 << 17)])
def test_stage_equals_brute_force(spark, monkeypatch, group, tile, shingles):
    match = near_copies.match
    monkeypatch.setattr(near_copies, "match", lambda first: match(first, group))
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "TILE_SHINGLES", shingles)
    assert stage(spark, texts()) == kept(texts())


def test_a_large_group_costs_few_pairs(spark, monkeypatch):
    """600 copies of one text, near to it but mostly not to each other: the pairs that are verified stay in proportion."""
    draw = random.Random(8)
    base = ["w%d" % draw.randrange(10_000) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 600):
        words = list(base)
        for k in draw.sample(range(0, 300, 6), 5):
            words[k] = "x%d" % draw.randrange(100_000)
        rows.append((i, " ".join(words)))
    asked = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: asked.append(pairs.count()) or verified(pairs, sets))
    assert stage(spark, rows) == [0] and sum(asked) < 20 * 600


def test_second_turn_alone_links_a_whole_group(spark, monkeypatch):
    """Nothing is linked in the first turn here, so that all links, those of a cluster's smallest node too, are the second's."""
    words = ["w%d" % i for i in range(200)]
    rows = [(i, " ".join([*words[: 40 * i], "x", *words[40 * i :]])) for i in range(6)]
    verified, turns = near_copies.verified, []
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: turns.append(1) or verified(pairs, sets).limit(0))
    assert stage(spark, rows) == [0] and turns == [1]


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[max(top(u), top(v))] = min(top(u), top(v))
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shingles", [1, 900, 1 << 17])
def test_tiles_of_clusters_equal_brute_force(spark, monkeypatch, shingles):
    """Two clusters of sets about the threshold, some of one component before: links connect what all verified pairs do, and are a forest a task."""
    monkeypatch.setattr(near_copies, "TILE_SHINGLES", shingles)
    rng, rows = np.random.default_rng(5), []
    for cluster in range(2):
        base = rng.integers(1, 1 << 62, 80, dtype=np.uint64)
        for i in range(30):
            own = base.copy()
            own[rng.choice(80, 3 + i // 3, replace=False)] = rng.integers(1, 1 << 62, 3 + i // 3, dtype=np.uint64)
            own = np.unique(own)
            node = 100 * cluster + i
            rows.append((cluster, node, 100 * cluster if i < 3 else node, len(own), *np.array(near_copies.fingerprint(own), dtype=np.uint64).view(np.int64).tolist(), own))
    fields = ", ".join(f"{f} long" for f in near_copies.PRINTS)
    members = spark.createDataFrame([r[:-1] for r in rows], f"cluster long, node long, label long, n long, {fields}")
    sets = spark.createDataFrame([(r[1], r[-1].view(np.int64).tolist()) for r in rows], "node long, set array<long>")
    before = [(100 * c, 100 * c + k) for c in range(2) for k in (1, 2)]
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and 9 * len(np.intersect1d(a[-1], b[-1])) >= 4 * (a[3] + b[3])]
    got = [(r.u, r.v) for r in near_copies.cluster_links(members, sets, 4).collect()]
    nodes = [r[1] for r in rows]
    assert {tuple(sorted(p)) for p in got} <= set(want)
    assert groups_of(nodes, before + got) == groups_of(nodes, before + want) and 2 < len(set(groups_of(nodes, before + want).values())) < 60
    assert shingles < 1 << 17 or len(got) < len(nodes)


def test_cut_keys_give_all_pairs():
    import pyarrow as pa

    key, node, label = np.zeros(40, dtype=np.int64), np.arange(40), np.r_[np.zeros(25, dtype=np.int64), np.arange(1, 16)]
    old, near_copies.TILE = near_copies.TILE, 4
    try:
        parts = list(near_copies.deal(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(label)], names=["key", "node", "label"])])))
    finally:
        near_copies.TILE = old
    met = {(a, b) for p in parts for a in p["node"].to_pylist() for b in p["node"].to_pylist()}
    assert all((a, b) in met for a in range(40) for b in range(40) if label[a] != label[b]) and max(p.num_rows for p in parts) <= 8


def test_near_pairs_of_wide_fingerprints():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (1300, 4), dtype=np.uint64)
    prints[600:] = prints[:700] ^ (np.uint64(1) << rng.integers(0, 64, (700, 4), dtype=np.uint64))
    radius = np.where(np.arange(1300) == 7, 110, 5)
    got = {(int(a), int(b)) for x, y, _ in simhash.near_pairs(prints, radius) for a, b in zip(x, y, strict=True)}
    differ = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = {(int(a), int(b)) for a, b in np.argwhere(differ <= np.maximum(radius[:, None], radius[None])) if a < b}
    assert got == want and len(got) > 600


def test_radius_holds_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    worst = 0
    for n in (36, 90, 360):
        for _ in range(400):
            h = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            x, y = (np.array(near_copies.fingerprint(s), dtype=np.uint64) for s in (h[:n], h))
            worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= near_copies.RADIUS


def test_pair_beyond_three_bits_is_dropped(spark):
    words = ["w%d" % i for i in range(150)]
    other = [*words[:40], "a", *words[41:90], "b", *words[91:]]
    pair = [(1, " ".join(words)), (2, " ".join(other))]
    prints = [simhash.fingerprint(t.encode()) for _, t in pair]
    assert (prints[0] ^ prints[1]).bit_count() > simhash.RADIUS
    assert stage(spark, pair) == [1]


def test_empty_and_clashing_columns(spark):
    run = dict(corpus_pipeline.STAGES)["simhash"]
    assert run(spark, spark.createDataFrame([], "doc_id long, text string, node string"), "").columns == ["doc_id", "text", "node"]
    assert run(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "y"), (3, None, "z"), (3, "", "q")]
    out = run(spark, spark.createDataFrame(rows, "doc_id long, text string, node string"), "").collect()
    assert sorted((r.doc_id is None, r.text or "") for r in out) == [(False, ""), (True, "a b c d e f")]
