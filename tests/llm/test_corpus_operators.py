"""Each operator against a brute-force restatement, on rows chosen to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lmdata.llm import components, exact_dedup, line_dedup, media, mixing, packing, pii, repeats, secrets, simhash, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, p int, key string, _id long, _own string, copies long, rank long"


def words(rng, n, vocabulary=400):
    return " ".join(f"{'bcdfgh'[rng.randrange(6)]}{'aeiou'[rng.randrange(5)]}{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=3):
    """Nulls in any column, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage, line = words(rng, 60), words(rng, 55)
    texts = [None, "", "", " ", "a", "a\n", "é漢😀 " * 40, words(rng, 4000), words(rng, 4000), passage, f"x {passage} y", f"{words(rng, 80)}\n{line}\n{words(rng, 30)}", f"{line}\n{words(rng, 12)}"]
    long = words(rng, 90)
    texts += [long, long, long + " z", long.replace(" ", "  ", 3), long.upper(), "x" * 300, "x" * 300 + "y", "\n".join([line, line, "", words(rng, 9)])]
    texts += [words(rng, rng.randrange(1, 120)) + ("\n" + passage if i % 4 == 0 else "") for i in range(40)]
    rows = [(i * 3 % 101, t, None if i % 5 == 0 else "en", [None, "b", "a", "ü"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], (None, long, "en", "a"), (None, None, None, None)]
    return [(*r, None, 1, 2, 3, "k", 4, "o", 5, 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), COLUMNS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def key(i):
    return (1 << 62) if i is None else i


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (repeats.remove_repeats, line_dedup.dedup_lines, simhash.groups, simhash.near_dedup, exact_dedup.dedup, media.media, mixing.mix, mixing.mixed, packing.pack, pii.find_personal_data, secrets.find_secrets):
        assert run(empty).count() == 0, run
    assert toxicity.train(empty, labels) is None
    assert toxicity.scored(empty, None).count() == 0


# --- 1


def test_repeats_equal_brute_force(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(key(i), first.get(t[a : a + 50], key(None)))
    want = Counter()
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < key(i):
                gone[a : a + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
    assert any(n for _, _, n, _, _ in want)


def test_single_windows_give_the_same(monkeypatch):
    rng = random.Random(4)
    texts = [("".join(rng.choice("ab") for _ in range(120))).encode() for _ in range(12)] + [b"ab" * 60, b"ab" * 70]
    ids = list(range(len(texts)))
    import pyarrow as pa

    def whole(hot):
        monkeypatch.setattr(repeats, "HOT", hot)
        cls = [hashlib.sha256(t).digest() for t in texts]
        rows = pa.table({"cls": cls, "id": ids, "z": [repeats.zstandard.compress(t) for t in texts]})
        sent = [z for b in repeats.send_anchors(1, 50)(iter([pa.record_batch({"cls": cls, "text": [t.decode() for t in texts]})])) for z in b.column("z").to_pylist()]
        news = repeats.count_anchors(1)(pa.table({"z": sent})).column("z").to_pylist()
        news = pa.table({"z": pa.array(news, pa.binary()), "kind": [0] * len(news)})
        contexts = repeats.send_contexts(1, 50)((pa.scalar(0),), rows, news)
        answers = repeats.judge_contexts(50)(contexts).column("z").to_pylist()
        told = pa.concat_tables([news, pa.table({"z": pa.array(answers, pa.binary()), "kind": [1] * len(answers)})])
        return sorted(repeats.cut_texts(1, 50)(rows, told).to_pylist(), key=lambda r: r["first"])

    assert whole(2000) == whole(1)


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))).encode() for _ in range(6)]
    least = 4
    where = defaultdict(set)
    for t, s in enumerate(texts):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                where[s[a:b]].add((t, a))

    want = set()
    for s, n_where in where.items():
        if len(n_where) > 1:
            left = {texts[t][a - 1 : a] if a else (t, "edge") for t, a in n_where}
            right = {texts[t][a + len(s) : a + len(s) + 1] or (t, a, "edge") for t, a in n_where}
            if len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(n_where))))
    got = {(n, tuple(o)) for n, o in repeats.repeat_groups(texts, least)}
    assert want <= got
    assert all(len({texts[t][a : a + n] for t, a in o}) == 1 for n, o in got)


# --- 2


def test_line_dedup_equals_sql_and_keeps_columns(docs, against_sql):
    against_sql(line_dedup.op2_line_dedup, line_dedup.SQL)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()


def test_line_dedup_cuts_whole_later_runs(spark):
    rng = random.Random(9)
    run = [words(rng, 20) for _ in range(4)]
    own = [words(rng, 30) for _ in range(6)]
    rows = [(1, "\n".join([own[0], *run, own[1]])), (2, "\n".join([*run, own[2]])), (3, "\n".join([own[3], run[0], run[1], own[4]])), (4, "\n".join([own[5], run[1], run[2], run[3]])), (5, "\n".join(run)), (6, None), (7, "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (own[2], 4)
    assert got[3] == (rows[2][1], 0)  # 40 words are too short a run
    assert got[4] == (own[5], 3) and got[5] == ("", 4) and got[6] == (None, 0) and got[7] == ("", 0)


def plain_lines(rows, least=12):
    """(id, positions) of the lines in runs of ``least`` words that also stand at an earlier place."""
    places = [(i, [(p, x) for p, x in enumerate((t or "").split("\n")) if x.split()]) for i, t in sorted(set(rows), key=lambda r: r[0])]
    gone = defaultdict(set)
    for k, (i, x) in enumerate(places):
        for j, y in places[: k + 1]:
            for a in range(len(x)):
                for b in range(len(y) if j != i else a):
                    n = 0
                    while a + n < len(x) and b + n < len(y) and x[a + n][1] == y[b + n][1]:
                        n += 1
                    if sum(len(line.split()) for _, line in x[a : a + n]) >= least:
                        gone[i] |= {p for p, _ in x[a : a + n]}
    return gone


@pytest.mark.parametrize("surroundings", [0, 2, 16])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, surroundings):
    monkeypatch.setattr(line_dedup, "SURROUNDINGS", surroundings)
    rng = random.Random(surroundings)
    pool = [words(rng, rng.randrange(1, 9), 5) for _ in range(14)] + ["", " "]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randrange(0, 14))]
        if i % 3 == 0:
            text += pool[2:7]
        rows.append((i, "\n".join(text)))
    rows += [rows[0], rows[3], rows[3]]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    want = plain_lines(rows)
    assert len(got) == len(rows) and any(want.values())
    for r in got:
        source = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for p, x in enumerate(source) if p not in want[r.doc_id]), (r.doc_id, source)


def test_extension_decides(spark):
    """Two pairs share the same fingerprint line: only where the run around it is long enough both ways does it go."""
    rng = random.Random(11)
    run = [words(rng, 5) for _ in range(9)]
    other = [words(rng, 5) for _ in range(40)]
    rows = [(1, "\n".join([*other[:9], *run, *other[9:18]])), (2, "\n".join([*other[18:27], *run[:8], *other[27:36]])), (3, "\n".join([*other[36:], *run]))]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 45).collect()}
    assert got == {1: 0, 2: 0, 3: 9}


# --- 3


def plain_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    parent = {f: f for _, f in rows}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: key(None))
    for i, f in rows:
        least[find(f)] = min(least[find(f)], key(i))
    want = Counter((i, f"{f:016x}", None if least[find(f)] == key(None) else least[find(f)]) for i, f in rows)
    assert Counter(tuple(r) for r in simhash.groups(docs).collect()) == want


def test_near_dedup_keeps_one_of_each(docs):
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == simhash.groups(docs).select("component_id").distinct().count()


def test_tiles_of_hot_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(48) for _ in range(12)]
    prints = sorted({(b ^ sum(1 << rng.randrange(48) for _ in range(rng.randrange(3)))) | 0xABCD << 48 for b in base for _ in range(12)})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")

    def roots():
        return {(r.node, r.root) for r in components.components(simhash.links(df)).collect()}

    want = roots()
    monkeypatch.setattr(simhash, "TILE", 10)
    assert roots() == want and want


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(8).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}


def test_components_of_few_edges_cost_few_tasks(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(-400, i) for i in range(1000, 1200)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    want = {n: r for n, r in root.items() if n != r}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {r.node: r.root for r in components.components(frame).collect()} == want
    spark.sparkContext.setJobGroup("few", "components of few edges")
    assert components.components(frame).count() == len(want)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 12  # two tables and two counts
    monkeypatch.setattr(components, "WHOLE", 50)  # more edges than a task holds
    assert {r.node: r.root for r in components.components(frame).collect()} == want


# --- 4


def test_exact_dedup_equals_brute_force(docs):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.dedup(docs).collect()
    want = Counter((i, min(groups[t], key=key), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_index_flushes_compacts_and_verifies_bytes():
    index = exact_dedup.Index(memtable_bytes=500)
    rng = random.Random(0)
    texts = [f"text {rng.randrange(40)}".encode() for _ in range(400)]
    digests = np.array([len(t) for t in texts], dtype=np.int64)  # nearly all digests collide
    for at in range(0, 400, 50):
        some = texts[at : at + 50]
        index.add_batch(digests[at : at + 50], [hashlib.sha256(t).hexdigest() for t in some], list(range(at, at + 50)), [1] * 50, some, False)
    got = {e[1]: (e[2], e[3]) for e in index.entries()}
    want = {hashlib.sha256(t).hexdigest(): (texts.index(t), texts.count(t)) for t in set(texts)}
    assert got == want and len(index.runs) == 1


# --- 5


def test_automaton_equals_edit_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    lexicon = ["idiot", "moron", "trash", "loser", "pathetic", "scum"]
    m = toxicity.Matcher(lexicon, ["vequ"], frozenset(["oron"]))
    rng = random.Random(3)
    tried = set(lexicon) | {"vequille", "veq", "oron", "scam", "idiots", "idot", "1diot", "idiiot"}
    for w in lexicon:
        for _ in range(60):
            s = list(w)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randrange(2)] = rng.choice(["", "x", "o"])
            tried.add("".join(s))
    for w in tried - {""}:
        best = min((distance(w, t), t) for t in lexicon)
        hit = m.match(w)
        if w.startswith("vequ") or best[0] == 0:
            assert hit and hit[1] == toxicity.EXACT, w
        elif best[0] == 1 and any(distance(w, t) == 1 and len(t) >= toxicity.FUZZY_LENGTH for t in lexicon) and w != "oron":
            assert hit and hit[1] == toxicity.FUZZY, w
        else:
            assert hit is None, w


def test_stems_take_one_edit():
    m = toxicity.Matcher(["idiot"], ["blight", "vequ"], frozenset(["blghted"]))
    assert m.match("blighted") == (1, toxicity.EXACT) and m.match("blihted") == (1, toxicity.FUZZY_CONTINUED) and m.match("xblightest") == (1, toxicity.FUZZY_CONTINUED)
    assert m.match("blghted") is None and m.match("vqu") is None and m.match("bliht") == (1, toxicity.FUZZY_CONTINUED) and m.match("idot") == (0, toxicity.FUZZY)


def test_lexicon_choice_equals_plain_greedy():
    rng = random.Random(6)
    for _ in range(20):
        docs = [[f"t{rng.randrange(60)}" + rng.choice(["", "-"]) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
        docs = [sorted(set(d)) for d in docs]
        clean = {t: rng.choice([0.0005, 0.002, 0.01]) for d in docs for t in d}
        holders, need, want = defaultdict(set), dict.fromkeys(range(40), 3), {}
        for i, d in enumerate(docs):
            for t in d:
                holders[t].add(i)
        while True:
            lift = {t: len(h) / 40 / clean[t] for t, h in holders.items() if len(h) >= 2}
            lift = {t: v for t, v in lift.items() if v >= toxicity.LEAST_LIFT and t not in want}
            if not lift:
                break
            term = max(lift, key=lambda t: (len(holders[t]) * np.log(lift[t]), not t.endswith("-"), len(t), t))
            want[term] = lift[term]
            for i in holders[term]:
                need[i] -= 1
            full = {i for i in holders[term] if need[i] == 0}
            for h in holders.values():
                h -= full
        assert list(toxicity.cover(docs, clean)) == list(want)


def test_scores_do_not_depend_on_the_partitions(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scores = [{r.doc_id: r.score for r in toxicity.scored(d, toxicity.train(d, labels)).collect()} for d in (docs, docs.repartition(7))]
    assert scores[0] == scores[1]


def test_quotation_counts_less_than_abuse():
    m = toxicity.Matcher(["idiot", "loser"], [])
    abuse, quoted = toxicity.features("you are an idiot", m), toxicity.features('she said "idiot" once', m)
    assert abuse[0] > quoted[0] > 0 and quoted[1] > 0 and toxicity.features("nothing here", m) == [0.0] * 5


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = words(rng, 60).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blighter", "rotter", "wretch"]))
        rows.append((i, " ".join(w), "n"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "what a bligter and rottter you wretch", "n"), (1001, None, "n"), (1002, "", "n"), (None, "fine", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and not any(got[i].held_out for i in range(600) if i not in held)
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1001].score
    assert toxicity.without_toxic(docs, model).columns == docs.columns


# --- 6


def plain_feature(data):
    x = [b - 128 for b in data]
    n = len(x)
    counts = Counter(data).values()
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    parts = [x[k * n // 4 : (k + 1) * n // 4] for k in range(4)]  # a payload is a multiple of 64 bytes
    return float(np.mean(x)) + 128, float(np.sqrt(np.mean(np.square(x)))), crossings, -sum(c / n * np.log2(c / n) for c in counts), "/".join(str(max(map(abs, p))) for p in parts)


def check_media(docs):
    got, want = Counter(), Counter()
    for r in media.digests(docs).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature] += 1
    for r in docs.collect():
        t = (r.text or "").encode()
        data = t + b"\0" * (-len(t) % 64 or (64 if not t else 0))
        wav = media.to_wav(data)
        assert media.from_wav(wav) == data
        mean, rms, crossings, entropy, peaks = plain_feature(data)
        feature = f"mean={mean:.4f};rms={rms:.4f};zc={crossings};entropy={entropy + 0.0:.4f};peaks={peaks}".replace("entropy=-0.0000", "entropy=0.0000")
        want[r.doc_id, len(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), feature] += 1
    fixed = lambda c: Counter({(*k[:-1], k[-1].replace("entropy=-0.0000", "entropy=0.0000")): n for k, n in c.items()})
    assert fixed(got) == want


def test_media_round_trip(docs):
    check_media(docs)
    out = media.media(docs)
    assert {"doc_id", "media", "feature"} <= set(out.columns)
    assert Counter((r.doc_id, bytes(r.media)) for r in out.collect()) == Counter((r.doc_id, media.to_wav(media.payload((r.text or "").encode()))) for r in docs.collect())


@pytest.mark.parametrize("bits", [1 << 27, 8])
def test_shared_chunks_come_from_the_store(spark, monkeypatch, bits):
    """Passages that two, and that all, payloads share, and one that a payload repeats; with a filter that passes everything too."""
    from lmdata.llm import common

    monkeypatch.setattr(common, "MOST_BITS", max(bits, 1 << 15))
    if bits == 8:
        monkeypatch.setattr(media, "bit_filter", lambda values, n: (8, b"\xff"))
    monkeypatch.setattr(media, "HELD", 5000)
    rng = random.Random(12)
    tail, two = words(rng, 1500), words(rng, 900)
    rows = [(i, words(rng, 40) + tail) for i in range(60)] + [(60, two + words(rng, 30)), (61, words(rng, 30) + two), (62, two * 3), (63, words(rng, 5000)), (64, tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    made = media.recipes(df)
    shared = {bytes(r.digest): r.n for r in media.shared_digests(made).collect()}
    assert max(shared.values()) >= 61 and len(shared) > 5
    assert sum(len(r.digests) for r in made.collect()) > 65
    check_media(df)


def test_cuts_follow_the_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    a, b = media.cuts(body), media.cuts(b"ahead of it" + body)
    assert a[-1] == len(body) and all(0 < y - x <= media.MOST for x, y in zip([0, *a], a, strict=False))
    chunks = lambda d, ends: {d[s:e] for s, e in zip([0, *ends], ends, strict=False)}
    assert len(chunks(body, a) & chunks(b"ahead of it" + body, b)) >= len(a) - 2
    assert media.cuts(b"x" * 10) == [10] and media.cuts(b"") == [0] and max(np.diff([0, *media.cuts(b"\0" * 500_000)])) <= media.MOST


# --- 7


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + left * w[s] / total >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * w[s] / total
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_mixing(docs, against_sql):
    against_sql(mixing.op7_mixing, mixing.SQL)
    got = mixing.mix(docs).collect()
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(3))).count() == 0
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len((r.text or "").split())) for r in docs.collect())
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 2 * max(r["size"] for r in got if r.source == s)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())


# --- 8


def test_packing_equals_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        starts = [0, *range(first, len(ids), 2048)]
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(ids)
            want[r.doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    got = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1


def test_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    rng = random.Random(1)
    some = "ab é\n\t 　\xa0漢字😀'sdll 12٣½<|endoftext|>\x1c\x85​_-.,"
    for _ in range(500):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(60)))
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_two_fit_fills_what_greedy_leaves():
    # greedy puts 60 and 30 in a bin of 100; 20 and 20 fill what 30 would take more tightly
    patterns = packing.plan({60: 1, 30: 1, 20: 2}, 100)
    assert patterns[0] == ({60: 1, 20: 2}, 1) and sum(n * k * times for used, times in patterns for n, k in used.items()) == 130
    rng = random.Random(3)
    for _ in range(20):
        histogram = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 300)))
        patterns = packing.plan(dict(histogram), 100)
        packed = Counter()
        for used, times in patterns:
            assert sum(n * k for n, k in used.items()) <= 100
            for n, k in used.items():
                packed[n] += k * times
        assert packed == histogram
    assert packing.plan({}, 100) == []


# --- 9


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    "é漢😀 mail me: a.b@c.de, x_y@z.co.uk.", "a@b.c_d@e.f", "a@b.c.d@e.f g@h", "@a.b a@ a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255", "1.2.3 4", "4111 1111 1111 1111 and 4111-1111-1111-1111 5",
    "4111111111111111 4111111111111112", "1234567890123456 7", "41111111111111111111111", "+1 (017) 555-7713, +44 20 7946 0958.", "+12 34 +1234567 +12345678 +1234567890123456", "5  4111111111111111 9", "7" * 5000, "1.1.1.1\n2.2.2.2",
    "+1 (017) 555-7713 and 4111 1111 1111 1111", "a" * 3000 + "@b.c", "x@y.z@w.v.u", "-1.2.3.4- 10.0.0.255", "", None, "call me: name [at] site [dot] com or 555-123-4567 please", "++1 234 567 89", "4111\t1111", "١٢٣.1.1.1.1",
]


def test_personal_data_equals_brute_force(spark, docs):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = pii.find_personal_data(df).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")).collect()}
    for i, t in enumerate(PRIVATE):
        want = plain_spans(t or "")
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(r.spans.split(","))


def test_em_tells_good_labelers_from_bad():
    rng = random.Random(4)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.6
        say = lambda right: int(true if rng.random() < right else not true)  # noqa: E731, B023
        counts["email", (say(0.95), say(0.9), say(0.55), say(0.9))] += 1
    share, rate = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert share["email"] == pytest.approx(0.6, abs=0.06)
    assert rate["email", "form"][0] - rate["email", "form"][1] > 0.7 > 0.4 > rate["email", "before"][0] - rate["email", "before"][1]


def test_added_spans_on_planted_candidates(spark):
    """True and false looser candidates of each kind, among base ones: which the classifier accepts, by kind."""
    rng = random.Random(21)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def amex():
        body = rng.choice(["34", "37"]) + num(12)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def failing(n):
        while luhn(x := rng.choice("123456789") + num(n - 1)):
            pass
        return x

    name = lambda: rng.choice(["ann", "bob", "zoe.k", "li_w"])
    true = {
        "email": lambda: f"mail me: {name()} [at] site{num(1)} [dot] com today",
        "ip": lambda: "host 2001:" + ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(7)) + " is up",
        "card": lambda: f"amex card {amex()} expires",
        "phone": lambda: f"call me at ({num(3)}) {num(3)}-{num(4)} please",
    }
    false = {
        "email": lambda: f"version{rng.choice('/=_')}x{num(2)}(at)q{num(3)} . zz9/{num(2)}",
        "ip": lambda: "id x/" + ":".join(f"{rng.randrange(16):x}" for _ in range(8)) + "=z",
        "card": lambda: f"isbn {failing(13)} printed",
        "phone": lambda: f"section {num(3)}.{num(3)}.{num(4)}/a",
    }
    base = ["mail ann@site.com", "host 10.1.2.3 up", "card 4111111111111111 ok", "call +1 (017) 555-7713"]
    rows, kind_of = [], {}
    for k in pii.KINDS:
        for made, good in ((true, True), (false, False)):
            for _ in range(40):
                kind_of[len(rows)] = (k, good)
                rows.append(made[k]())
    rows += base * 40
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for k in pii.KINDS:
        caught = [bool(got[i]) for i, (kind, good) in kind_of.items() if kind == k and good]
        wrong = [k in got[i] for i, (kind, good) in kind_of.items() if kind == k and not good]
        assert sum(caught) >= 0.9 * len(caught), (k, sum(caught))
        assert sum(wrong) <= 0.1 * len(wrong), (k, sum(wrong))


def test_cues_stand_alone(spark):
    rows = [(1, "i paid 378282246310005 once"), (2, "isbn 378282246310005 once"), (3, "juno 378282246310005 once")]
    votes = {r.doc_id: r.c_card[0].before for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert votes == {1: 1, 2: 0, 3: -1}


def test_prefix_sums_over_blocks(spark):
    text = "é " + " ".join(f"u{i}@h{i % 7}.org" for i in range(700))
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 700 and r.base_sha256 == hashlib.sha256(",".join(plain_spans(text)).encode()).hexdigest()


# --- 10


def test_secrets_equal_brute_force(spark):
    key16, hexed = "AKIA" + "A1" * 8, "0123456789abcdef0123456789abcdef"
    texts = ['é Token = "abcdef" x', "password: abc", "PASSWD='longenough'", "api_key:abcdef apikey=ghijkl", key16, key16[:-1], "xAKIAAKIA" + "B2" * 9, hexed, hexed[:23], hexed.upper(), f"secret={hexed}", "token = token = abcdefg", "secret:\tabcdefg", "", None, "ſecret=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for i, t in enumerate(texts):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in sorted(found))
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (t, r.spans, base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, n, _ in found) for k in range(3)]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_entropy_by_counts_equals_entropy():
    rng = random.Random(2)
    for _ in range(50):
        s = "".join(rng.choice("abcd0123+/") for _ in range(rng.randrange(1, 60)))
        n = min(20, len(s))
        want = max(-sum(k / n * np.log2(k / n) for k in Counter(s[i : i + n]).values()) for i in range(len(s) - n + 1))
        assert secrets.max_entropy(s) == pytest.approx(want, abs=1e-9)


def test_new_spans_by_class():
    """Random keys of every class are found where no fixed pattern is; what reads as words, paths or dates is not."""
    rng = random.Random(9)
    alphabets = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "digits": "0123456789"}
    least = {"base64": 0.99, "letters": 0.99, "HEX": 0.95, "base32": 0.95, "digits": 0.9}
    for name, signs in alphabets.items():
        found = 0
        for _ in range(400):
            text = "é use " + (s := "".join(rng.choice(signs) for _ in range(40))) + " now"
            found += (6, 3, 6 + len(s)) in secrets.spans(text)
        assert found >= least[name] * 400, (name, found)
    slashed = sum(secrets.is_random("".join(rng.choice(alphabets["base64"] + "/" * 6) for _ in range(40))) for _ in range(1000))
    assert slashed > 970


def test_allow_list():
    for s in ("usr/share/doc/packages/readme-2024", "getHTTPResponseCodeFromServer", "SOME_LONG_CONSTANT_NAME_42", "path/to/some/2024/01/file_name", "qwertyuiopasdfghjklzxcvbnm"):
        assert not secrets.is_random(s), s
    assert secrets.is_random("u35bmu/YvnR17w4RF/pUfk6nWM1xvs3M94iJgce3")
    assert secrets.is_random("kJ8sN2qLx0Zr7VbT4mYw1PdC")
    assert not secrets.is_random("kJ8sN2qLx0Zr7VbT4mYw1PdC", "sha256: ")
    for s in ("123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name", "aaaaaaaaaaaaaaaaaaaaaaaa", "EXAMPLEkJ8sN2qLx0Zr7VbT4", "usr/local/lib/python3/site-packages"):
        assert not secrets.is_random(s), s


def test_repeats_give_texts_and_spans(docs):
    by = {r.doc_id: (r.text or "").encode() for r in docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    for r in repeats.remove_repeats(docs, whole_texts=True).filter("doc_id IS NOT NULL").collect():
        t = by[r.doc_id]
        kept = b"".join(t[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(t)], strict=True))
        assert kept == bytes(r.kept) and hashlib.sha256(kept).hexdigest() == r.kept_sha256 and r.n_spans == len(r.spans) and r.n_removed == len(t) - len(kept)


def test_parts_get_a_partition_each(spark):
    from lmdata.llm import common

    for n in (1, 7, 50):
        keys = common.part_keys(spark, n)
        df = spark.createDataFrame([(k,) for k in keys], "p int").repartition(n, "p").select(F.spark_partition_id().alias("at"))
        assert df.distinct().count() == n == len(set(keys))
