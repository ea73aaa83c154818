"""Toxicity scores from a learned lexicon, fuzzy matching and the context of each hit.

The lexicon holds words and word stems that mark toxic documents of the training rows.  Its trie is intersected with a
Levenshtein automaton, so that misspelled terms are found too; the product is made deterministic as words are read, so
a word costs one lookup per character and most die after two or three.  A window of words around each hit tells
quotation (quote marks, reporting words) from abuse (more hits close by).  A logistic regression over these counts is
fitted on the training rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import documents, staged

#: The model is fitted on at most so many labelled rows, those with the smallest hash of the id.
MAX_TRAIN = 12_000
#: Tasks over which the training rows are dealt.
TRAIN_PARTS = 24
FOLDS, HELD_OUT = 5, 0
STEMS = range(3, 8)
#: A term is a candidate from this lift on (its share of toxic documents over that of clean ones), a whole hit from the other.
LEAST_LIFT, WHOLE_LIFT = 8, 200
TOKEN = re.compile(r"\w(?:[\w*@$!]*\w)?")
#: Words this long may differ from a term by one edit; stems this long too, for less.
FUZZY_LENGTH, FUZZY_STEM = 5, 6
EXACT, FUZZY, FUZZY_CONTINUED, QUOTED = 1.0, 0.4, 0.2, 0.3
CONTEXT = 8
QUOTES = "\"'“”„«»‘’"
#: Words that report speech, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes called quote quoted quoting dit écrit cité sagte schrieb zitiert dijo escribió citó".split())
MEMO = 400_000


class Memo(dict):
    """What a function gave for each key so far."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        self[key] = out = self.f(key)
        return out


class Matcher:
    """Lexicon trie x Levenshtein automaton of distance 1, determinised lazily.

    A state is the set of (trie node, edits) that the characters so far can reach.  ``stems`` accept any continuation.
    Both accept with one edit if they are long enough; ``clean`` words, which clean texts hold, are not accepted so.
    """

    def __init__(self, words: list[str], stems: list[str], clean: frozenset[str] = frozenset(), worth: dict[str, float] | None = None):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem, self.long = [-1], [False], [False]
        self.names: list[str] = []
        for name, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for c in name:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.stem.append(False)
                    self.long.append(False)
                node = self.next[node][c]
                self.long[node] |= len(name) >= (FUZZY_STEM if stem else FUZZY_LENGTH)
            if self.term[node] < 0 or stem:
                self.term[node], self.stem[node] = len(self.names), stem
            self.names.append(name)
        self.worth = [(worth or {}).get(name, 1.0) for name in self.names]
        self.clean = clean
        self.states: list[frozenset] = [self.close({(0, 0)})]
        self.ids = {self.states[0]: 0}
        self.steps: list[dict[str, int]] = [{}]
        self.stops: list[list[tuple[int, int]]] = [[]]
        self.memo = Memo(self.match)

    def close(self, state: set) -> frozenset:
        """Adds what a deleted character reaches."""
        return frozenset(state | {(n, 1) for node, e in state if e == 0 for n in self.next[node].values() if self.long[n]})

    def step(self, at: int, c: str) -> int:
        state: set = set()
        for node, e in self.states[at]:
            if (n := self.next[node].get(c)) is not None and (e == 0 or self.long[n]):
                state.add((n, e))
            if e == 0:
                if node == 0 or self.long[node]:
                    state.add((node, 1))
                state.update((n, 1) for n in self.next[node].values() if self.long[n])
        closed = self.close(state)
        to = self.ids.get(closed, -1)
        if to < 0 and closed:
            to = self.ids[closed] = len(self.states)
            self.states.append(closed)
            self.steps.append({})
            self.stops.append(sorted((e, self.term[n]) for n, e in closed if self.stem[n]))
        self.steps[at][c] = to
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """(term, weight) of the term that the word is, or is one edit away from."""
        at = 0
        stem, like = None, []
        for c in word:
            to = self.steps[at].get(c)
            at = self.step(at, c) if to is None else to
            if at < 0:
                break
            if self.stops[at]:
                if stem is None:
                    stem = next(((t, EXACT) for e, t in self.stops[at] if e == 0), None)
                like += [t for e, t in self.stops[at] if e and len(self.names[t]) >= FUZZY_STEM]
        near = (min(like), FUZZY_CONTINUED) if like and word not in self.clean else None
        if at < 0:
            return stem or near
        ends = sorted((e, self.term[n]) for n, e in self.states[at] if self.term[n] >= 0 and not self.stem[n] and (e == 0 or len(self.names[self.term[n]]) >= FUZZY_LENGTH))
        if ends and ends[0][0] == 0:
            return ends[0][1], EXACT
        if stem is not None:
            return stem
        return (ends[0][1], FUZZY) if ends and word not in self.clean else near

    def find(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(position, term, weight) of each hit."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return [(i, *hit) for i, hit in enumerate(map(self.memo.__getitem__, words)) if hit]


def features(text: str, matcher: Matcher) -> list[float]:
    low = text.lower()
    words = TOKEN.findall(low)
    hits = matcher.find(words)
    if not hits:
        return [0.0] * 5
    places = [m.span() for m in TOKEN.finditer(low)]
    abuse = quoted = near = 0.0
    for k, (i, term, weight) in enumerate(hits):
        weight *= matcher.worth[term]
        lo, hi = places[max(0, i - CONTEXT)][0], places[min(len(places) - 1, i + CONTEXT)][1]
        before, after = low[lo : places[i][0]], low[places[i][1] : hi]
        marks = any(before.count(q) % 2 == 1 and q in after for q in "\"“„«") or bool(before[-1:] and before[-1] in QUOTES and after[:1] and after[0] in QUOTES)
        reported = marks or bool(REPORTING.intersection(TOKEN.findall(before)))
        close = sum(1 for j in range(max(0, k - 3), min(len(hits), k + 4)) if j != k and abs(hits[j][0] - i) <= CONTEXT)
        if reported and not close:
            quoted += weight
        else:
            abuse += weight
            near = max(near, float(close))
    total = abuse + QUOTED * quoted
    distinct = sum(matcher.worth[t] for t in {t for _, t, _ in hits})
    return [math.log1p(total), math.log1p(quoted), math.log1p(near), math.log1p(distinct), math.log1p(1000 * total / (len(words) + 20))]


class Model:
    def __init__(self, lexicon: dict[str, float]):
        """lexicon: terms and their lift, stems with a mark at the end.  A term of a high lift counts as a whole hit, others as less."""
        self.words, self.stems = [t for t in lexicon if not t.endswith("-")], [t[:-1] for t in lexicon if t.endswith("-")]
        self.worth = {t.rstrip("-"): min(1.0, math.log(v) / math.log(WHOLE_LIFT)) for t, v in lexicon.items()}
        self.clean: frozenset[str] = frozenset()
        self.weights: list[float] = []

    def matcher(self) -> Matcher:
        return Matcher(self.words, self.stems, self.clean, self.worth)

    def score(self, x: list[float]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(text: str) -> set[str]:
    """Words and, with a mark, their stems."""
    words = set(TOKEN.findall((text or "").lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that each term is in, summed over the task's rows."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms_of(text))
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[1][n] for n in some], pa.int64()), pa.array([counts[0][n] for n in some], pa.int64())], names=["term", "toxic", "clean"])


def cover(docs: list[list[str]], clean: dict[str, float], times: int = 3, least: int = 2) -> dict[str, float]:
    """Greedy choice of terms until each toxic document holds ``times`` of them: term to lift.

    ``clean`` is each candidate's share of the clean documents.  What a term is worth counts only the documents that
    still need one, so that a stem which is common in clean text doesn't ride along with a term that begins like it.
    """
    docs = [[t for t in ts if t in clean] for ts in docs]
    count = Counter(t for ts in docs for t in ts)
    holders: dict[str, list[int]] = defaultdict(list)
    for i, ts in enumerate(docs):
        for t in ts:
            holders[t].append(i)
    need, out = [times] * len(docs), {}
    lift = lambda t: count[t] / len(docs) / clean[t]
    fits = lambda t: count[t] >= least and lift(t) >= LEAST_LIFT
    worth = lambda t: -count[t] * math.log(lift(t))
    ranked = sorted((t for t in holders if fits(t)), key=lambda t: (not t.endswith("-"), len(t), t), reverse=True)
    heap = [(worth(t), place, t) for place, t in enumerate(ranked)]
    heapq.heapify(heap)
    while heap:
        was, place, term = heapq.heappop(heap)
        if not fits(term):
            continue
        if worth(term) != was:  # others have been chosen since: what a term is worth only falls
            heapq.heappush(heap, (worth(term), place, term))
            continue
        out[term] = lift(term)
        for i in holders[term]:
            need[i] -= 1
            if need[i] == 0:
                for t in docs[i]:
                    count[t] -= 1
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, rounds: int = 40) -> list[float]:
    """Logistic regression by Newton steps.  Documents weigh alike, so that a score is a share of toxic documents."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty
        w -= np.linalg.solve(h, g)
    return w.tolist()


def in_training() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model | None:
    """The lexicon and weights of at most ``max_rows`` labelled rows; None if these have only one label.

    What reaches the driver are counts, words and features of those rows alone.  Defined cases: labels other than 0 and 1 and
    null ids are left out; of two labels of a doc_id the larger counts; rows that repeat text and label count once.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & in_training()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("text"), F.col("toxic"))
    rows = staged(rows.dropDuplicates(["text", "toxic"]).orderBy(F.xxhash64("text"), "text", "toxic").limit(max_rows).repartition(TRAIN_PARTS, "text"), "train")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    terms = rows.mapInArrow(count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("clean") + 0.5) / (totals[0] + 1)
    best = terms.filter(F.col("toxic") >= 2).withColumn("share", share).filter(F.col("toxic") / totals[1] / F.col("share") >= LEAST_LIFT)
    shares = {r["term"]: r["share"] for r in best.collect()}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(shares.keys() & terms_of(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

    toxic = [r["terms"] for r in rows.filter("toxic = 1").select("text").mapInArrow(held, "terms array<string>").collect()]
    lexicon = cover(sorted(toxic), shares)
    model = Model(lexicon)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = model.matcher(), set()
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in set(TOKEN.findall((text or "").lower())):
                    if (hit := matcher.match(w)) and hit[1] < EXACT:
                        found.add(w)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    clean = rows.filter("toxic = 0").select("text").mapInArrow(variants, "word string").distinct().collect()
    model.clean = frozenset(r["word"] for r in clean)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            x = [features(t or "", matcher) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    table = rows.mapInArrow(described, "x array<double>, toxic int").collect()
    table.sort(key=lambda r: (r["toxic"], r["x"]))
    model.weights = fit_weights(np.array([r["x"] for r in table]), np.array([r["toxic"] for r in table], dtype=float))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Defined cases: null and empty texts are scored as texts without hits; without a model, which needs training rows of
    both labels, every score is 0; a null doc_id counts as the empty text in the fold's checksum; repeated rows get equal scores;
    an empty table gives an empty result; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher() if model else None
        for b in batches:
            s = [model.score(features(t or "", matcher)) if model else 0.0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (~in_training()).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; all of them without a model."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            yield b.filter(pa.array([model.score(features(t or "", matcher)) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, train(docs, labels))
