"""Secret scans: fixed patterns, and strings whose sliding-window entropy is that of a random key.

The entropy of a window is kept by incremental counts: a step adds one character and drops one.  Each candidate is
judged against its character class, and an allow list suppresses what looks random but is public.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lmdata.llm.common import documents

# The patterns that the contract names.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "entropy")
#: What a text must hold for a pattern to match: checked for a whole batch before any match is tried.
NEEDS = {"assign": (r"(password|passwd|secret|token|api_?key)[\"']? *[:=]", True), "access": ("AKIA[A-Z0-9]", False), "hex": ("[0-9a-f]{24}", False), "entropy": ("[A-Za-z0-9+/_=-]{20}", False)}

CANDIDATE = re.compile(r"(?a)[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least entropy in bits of the most random window, by character class; 20 characters reach at most 3.32, 4, 4.32 bits.
LIMITS = {"digits": 2.9, "hex": 3.1, "base32": 3.6, "base64": 3.8}
CLASSES = (("digits", re.compile(r"[0-9]+\Z")), ("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")), ("base32", re.compile(r"[A-Z2-7=]+\Z")), ("base64", re.compile(r"(?s).*")))
#: What can be read: words of lower or upper case or CamelCase, with a number after them.
_WORD = r"(?:[A-Z]*[a-z]{2,}|[A-Z]{2,}|[A-Za-z](?![A-Za-z]))+[0-9]{0,4}"
#: Public by their form: identifiers, paths and names made of words, placeholders, digests that are named as such.  A string of
#: lower-case letters alone, or of upper-case ones, is always a word: keys without digits and of one case are out of reach.
ALLOWED = tuple(map(re.compile, (
    r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z",
    rf"[/_=+-]*(?:(?:{_WORD}|[0-9]{{1,4}})[/_=+-]+)*{_WORD}[/_=+-]*\Z",
    r"(?i).*(?:example|sample|placeholder|xxxx|your[_-]?)",
    r"[-=_+/]+\Z",
)))
ALLOWED_BEFORE = re.compile(r"(?i)(?:sha(?:1|224|256|384|512)|md5|integrity|commit|checksum|digest)[\"']?\s*[-:=]?\s*[\"']?\Z")


def max_entropy(s: str, window: int = WINDOW) -> float:
    """Shannon entropy in bits per character of the most random window, by incremental counts."""
    n = min(window, len(s))
    term = [0.0, *(k * math.log2(k) for k in range(1, n + 1))]
    counts = Counter(s[:n])
    total = sum(term[k] for k in counts.values())
    least = total
    for gone, come in zip(s, s[n:], strict=False):
        if gone != come:
            total += term[counts[gone] - 1] - term[counts[gone]] + term[counts[come] + 1] - term[counts[come]]
            counts[gone] -= 1
            counts[come] += 1
            least = min(least, total)
    return math.log2(n) - least / n if n else 0.0


def is_random(s: str, before: str = "") -> bool:
    if any(a.match(s) for a in ALLOWED) or ALLOWED_BEFORE.search(before):
        return False
    kind = next(k for k, p in CLASSES if p.match(s))
    if kind == "base64" and not (re.search(r"[A-Za-z]", s) and (re.search(r"[0-9]", s) or re.search(r"[a-z]", s) and re.search(r"[A-Z]", s))):
        return False
    return max_entropy(s) >= LIMITS[kind]


def spans(text: str, may: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span, in that order."""
    out = []
    if may[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if may[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if may[3]:
        out += [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if is_random(m[0], text[max(0, m.start() - 24) : m.start()])]
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(1).fill_null("")
        may = list(zip(*(pc.match_substring_regex(text, p, ignore_case=i).to_pylist() for p, i in NEEDS.values()), strict=True))
        found = [spans(str(text[i]), m) if any(m) else [] for i, m in enumerate(may)]
        base = [[s for s in f if s[1] < 3] for f in found]
        counts = [pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(3)]
        digests = [hashlib.sha256(joined(f).encode()).hexdigest() for f in base]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string())], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex, entropy).
    Defined cases: null and empty texts have no spans; null ids and repeated rows are scanned like any other; an empty
    table gives an empty result; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
