"""Personal data by weak supervision, in DataFrame functions only.

Spans that match a kind's fixed pattern are the base.  Looser patterns give further candidates.  Labelers (form,
gazetteer, words before, edges) vote yes, no or abstain on every candidate; expectation-maximisation estimates
how reliable each labeler is, without labels; and a logistic span classifier is trained on the votes' posteriors.
Looser candidates that it accepts join the base.

Votes and lengths take few values, so all that training needs is a count per combination: a table of bounded size.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import documents, staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "before", "edges")
NEAR = 48
#: Prefix sums over a document's matches are made in blocks of this many.
BLOCK = 256

# The contract's patterns.  \G and the look-behinds only save retries inside a run of characters that has
# already failed; possessive loops need no stack on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base or a looser pattern of the kind to match: each pattern of the kind implies it.
NEEDS = {"email": r"(?i)@|[\[({]at[\])}]|\sat\s\S+\sdot\s", "ip": r"[0-9]\.[0-9]+\.[0-9]|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9][).\x20-]{1,2}[0-9]{3}[.\x20-][0-9]{4}"}
LOOSE = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]{1,64}\s?[\[({]at[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]dot[\])}]|\sdot\s|\.)\s?[A-Za-z0-9-]{2,24})++|\b[A-Za-z0-9._%+-]{1,64}\sat\s[A-Za-z0-9-]{1,63}(?:\sdot\s[A-Za-z0-9-]{2,24})++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
OCTETS = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}"
# Gazetteers.
DOMAINS = "com|org|net|edu|gov|io|info|co|uk|de|fr|es|it|nl|eu|ch|at|be|us|ca"
CALLING = r"\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
NETWORKS = "[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80"
NOT_HOSTS = r"(?:0|127|255)\..*|.*\.0\.0\.0"
CUES = {
    "email": "mail|e-mail|email|contact|write|courriel|correo|kontakt|schreib|écri",
    "ip": "ip|host|server|address|adresse|dirección|serveur|servidor|from",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|payment|paid|account",
    "phone": "phone|tel|call|fax|mobile|cell|téléphone|telefon|teléfono|appel|ruf|llam",
}
AGAINST = r"(?<![\p{L}\p{N}_])(?:version|ver|v|isbn|section|figure|table|§|no|nr|id)[.:#]?\s*$"


def _placed(matches: Column, segs: Column) -> Column:
    """[(start, end, match, text before, character after)] of a pattern's matches, by prefix sums over the parts between."""
    size = F.size(segs) - 1
    kind = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
    empty = F.array().cast(kind)
    one = lambda at, i: F.struct(
        (at + F.length(F.get(segs, i))).alias("s"),
        (at + F.length(F.get(segs, i)) + F.length(F.get(matches, i))).alias("e"),
        F.get(matches, i).alias("m"),
        F.substring(F.get(segs, i), -NEAR, NEAR).alias("b"),
        F.substring(F.get(segs, i + 1), 1, 1).alias("a"),
    )

    def block(k: Column) -> Column:
        span = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, size) - 1)
        add = lambda acc, i: F.struct(one(acc["at"], i)["e"].alias("at"), F.array_append(acc["out"], one(acc["at"], i)).alias("out"))
        return F.aggregate(span, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), block)
    shift = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
    join = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], F.transform(b["out"], lambda x: shift(x, acc["at"]))).alias("out"))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), join)
    return F.when(size > 0, F.flatten(whole["out"])).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    """The base pattern's further conditions."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(f"^{OCTETS}$"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda x: _passes(kind, x["m"])


def _votes(kind: str, x: Column) -> list[Column]:
    """1 yes, 0 no, -1 abstain, one per labeler."""
    m, before, after = x["m"], F.lower(x["b"]), x["a"]
    rl = lambda c, p: F.regexp_like(c, F.lit(p))
    yes = lambda c: F.when(c, 1).otherwise(0)
    form = {
        "email": rl(m, r"^[A-Za-z0-9]") & rl(m, r"[A-Za-z]{2,24}$") & (F.length(m) <= 320),
        "ip": rl(m, r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$") | rl(m, r"(?:^|:)[0-9A-Fa-f]{3,4}:"),
        "card": F.call_function("luhn_check", _digits(m)),
        "phone": F.length(_digits(m)).between(8, 15),
    }[kind]
    gazetteer = {
        "email": yes(rl(m, rf"(?i)[.\s\])}}](?:{DOMAINS})$")),
        "ip": F.when(rl(m, f"^(?:{NOT_HOSTS})$"), 0).otherwise(F.when(m.contains(":"), yes(rl(m, f"(?i)^(?:{NETWORKS}):"))).otherwise(-1)),
        "card": yes(rl(m, f"^{ISSUERS}")),
        "phone": F.when(m.startswith("+"), yes(rl(m, f"^{CALLING}"))).otherwise(-1),
    }[kind]
    cue = F.when(rl(before, AGAINST), 0).when(rl(before, rf"(?<![\p{{L}}\p{{N}}_])(?:{CUES[kind]})"), 1).otherwise(-1)
    edges = F.when(rl(before, r"[\p{L}\p{N}_/\\=]$") | rl(after, r"^[\p{L}\p{N}_/\\=]"), 0).otherwise(1)
    return [yes(form), gazetteer, cue, edges]


def _judged(kind: str, spans: Column, base: bool) -> Column:
    def one(x: Column) -> Column:
        votes = [v.cast("byte").alias(n) for v, n in zip(_votes(kind, x), LABELERS, strict=True)]
        size = F.least(F.length(x["m"]) / 8, F.lit(4)).cast("byte")
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), *votes, size.alias("size"))

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, c_email, c_ip, c_card, c_phone): judged candidates of each kind, by start, base spans first among equals."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        split = {}
        for k in KINDS:
            may = F.regexp_like("text", F.lit(NEEDS[k]))
            split |= {f"{name}s_{k}": F.when(may, F.split("text", patterns[k], -1)), f"{name}m_{k}": F.when(may, F.regexp_extract_all("text", F.lit(patterns[k]), F.lit(0)))}
        rows = rows.withColumns(split)
    rows = rows.withColumns({f"{n}_{k}": F.when(F.size(f"{n}m_{k}") > 0, _placed(F.col(f"{n}m_{k}"), F.col(f"{n}s_{k}"))) for n in "bl" for k in KINDS})
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string,a:string>>")
    rows = rows.select("doc_id", *[F.coalesce(F.filter(f"b_{k}", _test(k)), none).alias(f"b_{k}") for k in KINDS], *[F.coalesce(f"l_{k}", none).alias(f"l_{k}") for k in KINDS])
    apart = lambda k: F.filter(f"l_{k}", lambda x: ~F.exists(f"b_{k}", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return rows.select("doc_id", *[F.concat(_judged(k, F.col(f"b_{k}"), True), _judged(k, apart(k), False)).alias(f"c_{k}") for k in KINDS])


def reliabilities(counts: list[tuple], rounds: int = 50) -> tuple[dict[str, float], dict[tuple[str, str], tuple[float, float]]]:
    """EM over (kind, votes, count): each kind's share of true spans, and P(yes | true), P(yes | false) of each labeler."""
    share = dict.fromkeys(KINDS, 0.7)
    rate = {(k, n): (0.8, 0.3) for k in KINDS for n in LABELERS}
    for _ in range(rounds):
        total, true = defaultdict(float), defaultdict(float)
        yes: dict = defaultdict(lambda: [0.0, 0.0])
        cast: dict = defaultdict(lambda: [0.0, 0.0])
        for kind, votes, n in counts:
            p = posterior(kind, votes, share, rate)
            total[kind] += n
            true[kind] += n * p
            for name, v in zip(LABELERS, votes, strict=True):
                if v >= 0:
                    for side, w in enumerate((n * p, n * (1 - p))):
                        cast[kind, name][side] += w
                        yes[kind, name][side] += w * v
        share = {k: (true[k] + 1.4) / (total[k] + 2) for k in KINDS}
        rate = {key: tuple((yes[key][side] + 10 * (0.8, 0.3)[side]) / (cast[key][side] + 10) for side in (0, 1)) for key in rate}
    return share, rate


def posterior(kind: str, votes: tuple, share: dict, rate: dict) -> float:
    """P(true | votes): labelers vote independently of each other given the truth; who abstains says nothing."""
    z = math.log(share[kind] / (1 - share[kind]))
    for name, v in zip(LABELERS, votes, strict=True):
        if v >= 0:
            t, f = rate[kind, name]
            z += math.log(t / f) if v else math.log((1 - t) / (1 - f))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _inputs(kind: str, votes: tuple, size: int) -> list[str]:
    return [f"kind={kind}", *[f"{kind}.{n}={v}" for n, v in zip(LABELERS, votes, strict=True) if v >= 0], f"{kind}.size={size}"]


def classifier(table: list[tuple], rounds: int = 300, rate: float = 0.5, ridge: float = 0.01) -> dict[str, float]:
    """Logistic weights per input from (kind, votes, size, count, target), by gradient steps of a size per input."""
    weights: dict[str, float] = defaultdict(float)
    mass: dict[str, float] = defaultdict(float)
    for kind, votes, size, n, _ in table:
        for i in _inputs(kind, votes, size):
            mass[i] += n
    for _ in range(rounds):
        slope: dict[str, float] = defaultdict(float)
        for kind, votes, size, n, target in table:
            own = _inputs(kind, votes, size)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in own)))))
            for i in own:
                slope[i] += n * (p - target)
        for i, g in slope.items():
            weights[i] -= rate * (g / mass[i] + ridge * weights[i])
    return dict(weights)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of base spans; spans are kind:start:end in code points, end exclusive, by kind (email,
    ip, card, phone) and then start.  Defined cases: null and empty texts have no spans; null ids and repeated rows are
    searched like any other; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    rows = staged(candidates(docs), "candidates")
    flat = rows.select(F.explode(F.concat(*[f"c_{k}" for k in KINDS])).alias("x")).groupBy("x.kind", *[f"x.{n}" for n in LABELERS], "x.size").count()
    table = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["size"], r["count"]) for r in flat.collect())  # at most 4 kinds x 3^4 votes x 5 sizes
    share, rate = reliabilities([(k, v, n) for k, v, _, n in table])
    weights = classifier([(k, v, s, n, posterior(k, v, share, rate)) for k, v, s, n in table])

    def accepted(k: str):
        def test(x: Column) -> Column:
            z = F.lit(weights.get(f"kind={k}", 0.0))
            for n in LABELERS:
                z = z + F.when(x[n] == 1, weights.get(f"{k}.{n}=1", 0.0)).when(x[n] == 0, weights.get(f"{k}.{n}=0", 0.0)).otherwise(0.0)
            sizes = [F.lit(weights.get(f"{k}.size={i}", 0.0)) for i in range(5)]
            return x["base"] | (z + F.get(F.array(*sizes), x["size"].cast("int")) > 0)

        return test

    shown = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    base = {k: F.filter(f"c_{k}", lambda x: x["base"]) for k in KINDS}
    by_start = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    whole = F.concat(*[by_start(F.filter(f"c_{k}", accepted(k))) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(F.concat(*base.values()), shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(whole, shown), ",").alias("spans"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
