"""Personal data by weak supervision, in DataFrame functions alone.

Base spans follow fixed patterns and checks. Wider patterns propose candidates:
national phone numbers, card-like groups of digits, disguised e-mail addresses
and dotted quads. Four labelers vote on each candidate: the pattern's own check,
a gazetteer (top-level domains, dialling codes, card issuers, reserved address
blocks), cue words in the context before it, and its boundaries. An expectation-
maximisation over the counts of vote patterns estimates each labeler's
reliabilities and the probability of each pattern, for every kind of data. These
probabilities are soft labels for the final classifier, a logistic regression
over votes and span features; accepted candidates that overlap no base span of
their kind are added. Base spans always stay.

Vote and feature patterns are aggregated where the texts are. Their number is
bounded by the number of votes and features, not by the documents, so both models
fit on the driver from one small table of counts.

Offsets are code points, the end exclusive. Defined cases: a null text counts as
empty and has no spans; a text without digits or address signs isn't searched;
repeated rows stay repeated; without candidates nothing is added; values that
fail a base check aren't searched again within.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Possessive quantifiers and \G only spare backtracking and repeated starts within a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Which characters a text must hold before a pattern is tried.
NEEDS = {"email": r"@|\(at\)|\[at\]|\x20at\x20", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}"}
#: Common top-level domains.
DOMAINS = tuple(
    "com org net edu gov mil int info biz name io co ai app dev me tv xyz online site uk ie de at ch fr be lu nl es pt it gr pl cz sk hu ro bg hr rs si ua ru tr "
    "se no dk fi is ee lv lt eu us ca mx br ar cl pe ve au nz in pk bd lk cn jp kr hk tw sg my th vn id ph il ae sa eg za ng ke ma".split()
)
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)\W{1,4}\w{0,8}\W{0,3}$",
    "ip": r"(?i)(?:\bip|address|server|host|client|from|login)\W{1,4}\w{0,8}\W{0,3}$",
    "card": r"(?i)(?:card|visa|amex|mastercard|credit|debit|karte|tarjeta|carte)\W{1,4}\w{0,8}\W{0,3}$",
    "phone": r"(?i)(?:phone|tel|call|cell|mobile|fax|contact|telefon|t[ée]l[ée]fono?)\W{1,4}\w{0,8}\W{0,3}$",
}
AGAINST = r"(?i)(?:version|\bv|order|invoice|isbn|issn|doi|no|nr|number|token|key|hash|password)\W{0,4}$"
CONTEXT = 40
ACCEPT = 0.5
VOTES = ("checked", "listed", "cued", "bounded")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(steps: Column, at: Callable[[Column, Column, Column], Column]) -> Column:
    """``at(element, sum of .step before it, index)`` for each element, by blocks of 64."""
    size = 64

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x["step"])

    def with_blocks(blocks: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / size).cast("int")
            return at(x, F.element_at(blocks, block + 1) + total(F.slice(steps, block * size + 1, i - block * size)), i)

        return F.transform(steps, one)

    n = F.size(steps)
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda j: total(F.slice(steps, j * size + 1, F.lit(size))))
    running = let(starts, lambda sums: F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, F.lit(1), j), F.lit(0), lambda a, x: a + x)))
    return let(running, with_blocks)


_SPAN = "array<struct<start:int,end:int,value:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end and value."""

    def located(z: Column) -> Column:
        # the gaps before each match, and the matches, tell where each one starts
        steps = F.zip_with(F.slice(z["gaps"], F.lit(1), F.size(z["found"])), z["found"], lambda g, m: F.struct(F.length(g).alias("gap"), (F.length(g) + F.length(m)).alias("step"), m.alias("value")))

        def span(x: Column, before: Column, i: Column) -> Column:
            start = before + x["gap"]
            return F.struct(start.alias("start"), (before + x["step"]).alias("end"), x["value"].alias("value"))

        return let(steps, lambda s: _prefix_sums(s, span))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))
    return let(both, lambda z: F.when(F.size(z["found"]) > 0, located(z)).otherwise(F.array().cast(_SPAN)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(number)
    twice = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substr(number, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10))), F.substr(number, i, F.lit(1)).cast("int") + 1)),
    )
    return twice % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.length(digits(value)).between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _votes(kind: str, text: Column, span: Column) -> Column:
    """The labelers' votes on a candidate (1 for, 0 against, -1 none) and its features."""
    value, number = span["value"], digits(span["value"])
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), span["start"]))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    if kind == "email":
        listed = F.regexp_extract(F.lower(value), r"([a-z]+)$", 1).isin(*DOMAINS)
        unlisted, checked = ~listed, value.contains("@") & ~value.contains(" ")
    elif kind == "ip":
        unlisted = value.rlike(r"^(?:0|255)\.") | value.rlike(r"\.255\.255$")
        listed, checked = ~unlisted, is_valid(kind, value)
    elif kind == "card":
        listed = number.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68])")
        unlisted, checked = ~listed, is_valid(kind, value)
    else:
        listed = number.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$")
        unlisted, checked = ~listed, value.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$") | value.rlike(r"^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$")
    tight = F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_=\"/]") | after.rlike(r"[\p{L}\p{N}_=\"/]")
    return F.struct(
        _vote(checked, ~checked).alias("checked"),
        _vote(listed, unlisted).alias("listed"),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("cued"),
        _vote(~tight, tight).alias("bounded"),
        F.least(F.lit(4), F.floor(F.length(value) / 8)).cast("int").alias("size"),
        value.rlike(r"[\x20()\[\]]").cast("int").alias("spaced"),
    )


def _of_kind(kind: str, text: Column) -> Column:
    k = KINDS.index(kind)
    needed = text.rlike(NEEDS[kind])
    base = F.transform(F.filter(find_spans(text, BASE[kind]), lambda s: is_valid(kind, s["value"])), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    wide = F.transform(
        find_spans(text, WIDE[kind]),
        lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _votes(kind, text, s).alias("votes")),
    )
    none = "struct<base:array<struct<kind:int,start:int,end:int>>,wide:array<struct<kind:int,start:int,end:int,votes:struct<checked:int,listed:int,cued:int,bounded:int,size:int,spaced:int>>>>"
    return F.when(needed, F.struct(base.alias("base"), wide.alias("wide"))).otherwise(F.struct(F.array().alias("base"), F.array().alias("wide")).cast(none))


def annotate(docs: DataFrame, base: str = "_base", wide: str = "_wide") -> DataFrame:
    """``docs`` with arrays of base spans and of candidates with votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({f"_found_{k}": _of_kind(k, text) for k in KINDS})
    both = {n: F.concat(*(F.col(f"_found_{k}")[part] for k in KINDS)) for n, part in ((base, "base"), (wide, "wide"))}
    return rows.withColumns(both).drop(*(f"_found_{k}" for k in KINDS))


@dataclass
class SpanModel:
    """Weights of the final classifier for each kind, and what the labelers' reliabilities came out as."""

    weights: dict[int, dict[str, float]] = field(default_factory=dict)
    reliabilities: dict[int, dict[str, tuple[list[float], list[float]]]] = field(default_factory=dict)

    def accepts(self, span: Column) -> Column:
        """Whether the classifier takes a candidate."""
        out = F.lit(False)
        for kind, w in self.weights.items():
            z = F.lit(w[""])
            for name in (*VOTES, "size", "spaced"):
                for key, value in w.items():
                    if key.startswith(name + "="):
                        z = z + F.when(span["votes"][name] == int(key.split("=")[1]), value).otherwise(0.0)
            out = F.when(span["kind"] == kind, z >= math.log(ACCEPT / (1 - ACCEPT))).otherwise(out)
        return out


def estimate_reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 60) -> tuple[dict[str, tuple[list[float], list[float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns.

    Returns each labeler's distribution over (none, against, for) when a
    candidate is not, or is, personal data, and each pattern's probability.
    """
    prior = 0.5
    p = {v: ([[0.2, 0.6, 0.2]] + [[0.2, 0.2, 0.6]]) for v in VOTES}
    belief: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for pattern in counts:
            odds = math.log(prior / (1 - prior))
            for v, vote in zip(VOTES, pattern):
                odds += math.log(p[v][1][vote + 1] / p[v][0][vote + 1])
            belief[pattern] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        total = sum(counts.values())
        yes = sum(n * belief[x] for x, n in counts.items())
        prior = (yes + 1) / (total + 2)
        for i, v in enumerate(VOTES):
            for c in (0, 1):
                mass = [0.5, 0.5 + (c == 0), 0.5 + (c == 1)]  # a labeler is taken to be rather right than wrong
                for x, n in counts.items():
                    mass[x[i] + 1] += n * (belief[x] if c else 1 - belief[x])
                p[v][c] = [m / sum(mass) for m in mass]
    return {v: (p[v][0], p[v][1]) for v in VOTES}, belief


def fit_classifier(rows: list[tuple[dict[str, int], float, float]], steps: int = 400, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, float]:
    """Logistic regression on one-hot features from (features, count, soft label) rows."""
    total = sum(n for _, n, _ in rows)
    keys = sorted({f"{k}={v}" for f, _, _ in rows for k, v in f.items()})
    w = dict.fromkeys(["", *keys], 0.0)
    for _ in range(steps):
        grad = {k: penalty * x for k, x in w.items()}
        for f, n, target in rows:
            own = ["", *(f"{k}={v}" for k, v in f.items())]
            z = sum(w[k] for k in own)
            error = n / total * (1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) - target)
            for k in own:
                grad[k] += error
        for k in w:
            w[k] -= rate * grad[k]
    return w


def train(annotated: DataFrame, wide: str = "_wide") -> SpanModel:
    """Reliabilities and classifiers from the candidates of all documents."""
    names = (*VOTES, "size", "spaced")
    each = annotated.select(F.explode(wide).alias("s")).select("s.kind", *(F.col(f"s.votes.{n}").alias(n) for n in names))
    table = each.groupBy("kind", *names).count().collect()  # at most a few thousand patterns
    model = SpanModel()
    for kind in sorted({r["kind"] for r in table}):
        own = sorted((tuple(r[n] for n in names), r["count"]) for r in table if r["kind"] == kind)
        counts: dict[tuple[int, ...], float] = {}
        for values, n in own:
            counts[values[:4]] = counts.get(values[:4], 0) + n
        model.reliabilities[kind], belief = estimate_reliabilities(counts)
        model.weights[kind] = fit_classifier([(dict(zip(names, values)), n, belief[values[:4]]) for values, n in own])
    return model


def all_spans(model: SpanModel, base: str = "_base", wide: str = "_wide") -> Column:
    """Base spans and accepted candidates, by kind, start and end."""
    taken = F.filter(F.col(wide), lambda c: model.accepts(c) & ~F.exists(F.col(base), lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    plain = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_sort(F.concat(F.col(base), plain))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), parts.alias("parts"))).otherwise(acc)

    done = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
