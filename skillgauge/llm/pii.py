"""Personal data by weak supervision (operator 7).

Patterns propose candidate spans; labelers vote on each: its shape, its structure (checksums and
ranges), a gazetteer of cue words and names before it, and the characters around it. The votes of all
candidates are counted per pattern of votes, expectation-maximisation estimates from those counts how
reliable every labeler is, and a logistic span classifier is trained on the resulting probabilities.
Spans of the four base kinds that pass their rule always stay; the classifier decides on all others.
The table of vote patterns has at most 3^4 rows a kind, whatever the number of documents; it is all
that reaches the driver, and it covers all candidates.

Everything over the documents is native expressions: a text is cut by a pattern into matches and the
pieces between them, whose lengths give the positions.

Defined results: a null text is empty; spans of one kind do not overlap, spans of different kinds may;
an added span that overlaps a base span is dropped; without candidates nothing is learned or added;
repeated rows give repeated results; only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from skillgauge.llm.storage import stored

BASE_KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "structure", "gazetteer", "context")
EM_STEPS = 50
_LEFT = 40

# Gazetteers of cue words, by kind, and of given names.
CUES = {
    "email": "e-?mail|mail|contact|reach|write",
    "ip": "ip|host|server|address|from",
    "card": "card|visa|mastercard|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax|contact",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|bank",
    "local_phone": "phone|tel|call|mobile|fax|contact",
    "name": "dear|sincerely|regards|from|contact|patient|client",
}
GIVEN_NAMES = "James|Mary|John|Linda|Robert|Susan|David|Karen|Michael|Anna|Maria|Jose|Ana|Luis|Hans|Peter|Jean|Pierre|Claire|Julia"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A pattern with its cheap precondition, its rule for base spans, and two of its labelers."""

    name: str
    pattern: str
    possible: Callable[[Column], Column]
    passes: Callable[[Column], Column]
    structure: Callable[[Column], Column]
    shape: int = 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _sign(holds: Column) -> Column:
    return F.when(holds, 1).otherwise(-1)


# A match can only start where a run starts or the match before it ended; saying so keeps long runs linear.
# Possessive groups are equivalent here, since nothing follows them, and need no stack.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda text: F.contains(text, F.lit("@")),
        lambda match: F.lit(True),
        lambda match: _sign(match.rlike(r"\.[A-Za-z]{2,}$")),
        1,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda text: text.rlike(r"[0-9]\.[0-9]"),
        lambda match: match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        lambda match: _sign(match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        1,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda text: text.rlike(r"[0-9][\x20-]?[0-9]"),
        lambda match: F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match)),
        lambda match: _sign(F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda text: F.contains(text, F.lit("+")),
        lambda match: F.length(_digits(match)).between(8, 15),
        lambda match: _sign(F.length(_digits(match)).between(8, 15)),
        1,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda text: text.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
        lambda match: F.lit(False),
        lambda match: _sign(~match.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        1,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
        lambda text: text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
        lambda match: F.lit(False),
        lambda match: _sign(match.rlike(r"[0-9]{6}")),
        1,
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        lambda text: text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
        lambda match: F.lit(False),
        lambda match: _sign(match.rlike(r"^\(?[2-9]")),
        1,
    ),
    Kind(
        "name",
        r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
        lambda text: text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"),
        lambda match: F.lit(False),
        lambda match: F.when(match.rlike(rf"\x20(?:{GIVEN_NAMES})(?:\x20|$)"), 1).otherwise(0),
        1,
    ),
)
ORDER = {kind.name: at for at, kind in enumerate(KINDS)}


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """doc_id and `found`: every match of every kind with its place, its base verdict and its votes."""
    df = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = []
    for kind in kinds:
        pieces, matches, ends = (f"{kind.name}_{part}" for part in ("pieces", "matches", "ends"))
        possible = kind.possible(F.col("text"))
        df = df.withColumn(matches, F.when(possible, F.regexp_extract_all("text", F.lit(kind.pattern), 0)))
        df = df.withColumn(pieces, F.when(F.size(matches) > 0, F.split("text", kind.pattern, -1)))
        df = df.withColumn(ends, _running(_lengths(pieces, matches)))
        parts.append(F.coalesce(_voted(kind, pieces, matches, ends), F.array().cast(_FOUND)))
    return df.select("doc_id", F.flatten(F.array(*parts)).alias("found"))


_FOUND = (
    "array<struct<kind: string, start: int, end: int, base: boolean, "
    "shape: int, structure: int, gazetteer: int, context: int>>"
)


def _lengths(pieces: str, matches: str) -> Column:
    """Length of each piece together with the match after it."""
    return F.transform(matches, lambda match, i: F.length(F.get(F.col(pieces), i)) + F.length(match))


def _running(lengths: Column) -> Column:
    """Running sums."""
    nothing = F.array().cast("array<int>")
    last = lambda so_far: F.coalesce(F.get(so_far, F.size(so_far) - 1), F.lit(0))
    return F.aggregate(lengths, nothing, lambda so_far, n: F.concat(so_far, F.array(last(so_far) + n)))


def _voted(kind: Kind, pieces: str, matches: str, ends: str) -> Column:
    def vote(match: Column, i: Column) -> Column:
        end = F.get(F.col(ends), i)
        left = F.substring(F.get(F.col(pieces), i), -_LEFT, _LEFT)
        right = F.substring(F.get(F.col(pieces), i + 1), 1, 1)
        apart = ~left.rlike(r"[\p{L}0-9]$") & ~right.rlike(r"^[\p{L}0-9]")
        cue = left.rlike(rf"(?i)(?<!\p{{L}})(?:{CUES[kind.name]})(?!\p{{L}})")
        return F.struct(
            F.lit(kind.name).alias("kind"),
            (end - F.length(match)).alias("start"),
            end.alias("end"),
            kind.passes(match).alias("base"),
            F.lit(kind.shape).alias("shape"),
            kind.structure(match).alias("structure"),
            F.when(cue, 1).otherwise(0).alias("gazetteer"),
            _sign(apart).alias("context"),
        )

    return F.transform(matches, vote).cast(_FOUND)


@dataclass(frozen=True)
class Model:
    """Vote probabilities by labeler, class and vote; the prior; and the weights of the classifier."""

    votes: dict[str, dict[bool, dict[int, float]]]
    prior: float
    bias: float
    weights: dict[tuple[str, int], float]

    def probability(self, span: Column) -> Column:
        score = F.lit(self.bias)
        for (labeler, vote), weight in sorted(self.weights.items()):
            score = score + F.when(span[labeler] == vote, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def fit(patterns: Sequence[Row]) -> Model:
    """EM over counted vote patterns, then a logistic classifier on the pattern probabilities."""
    rows = sorted((tuple(row[name] for name in LABELERS), row["n"]) for row in patterns)
    total = sum(n for _, n in rows)
    votes = {name: {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.2, 0: 0.3, -1: 0.5}} for name in LABELERS}
    prior = 0.5
    belief: list[float] = []
    for _ in range(EM_STEPS if total else 0):
        belief = []
        for pattern, _n in rows:
            yes, no = math.log(prior), math.log(1 - prior)
            for name, vote in zip(LABELERS, pattern):
                yes += math.log(votes[name][True][vote])
                no += math.log(votes[name][False][vote])
            belief.append(1 / (1 + math.exp(min(50.0, no - yes))))
        prior = (sum(p * n for p, (_, n) in zip(belief, rows)) + 1) / (total + 2)
        for at, name in enumerate(LABELERS):
            for truth in (True, False):
                # One added vote each keeps probabilities off zero; the start values lean the right way.
                mass = {1: 1.2 if truth else 0.8, 0: 1.0, -1: 0.8 if truth else 1.2}
                for p, (pattern, n) in zip(belief, rows):
                    mass[pattern[at]] += n * (p if truth else 1 - p)
                whole = sum(mass.values())
                votes[name][truth] = {vote: value / whole for vote, value in mass.items()}
    features = [(name, vote) for name in LABELERS for vote in (1, -1)]
    weights, bias = dict.fromkeys(features, 0.0), 0.0
    for _ in range(500 if total else 0):
        slope, slopes = 0.0, dict.fromkeys(features, 0.0)
        for (pattern, n), p in zip(rows, belief):
            active = [pair for pair in zip(LABELERS, pattern) if pair[1]]
            error = n / total * (p - 1 / (1 + math.exp(-bias - sum(weights[pair] for pair in active))))
            slope += error
            for pair in active:
                slopes[pair] += error
        bias += 2.0 * slope
        for pair in features:
            weights[pair] += 2.0 * (slopes[pair] - 1e-3 * weights[pair])
    if not total:
        bias = -50.0
    return Model(votes, prior, bias, weights)


def vote_patterns(found: DataFrame) -> DataFrame:
    """How often each combination of votes occurs; at most 81 rows."""
    spans = found.select(F.explode("found").alias("span"))
    return spans.groupBy(*[F.col(f"span.{name}").alias(name) for name in LABELERS]).agg(F.count("*").alias("n"))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """doc_id and `spans` (kind, start, end, base), by kind and start; and the model that chose them."""
    found = stored(candidates(docs, id_column, text), "candidates")
    model = fit(vote_patterns(found).collect())
    base = F.filter("found", lambda span: span["base"])
    df = found.withColumn("__base", base)
    added = F.filter(
        "found",
        lambda span: ~span["base"]
        & (model.probability(span) >= threshold)
        & ~F.exists("__base", lambda kept: (kept["start"] < span["end"]) & (span["start"] < kept["end"])),
    )
    place = lambda span: F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["base"].alias("base"))
    # Candidates come kind by kind in the order of KINDS and by start, so filters keep that order.
    added_ones = F.transform(added, place)
    spans = F.concat(F.transform("__base", place), added_ones)
    ranked = F.array_sort(F.transform(spans, lambda span: F.struct(_rank(span["kind"]).alias("rank"), span["start"].alias("start"), span.alias("span"))))
    return df.select("doc_id", F.transform(ranked, lambda entry: entry["span"]).alias("spans")), model


def _rank(kind: Column) -> Column:
    rank = F.lit(len(ORDER))
    for name, at in ORDER.items():
        rank = F.when(kind == name, at).otherwise(rank)
    return rank


def personal_data_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans as text."""
    found, _ = find_personal_data(docs, id_column, text)
    label = lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    base = F.filter("spans", lambda span: span["base"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda span: span["base"] & (span["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
