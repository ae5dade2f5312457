"""Secret scans: keyword prefilter, anchored patterns near its hits, checksums (operator 10).

One pass of a keyword automaton over each text finds where a pattern can start at all; the pattern of
that keyword is matched only there. Token formats that carry a checksum are kept only if it holds.
Runs of hexadecimal digits have no keyword and are found by their own pattern. Documents are handled
one by one inside the tasks of the scan, without a shuffle.

Defined results: a null text is empty; a document without a secret has an empty span list; repeated
rows give repeated results; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds in the order of reports; the first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
KINDS = BASE_KINDS + CHECKED_KINDS

# The formats that are looked for.
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18


def base62_crc32(body: str) -> str:
    """The six-digit checksum that ends a token."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for keyword in keywords:
            found.add_word(keyword, (kind, len(keyword)))
    found.make_automaton()
    return found


def secret_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind; matches of one kind do not overlap."""
    spans = []
    last_end = dict.fromkeys(KEYWORDS, 0)
    # Lower-casing bytes touches A-Z only, so positions stay.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end + 1 - length, kind) for end, (kind, length) in automaton.iter(lowered))
    for start, kind in hits:
        if start < last_end[kind]:
            continue
        pattern = {"assign": ASSIGN, "access": ACCESS}.get(kind, CHECKED)
        match = pattern.match(text, start)
        if not match:
            continue
        if kind == "assign":
            good = len(match[2]) >= ASSIGN_LENGTH
        elif kind == "access":
            good = match.end() - start >= ACCESS_LENGTH
        else:
            good = base62_crc32(match[1]) == match[2] and not (start and text[start - 1].isalnum())
        last_end[kind] = match.end()
        if good:
            spans.append((kind, start, match.end()))
    spans += [("hex", *match.span()) for match in HEX.finditer(text)]
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0])))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `secrets`, an array of (kind, start, end) in code points, end exclusive."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            found = [
                [{"kind": kind, "start": start, "end": end} for kind, start, end in secret_spans(value.as_py(), automaton)]
                for value in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "secrets"])

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {id_type}, secrets array<struct<kind: string, start: int, end: int>>")


def secret_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base kinds, and all spans as text."""
    found = find_secrets(docs, id_column, text)
    label = lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    base = F.filter("secrets", lambda span: span["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.size(F.filter("secrets", lambda span: span["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def mask_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """doc_id and text with every found span replaced; spans that overlap are replaced together."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()

        def cleaned(value: str | None) -> str | None:
            if value is None:
                return None
            parts, at = [], 0
            for _, start, end in secret_spans(value, automaton):
                if end <= at:
                    continue
                if start >= at:
                    parts += [value[at:start], mask]
                at = end
            return "".join([*parts, value[at:]])

        for batch in batches:
            texts = pa.array([cleaned(value.as_py()) for value in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {id_type}, text string")
