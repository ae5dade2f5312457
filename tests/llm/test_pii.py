import hashlib
import re

from skillgauge.llm import pii
from tests.llm.fixtures import by_id, documents, sample_texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "😀 écrire à Ann.34@mail7.example.com, a@b.c_d@e.f x@@y.z a@b a@b.c@d.e.f",
    "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8.9 0255.255.255.255 256.1.1.1 v1.2.3 10.0.0.1.",
    "4417 7442-8035 1547 4417744280351547 2390409500648960 0000000000000000000000 4111-1111-1111-1111 12 34",
    "+1 (017) 555-7713 +49 30 1234567 +1 + 2 +123 +123456789012345678 ++49(0)30-12",
    "my ssn 123-45-6789, account 000-12-3456; iban GB82WEST12345698765432 ok",
    "call phone 555-123-4567 or (212) 555 0199. Dr. James Smith and Mrs Quux",
    "7" * 50_000 + " " + "1." * 20_000 + " " + "a" * 50_000 + "@",
    "mail contact: a1@x.org " * 40,
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(part) <= 255 for part in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append((kind, *m.span()))
    return spans


def test_base_spans_equal_plain_patterns(spark):
    texts = [*sample_texts(), *TEXTS]
    found = by_id(pii.personal_data_report(documents(spark, texts)))
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        spans = base_spans(text)
        label = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert found[k]["base_sha256"] == hashlib.sha256(label.encode()).hexdigest(), (k, (text or "")[:80], spans)
        assert all(f"{a}:{b}:{c}" in found[k]["spans"].split(",") for a, b, c in spans)
        for kind in PATTERNS:
            assert found[k][f"n_{kind}"] == sum(span[0] == kind for span in spans)


def test_added_spans_are_plausible_and_apart_from_base_spans(spark):
    spans, model = pii.find_personal_data(documents(spark, TEXTS * 5))
    for k, row in by_id(spans).items():
        base = [s for s in row["spans"] if s["base"]]
        for span in row["spans"]:
            if not span["base"]:
                assert all(b["end"] <= span["start"] or span["end"] <= b["start"] for b in base)
    added = [(s["kind"], TEXTS[4][s["start"] : s["end"]]) for s in by_id(spans)[4]["spans"]]
    assert ("ssn", "123-45-6789") in added
    assert model.weights["structure", 1] > 0 > model.weights["structure", -1]
    for name in pii.LABELERS:
        for truth in (True, False):
            assert abs(sum(model.votes[name][truth].values()) - 1) < 1e-9


def test_em_learns_which_labeler_to_trust():
    from pyspark.sql import Row

    rows = []
    for truth, n in ((1, 300), (-1, 700)):
        # Structure and context follow the truth, shape is noise.
        for shape in (1, -1):
            rows.append(Row(shape=shape, structure=truth, gazetteer=1 if truth > 0 else 0, context=truth, n=n))
    model = pii.fit(rows)
    assert 0.25 < model.prior < 0.35
    assert model.votes["structure"][True][1] > 0.95 and model.votes["structure"][False][-1] > 0.95
    assert abs(model.votes["shape"][True][1] - 0.5) < 0.05
    assert model.weights["structure", 1] > abs(model.weights["shape", 1])


def test_nothing_to_learn_from(spark):
    assert pii.personal_data_report(documents(spark, [])).count() == 0
    rows = pii.personal_data_report(documents(spark, [None, "", "plain words"])).collect()
    assert {row["spans"] for row in rows} == {""}
