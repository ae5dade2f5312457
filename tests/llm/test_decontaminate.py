import hashlib
import re

import pytest

from skillgauge.llm import decontaminate
from tests.llm.fixtures import documents, sample_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "The quick brown fox jumps over the lazy dog while nine small birds watch from Éa trees"
ITEMS = [
    (1, LONG, "x"),
    (20, "unrelated words that nobody else has ever written down in this way at all", "x"),
    (3, "Four short words here", "x"),
    (4, None, "x"),
    (5, " .,; ", "x"),
    (6, LONG, "x"),
    (7, "solo", "x"),
    (8, "a a a a a a a a a a a a", "x"),
]
TEXTS = [
    *sample_texts(n=18),
    "before " + LONG.upper().replace("É", "É") + " after",
    "before " + " ".join(LONG.split()[3:13]) + " after",
    "before " + " ".join(LONG.split()[3:12]) + " after",
    "x four, SHORT; words... here y four short words",
    "a " * 40,
    "solo x solo",
    " ".join(LONG.split()[:11] + ["gap"] + LONG.split()[2:]),
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_force(texts, items):
    windows = {}
    for item, text, _ in items:
        words = WORD.findall(lowered(text))
        n = min(len(words), 10)
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    widths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in widths:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        names = ",".join(sorted(map(str, found)))
        out.append((len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string, doc_id string")


def rows(report):
    return sorted(tuple(row)[:6] for row in report.collect())


def test_report_equals_brute_force(spark, items):
    found = rows(decontaminate.contamination_report(documents(spark, TEXTS), items))
    assert found == [(k, *wanted) for k, wanted in enumerate(brute_force(TEXTS, ITEMS))]


def test_shuffled_join_gives_the_same(spark, items, monkeypatch):
    docs = documents(spark, TEXTS)
    small = rows(decontaminate.contamination_report(docs, items))
    monkeypatch.setattr("skillgauge.llm.storage.BROADCAST_BYTES", -1)
    assert rows(decontaminate.contamination_report(docs, items)) == small


def test_every_shared_span_of_the_guaranteed_length_is_found(spark):
    words = [f"u{k * 7919 % 1000}" for k in range(60)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    texts = [" ".join(["p", *words[a : a + 10], "q"]) for a in range(51)]
    found = rows(decontaminate.contamination_report(documents(spark, texts), item))
    assert [row[2] for row in found] == [10] * 51


def test_dropping_keeps_clean_documents_and_columns(spark, items):
    docs = documents(spark, TEXTS)
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k, w in enumerate(brute_force(TEXTS, ITEMS)) if not w[4]]


def test_repeated_rows_and_empty_tables(spark, items):
    docs = documents(spark, TEXTS)
    doubled = docs.unionByName(docs)
    once = rows(decontaminate.contamination_report(docs, items))
    assert rows(decontaminate.contamination_report(doubled, items)) == sorted(once * 2)
    assert decontaminate.contamination_report(documents(spark, []), items).count() == 0
    assert not any(row[5] for row in rows(decontaminate.contamination_report(docs, items.limit(0))))
