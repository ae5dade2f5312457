import hashlib
import re

import pytest

from skillgauge.llm import substrings
from tests.llm.fixtures import documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{k}" for k in range(40))
TEXTS = [
    *sample_texts(),
    PASSAGE + " own words",
    "lead\t" + PASSAGE.replace(" ", "\n") + " tail " + PASSAGE,
    " ".join(PASSAGE.split()[5:17]),
    " ".join(PASSAGE.split()[5:18]),
    "r " * 200,
    "r " * 12,
    "x r " + "r " * 30 + "y",
]


def brute_force(rows, n):
    least = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - n + 1):
            if least[tuple(words[i : i + n])] < doc:
                gone |= set(range(i, i + n))
        kept = " ".join(word for i, word in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(docs, **options):
    rows = substrings.dedup_substrings(docs, **options).collect()
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_result_equals_brute_force_in_few_and_many_blocks(spark, block_bytes):
    assert result(documents(spark, TEXTS), block_bytes=block_bytes) == brute_force(list(enumerate(TEXTS)), 13)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CELLS_PER_WINDOW", 0)
    assert result(documents(spark, TEXTS), block_bytes=4000) == brute_force(list(enumerate(TEXTS)), 13)


def test_other_window(spark):
    assert result(documents(spark, TEXTS), window=4, block_bytes=5000) == brute_force(list(enumerate(TEXTS)), 4)


def test_repeated_ids_and_null_ids(spark):
    rows = [(3, PASSAGE), (3, PASSAGE), (3, PASSAGE + " more"), (9, PASSAGE), (None, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.dedup_substrings(docs).collect()}
    assert found == {(None, 40): 0, (3, 40): 40, (3, 41): 40, (9, 40): 40}
    docs = docs.filter("doc_id IS NOT NULL")
    found = [(r["doc_id"], r["n_removed"]) for r in substrings.dedup_substrings(docs).collect()]
    assert sorted(found) == [(3, 0), (3, 0), (3, 0), (9, 40)]


def test_empty_table(spark):
    assert result(documents(spark, [])) == []
