import random
import re

import pytest

from skillgauge.llm import near_dup
from skillgauge.llm.components import connected_components
from tests.llm.fixtures import documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def varied_texts(seed=3):
    rng = random.Random(seed)
    texts = sample_texts()
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(rng.choice([12, 60, 150]))]
        for _ in range(9):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    return texts


def sets(texts, n):
    out = []
    for text in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        out.append({tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set())
    return out


def brute_force(texts, n, similarity=80):
    found = sets(texts, n)
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(found[a] & found[b])
            if both and 100 * both >= similarity * len(found[a] | found[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(k, len(found[k]), root(k), root(k) == k) for k in range(len(texts))]


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    texts = varied_texts()
    report = near_dup.duplicate_report(documents(spark, texts), shingle=n)
    assert sorted(map(tuple, report.collect())) == brute_force(texts, n)


def test_large_tables_without_a_common_centre(spark):
    # A chain: neighbours are similar, the ends are not, and short keys put all of them in shared tables.
    words = [f"c{k}" for k in range(200)]
    texts = [" ".join(words[k * 6 : k * 6 + 100]) for k in range(14)]
    report = near_dup.duplicate_report(documents(spark, texts), shingle=2, similarity=80, keys=12, values=1)
    assert sorted(map(tuple, report.collect())) == brute_force(texts, 2)


def test_one_of_each_group_stays_with_its_columns(spark):
    texts = varied_texts()
    docs = documents(spark, texts)
    kept = near_dup.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, _, _, keep in brute_force(texts, near_dup.SHINGLE_WORDS) if keep]


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (7, "H i j k l m n"), (None, "a b c d e f g"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in near_dup.duplicate_report(docs, shingle=4).collect())
    assert found == [(0, 0, None), (0, 4, None), (5, 4, None), (5, 4, None), (7, 4, None), (9, 0, 9)]


def test_empty_table(spark):
    assert near_dup.duplicate_report(documents(spark, [])).count() == 0


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(200, 200 + k) for k in range(1, 40)]
    groups = {k: {k} for pair in links for k in pair}
    for a, b in links:
        union = groups[a] | groups[b]
        for k in union:
            groups[k] = union
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {k for a, b in links if a != b for k in (a, b)}
    assert found == {k: min(groups[k]) for k in linked}
