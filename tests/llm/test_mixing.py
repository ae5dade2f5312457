import hashlib
import math
from collections import defaultdict

from skillgauge.llm import mixing
from tests.llm.fixtures import by_id, document_rows, documents, sample_texts


def targets(sizes):
    """Water filling by repeated sharing; sources by name, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: (5, 2, 1)[k % 3] for k, name in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * weight[s] / rest > 2 * sizes[s] + 1e-9]
        if not over:
            return {s: full.get(s, left * weight[s] / rest if rest else 0) for s in names}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


def expected(rows):
    sizes = {row[0]: len((row[1] or "").split()) for row in rows}
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row[0])
    total = {s: sum(sizes[d] for d in ids) for s, ids in by_source.items()}
    wanted, out = targets(total), {}
    for source, ids in by_source.items():
        budget = math.floor(wanted[source] + 1e-9)
        for d in sorted(ids, key=lambda d: (hashlib.md5(f"42:{d}".encode()).hexdigest(), d)) * 3:
            take = min(sizes[d], budget)
            out[d] = out.get(d, 0) + take
            budget -= take
    return sizes, total, wanted, out


def test_mix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = document_rows(sample_texts())
    sizes, total, wanted, taken = expected(rows)
    found = by_id(mixing.mix_sources(documents(spark)))
    assert {k: row["size"] for k, row in found.items()} == sizes
    assert {k: row["taken"] for k, row in found.items()} == taken
    for k, row in found.items():
        assert row["source_size"] == total[rows[k][3]]
        assert abs(row["target"] - wanted[rows[k][3]]) < 1e-6
        assert row["taken"] <= 2 * row["size"]


def test_reruns_and_partitions_agree(spark):
    one = sorted(map(tuple, mixing.mix_sources(documents(spark)).collect()), key=str)
    assert one == sorted(map(tuple, mixing.mix_sources(documents(spark, partitions=11)).collect()), key=str)


def test_mixed_documents_hold_what_the_plan_takes(spark):
    texts = [*sample_texts(), *sample_texts()[:9]]
    docs = documents(spark, texts).unionByName(documents(spark, texts).limit(3))
    plan = mixing.mix_sources(docs).groupBy().sum("taken").first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "epoch", "take_words"]
    assert mixed.groupBy().sum("take_words").first()[0] == plan


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    rows = mixing.mix_sources(documents(spark, [None, "", " "])).collect()
    assert [row["taken"] for row in rows] == [0, 0, 0]


def test_equal_texts_in_two_sources_and_rows_that_differ_elsewhere(spark):
    schema = "doc_id bigint, text string, source string, n_chars int"
    rows = [(1, "a b c d e f", "s1", 1), (1, "a b c d e f", "s1", 2), (1, "a b c d e f", "s2", 3), (2, "g h i", "s1", 4), (None, "j k", None, 5)]
    docs = spark.createDataFrame(rows, schema)
    plan = {(r["source"], r["target"]): r["n"] for r in mixing.mix_sources(docs).groupBy("source", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    mixed = mixing.mixed_documents(docs).collect()
    for (source, target), taken in plan.items():
        assert sum(r["take_words"] for r in mixed if r["source"] == source) == taken == math.floor(target + 1e-9)
    assert max(r["epoch"] for r in mixed) <= 2
    again = mixing.mixed_documents(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
