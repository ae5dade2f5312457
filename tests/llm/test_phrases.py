import random
import re
from collections import Counter

import pytest

from skillgauge.llm import phrases
from tests.llm.fixtures import documents

ROWS = "doc_id bigint, text string, lang string, n bigint, words string, hash int, score string"


def brute_force(rows, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), f in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner = (lang, w[i : i + m])
                if 100 * f >= 100 * candidates[inner]:
                    gone.add(inner)
    out = []
    for lang, w in set(candidates) - gone:
        a, n = candidates[lang, w], totals[lang]
        cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w), counts[lang, w[:k]], counts[lang, w[k:]], n))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out, key=lambda r: (r[0], r[1], r[2], r[3].encode())):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase, -a, left, right, n, -score))
    return rows


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "déjà", "vu", "of", "the", "a", "naïve", " ", "x1", "😀"]
    fixed = ["new York city hall now", "once upon a time there was", "aa aa aa aa aa aa aa"]
    rows = [(None, "en"), ("", None), ("...!!,\n\t ", "en"), ("one", "de")]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(3, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, k=rng.randrange(1, 8))))
        rows.append((rng.choice([" ", ". ", ",", "\n", "\t", "\r"]).join(parts), rng.choice(["en", "de", None, "und"])))
    return rows


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(k, text, lang, 1, "w", 2, "s") for k, (text, lang) in enumerate(rows)], ROWS).repartition(partitions)


@pytest.mark.parametrize("least, longest", [(3, 5), (10, 5), (4, 2), (4, 3), (40, 4)])
def test_equals_brute_force(spark, least, longest):
    rows = corpus()
    found = phrases.top_phrases(table(spark, rows), least=least, longest=longest).collect()
    assert sorted(map(tuple, found)) == sorted(brute_force(rows, least, longest))


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    rows = corpus(8)
    monkeypatch.setattr(phrases, "_MOST_BITS", 6)
    found = phrases.top_phrases(table(spark, rows), least=5, top=9).collect()
    assert sorted(map(tuple, found)) == sorted(brute_force(rows, 5, top=9))


def test_repeated_rows_count_each(spark):
    rows = [("red herring here", "en")] * 150 + [("red car. herring", "en")] * 5
    found = phrases.top_phrases(table(spark, rows)).collect()
    assert [tuple(r) for r in found] == brute_force(rows, 100)
    assert [r["phrase"] for r in found] == ["red herring here"]


def test_empty_tables_and_very_long_texts(spark):
    docs = documents(spark, ["over and out " * 100_000])
    assert [tuple(r) for r in phrases.top_phrases(docs).collect()] == brute_force([("over and out " * 100_000, "en")], 100)
    assert phrases.top_phrases(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 999_999_999_999_999, 10**17 + 7, 10**15 + 1, 10**15 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    assert row.select(phrases.lift(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("x")).first()["x"] == 1000 * a * n // (left * right)
