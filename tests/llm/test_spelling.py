import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skillgauge.llm import spelling
from tests.llm.fixtures import document_rows, documents


def counted(rows, one_in=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_force(rows, one_in=199):
    counts = counted(rows, one_in)
    near = {w: [o for o in counts if is_near(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def texts(seed=3):
    rng = random.Random(seed)
    stems = ["colour", "gardén", "Naïveté", "straße", "aaaaaa", "mississippi", "abcabcabc"]
    out = [None, "", "short run", "\n"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(30, 90)):
            word = rng.choice(stems[: rng.randrange(1, len(stems) + 1)])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(word))
                word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "e" + word[k:], word[:k] + rng.choice("aéx") + word[k + 1 :]])
            words.append(word)
        out.append(" ".join(words).replace(" ", rng.choice([" ", ", ", "-", "1"])))
    return out


@pytest.mark.parametrize("one_in", [199, 3])
def test_equals_brute_force(spark, one_in):
    sample = texts()
    found = spelling.spelling_forms(documents(spark, sample), one_in=one_in).collect()
    wanted = brute_force(list(enumerate(sample)), one_in)
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_chains_repeated_rows_null_ids_and_ties(spark):
    sample = ["abcdef " * 125 + "abcdeg " * 25 + "abcdhg " * 5 + "abxdhg " * 5 + "zbcdef " * 125]
    rows = [(None, *row[1:]) for row in document_rows(sample)]
    docs = spark.createDataFrame(rows + rows, documents(spark).schema)
    found = {tuple(r) for r in spelling.spelling_forms(docs).collect()}
    assert found == brute_force([(None, sample[0])] * 2)
    assert ("abcdhg", "abcdeg", "abcdef", 10, 2, 50) in found


def test_empty_table_and_very_long_text(spark):
    docs = documents(spark, ["wordwordword " * 200_000])
    assert [r["n"] for r in spelling.spelling_forms(docs).collect()] == [200_000]
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


@pytest.mark.parametrize("symbols", [4, 9])
def test_neighbourhood_holds_every_edited_form(symbols):
    rng = np.random.default_rng(symbols)
    forms = rng.integers(1, symbols + 1, (20, 7)).astype(np.uint64)
    near = spelling._neighbourhood(forms, symbols)
    for row, keys in zip(forms, near):
        edits = [row, *(np.delete(row, k) for k in range(7))]
        edits += [np.concatenate([row[:k], [s], row[k + 1 :]]) for k in range(7) for s in range(1, symbols + 1)]
        edits += [np.concatenate([row[:k], [s], row[k:]]) for k in range(8) for s in range(1, symbols + 1)]
        wanted = {int(spelling._own(e.astype(np.uint64)[None, :])[0]) for e in edits}
        assert set(keys.tolist()) == wanted


def test_symbols_grow_with_the_vocabulary():
    assert [spelling.symbols_for(n) for n in (0, 10, 10**5, 10**6, 10**8, 10**12)] == [4, 4, 7, 10, 22, 24]
