import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from skillgauge.llm import packing
from tests.llm.fixtures import document_rows, documents, sample_texts

ODD = ["it's we'll THEY'VE don't 'd", "naïve Ünï — “quoted” x² ½", "áb é   x y", "İstanbul ΣΑΣ ﬁ", "<|endoftext|> a<|startoftext|>b", "12 345 a1b2", "\x1c\x1f z", "日本語 テキスト", "ab" * 3000]


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END] for text in texts]


def best_fit_count(lengths, room):
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k, f in enumerate(free) if f >= n), key=lambda k: free[k], default=None)
        if at is None:
            free.append(room - n)
        else:
            free[at] -= n
    return len(free)


def check_layout(rows, room):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences)


@pytest.mark.parametrize("room", [32, 4096])
def test_round_trip(spark, room):
    texts = sample_texts() + ODD
    rows = packing.pack(documents(spark, texts), room=room).collect()
    ids = reference_ids(texts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(range(len(texts)))
    for k, found in pieces.items():
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids[k]) // room)))
        for r in found:
            cut = ids[k][r["start"] : r["start"] + room]
            assert r["start"] == room * r["piece"] and r["length"] == len(cut)
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    lengths = [r["length"] for r in rows]
    assert check_layout(rows, room) <= 1.03 * best_fit_count(lengths, room) + 1


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [*document_rows(["one two"] * 5), *[(None, None, "en", "a", 0, True, "x", 3, "y", 9)] * 2]
    docs = spark.createDataFrame(rows + rows[:5], documents(spark).schema)
    found = packing.pack(docs).collect()
    assert Counter(r["doc_id"] for r in found) == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, None: 2}
    assert check_layout(found, packing.ROOM) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_same_counts_under_other_partitions(spark):
    few, many = (packing.pack(documents(spark, partitions=n), room=64).collect() for n in (1, 13))
    assert len({r["sequence_id"] for r in few}) == len({r["sequence_id"] for r in many})
    assert sorted(few) == sorted(many)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB'sétT .,1\ń")), max_size=40))
def test_units_give_the_ids_of_the_whole_text(text):
    units = packing._units(packing.TOKENIZER)
    assert next(iter(units.encode([text]))) == np.array(reference_ids([text])[0][:-1], "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_every_piece_once(lengths):
    histogram = np.bincount(np.array(lengths, np.int64), minlength=65)
    groups = packing.plan(histogram, 64, 16)
    held = Counter()
    for g in groups:
        assert g.free == 64 - sum(length * n for length, n in g.filled) and g.free >= 0
        for length, n in g.filled:
            held[length] += n * g.count
    assert held == Counter(lengths)
    assert sum(g.count for g in groups) <= best_fit_count(lengths, 64) * 1.15 + 2


def test_fit_is_the_non_negative_least_squares_solution():
    rng = np.random.default_rng(3)
    target = np.concatenate([[0], rng.integers(0, 50, 12)]).astype(float)
    columns = packing.patterns(np.ones(13), 12)
    weights = np.linspace(0.2, 1, 13)
    used, repeats = packing.non_negative_fit(columns, target, weights)
    matrix = np.array([[np.count_nonzero(c == k) if k else 0 for c in columns] for k in range(13)]) * weights[:, None]
    x = np.zeros(len(columns))
    for c, n in zip(used, repeats):
        x[next(k for k, row in enumerate(columns) if (row == c).all())] = n
    gradient = matrix.T @ (matrix @ x - target * weights)
    assert (x >= 0).all() and (gradient > -1e-4).all() and np.abs(gradient[x > 0]).max() < 1e-4


def test_mostly_filled_by_patterns():
    rng = np.random.default_rng(1)
    lengths = np.minimum(np.exp(rng.normal(6.4, 1.1, 20_000)).astype(int) + 1, 4096)
    histogram = np.bincount(lengths, minlength=4097)
    groups = packing.plan(histogram)
    assert sum(g.count for g in groups) <= 1.01 * lengths.sum() / 4096
