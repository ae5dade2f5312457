import math
import re
import zlib
from collections import Counter

import pytest

from skillgauge.llm import lm_scoring
from skillgauge.llm.lm_scoring import _bucket
from tests.llm.fixtures import by_id, documents, sample_texts

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + ["</s>"]


def learned(texts):
    single, pair, context = Counter(), Counter(), Counter()
    for k, text in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            found = tokens(text)
            before = ["<s>", *found[:-1]]
            single.update(found)
            pair.update(zip(before, found))
            context.update(before)
    return single, pair, context


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_scores_equal_brute_force(spark, block_bytes):
    texts = sample_texts()
    scored, model = lm_scoring.score_documents(documents(spark, texts), block_bytes=block_bytes)
    found = by_id(scored)
    single, pair, context = learned(texts)
    n, v = sum(single.values()), len(single)
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        words, row = tokens(text), found[k]
        assert row["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(single[w] > 0 for w in words), n)
        assert row["base_score"] == pytest.approx(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in words))
        score = 0.0
        for before, word in zip(["<s>", *words[:-1]], words):
            weight = model.weights[_bucket(np.array([context[before]]))[0]]
            high = pair[before, word] / context[before] if context[before] else 0.0
            score += math.log10(weight[0] * high + weight[1] * single[word] / n + weight[2] / (v + 1))
        assert row["score"] == pytest.approx(score), k


def test_probabilities_add_up_to_one(spark):
    texts = sample_texts()
    _, model = lm_scoring.score_documents(documents(spark, texts))
    single, pair, context = learned(texts)
    for before in ["<s>", "the", "never seen"]:
        total = 10.0 ** model.log10(np.array([float(context[before])]), np.zeros(1), np.zeros(1))[0]  # all unseen tokens together
        for word, c in single.items():
            total += 10.0 ** model.log10(np.array([float(context[before])]), np.array([float(c)]), np.array([float(pair[before, word])]))[0]
        assert total == pytest.approx(1.0)
    assert np.allclose(model.weights.sum(1), 1)


def test_learned_weights_beat_equal_weights_on_held_out_text(spark):
    texts = [f"alpha beta gamma delta {k % 3} epsilon zeta " * 5 for k in range(120)]
    scored, model = lm_scoring.score_documents(documents(spark, texts))
    rows = [r for r in scored.collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    often = model.weights[_bucket(np.array([515]))[0]]
    assert often[0] > 0.8


def test_nothing_to_learn_from(spark):
    assert lm_scoring.score_documents(documents(spark, []))[0].count() == 0
    only_held_out = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    docs = spark.createDataFrame([(only_held_out, "a b"), (only_held_out, None)], "doc_id bigint, text string")
    rows = lm_scoring.score_documents(docs)[0].collect()
    assert [r["score"] for r in rows] == pytest.approx([0.0, 0.0])


def test_unseen_contexts_learn_their_weights():
    bins, count = [0, 501 + 3 * lm_scoring.BINS_PER_OCTAVE, 501 - lm_scoring.BINS_PER_OCTAVE], [4000, 3000, 2000]
    seen = [{"code": (2 << 20) | (520 << 10) | 510, "n": 700}]
    model = lm_scoring.learn_weights([*({"code": low, "n": n} for low, n in zip(bins, count)), *seen], 10000, 500)
    ratios = [2.0 ** ((b - 500.5) / lm_scoring.BINS_PER_OCTAVE) if b else 0.0 for b in bins]
    unigram = 0.5
    for _ in range(2000):
        unigram = sum(n * unigram * r / (unigram * r + 1 - unigram) for n, r in zip(count, ratios)) / sum(count)
    assert model.weights[0, 0] == 0 and abs(model.weights[0].sum() - 1) < 1e-12
    assert abs(model.weights[0, 1] - unigram) < 0.01
    assert list(lm_scoring.learn_weights(seen, 10000, 500).weights[0]) == [0.0, 0.9, 0.1]
    assert list(lm_scoring.learn_weights([], 0, 0).weights[0]) == [0.0, 0.0, 1.0]
