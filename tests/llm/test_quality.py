import re
from collections import Counter

import pytest

from skillgauge.llm import quality
from tests.llm.fixtures import by_id, documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def verdict(text):
    c = counts(text)
    lines = len([line for line in (text or "").split("\n") if WORD.search(line)])
    failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    other = 10 * c["n_symbols"] > c["n_words"] or 10 * c["n_dup_lines"] > 5 * lines or 10 * (text or "").count("!") > 3 * c["n_words"] or c["word_chars"] > 20 * c["n_words"]
    return failed, not failed and not other


def test_report_equals_brute_force(spark):
    texts = [*sample_texts(), "a # b $ " * 30, "SHOUT!! LOUD!! " * 3 + "one two three four five", "z" * 5000 + " a b c d e f g h i j", "l1 x\n" * 40]
    found = by_id(quality.quality_report(documents(spark, texts)))
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        row = found[k]
        assert {name: row[name] for name in counts(text)} == counts(text), k
        assert (row["base_failed"], row["kept"]) == verdict(text), k


@pytest.mark.parametrize("order", [quality.RULES, quality.RULES[::-1]])
def test_cascade_keeps_the_same_documents_in_any_order(spark, order):
    docs = documents(spark)
    judged = quality.quality_cascade(docs.select("doc_id", "text"), order=order)
    kept = {row["doc_id"] for row in judged.filter("rejected_by IS NULL").collect()}
    assert kept == {k for k, text in enumerate(sample_texts()) if verdict(text)[1]}


def test_kept_documents_have_their_own_columns(spark):
    docs = documents(spark)
    kept = quality.keep_quality(docs)
    assert kept.schema == docs.schema
    assert {row["doc_id"] for row in kept.collect()} == {k for k, text in enumerate(sample_texts()) if verdict(text)[1]}


def test_order_is_by_rejections_per_second():
    costs = [quality.RuleCost(rule.name, seconds, rejected, 10) for rule, seconds, rejected in zip(quality.RULES, [1, 2, 1, 1, 1, 1], [1, 8, 3, 3, 0, 0])]
    assert [rule.name for rule in quality.cascade_order(costs)][:4] == ["repeated_words", "symbols", "repeated_lines", "too_few_words"]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert quality.quality_report(docs).count() == 0
    assert quality.keep_quality(docs).count() == 0
