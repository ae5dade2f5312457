import hashlib
import re

import pytest

from skillgauge.llm import line_dedup
from tests.llm.fixtures import by_id, documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]")
A, B, C, D = "line a here", "line b here", "line c here", "line d here"
TEXTS = [
    *sample_texts(),
    "\n".join([A, B, C, D]),
    "\n".join(["own", A, B, "", C, D, "own too"]),
    "\n".join([A, B, C, D]),
    "\n".join([A] * 9),
    "\n".join(["x", A, B]),
    "\n".join(["y", A, B]),
    "\n".join([B, C, D, "z"]),
    "\n".join(f"line {k}" for k in range(300)),
    "\n".join(f"line {k}" for k in range(100, 400)),
]


def brute_force(texts, min_lines):
    seen, gone = {}, []
    for text in texts:
        lines = (text or "").split("\n")
        worded = [i for i, line in enumerate(lines) if WORD.search(line)]
        lost, copied = set(), 0
        for p in range(len(worded) - min_lines + 1):
            window = tuple(lines[worded[p + k]] for k in range(min_lines))
            if window in seen:
                lost |= {worded[p + k] for k in range(min_lines)}
                copied += 1
            seen.setdefault(window, True)
        kept = "\n".join(line for i, line in enumerate(lines) if i not in lost)
        gone.append((len(worded), len(lost), copied, hashlib.sha256(kept.encode()).hexdigest(), kept))
    return gone


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5, 8])
def test_report_equals_brute_force(spark, min_lines):
    found = by_id(line_dedup.line_report(documents(spark, TEXTS), min_lines))
    for k, wanted in enumerate(brute_force(TEXTS, min_lines)):
        assert tuple(found[k])[1:] == wanted[:4], (k, TEXTS[k])


def test_deduplicated_documents_keep_columns_and_lengths(spark):
    docs = documents(spark, TEXTS)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    rows = by_id(kept)
    wanted = brute_force(TEXTS, line_dedup.MIN_LINES)
    assert set(rows) == {k for k, w in enumerate(wanted) if not (w[1] and w[1] == w[0])}
    for k, row in rows.items():
        assert (row["text"] or "") == (wanted[k][4] if wanted[k][1] else TEXTS[k] or "")
        if wanted[k][1]:
            assert row["n_chars"] == len(row["text"])
    assert rows[0]["text"] is None


def test_runs_are_maximal(spark):
    texts = ["\n".join(f"line {k}" for k in range(20)), "\n".join(["new", *(f"line {k}" for k in range(5, 14)), "end"])]
    windows = line_dedup.repeated_windows(documents(spark, texts))
    runs = line_dedup.repeated_runs(windows).collect()
    assert [(r["doc"]["id"], r["start"], r["n_lines"], r["source"]["id"], r["source_start"]) for r in runs] == [(1, 1, 9, 0, 5)]


def test_repeated_rows_null_ids_and_partitions(spark):
    docs = documents(spark, TEXTS)
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0")).unionByName(docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    one = line_dedup.line_report(docs).collect()
    other = line_dedup.line_report(docs.repartition(13)).collect()
    assert len(one) == docs.count() and sorted(map(str, one)) == sorted(map(str, other))


def test_empty_table(spark):
    assert line_dedup.line_report(documents(spark, [])).count() == 0


LONG = [" ".join(f"{name}{k}" for k in range(n)) for name, n in (("p", 60), ("q", 30), ("r", 20), ("s", 49), ("t", 50), ("u", 49))]
PASSAGES = [
    *TEXTS,
    *LONG,
    "\n".join([LONG[1], LONG[2]]),
    "\n".join(["before", LONG[0], "after"]),
    "\n".join(["other", LONG[1], "", LONG[2], "end"]),
    "\n".join(["other", LONG[2], LONG[1], "end"]),
    "\n".join(["some", LONG[3], "more"]),
    "\n".join(["some", LONG[4], LONG[4], "x1", LONG[5]]),
    "\n".join([A, B, C, LONG[0]]),
]


def brute_force_passages(texts, min_lines, min_words):
    seen, gone = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        worded = [i for i, line in enumerate(lines) if WORD.search(line)]
        lost, copied = set(), 0
        for p in range(len(worded)):
            for n in range(1, min(min_lines, len(worded) - p) + 1):
                spot = worded[p : p + n]
                window = tuple(lines[i] for i in spot)
                if n == min_lines or sum(len([w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]) for line in window) >= min_words:
                    if window in seen:
                        lost |= set(spot)
                        copied += 1
                    seen.add(window)
        kept = "\n".join(line for i, line in enumerate(lines) if i not in lost)
        gone.append((len(worded), len(lost), copied, hashlib.sha256(kept.encode()).hexdigest()))
    return gone


@pytest.mark.parametrize("min_lines", [1, 3, 6])
def test_short_runs_of_many_words_go(spark, min_lines):
    found = by_id(line_dedup.line_report(documents(spark, PASSAGES), min_lines, min_words=50))
    for k, wanted in enumerate(brute_force_passages(PASSAGES, min_lines, 50)):
        assert tuple(found[k])[1:] == wanted, (k, PASSAGES[k])


def test_deduplicated_documents_lose_one_line_passages(spark):
    rows = by_id(line_dedup.dedup_lines(documents(spark, ["\n".join(["a", LONG[0], "b"]), "\n".join(["c", LONG[0], "d"]), LONG[0]]), min_words=50))
    assert {k: row["text"] for k, row in rows.items()} == {0: f"a\n{LONG[0]}\nb", 1: "c\nd"}
