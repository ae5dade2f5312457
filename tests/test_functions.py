import math

import pytest
from pyspark.sql import functions as F

from skillgauge.functions import text as tx
from skillgauge.functions.answers import answer_position, choice_position
from skillgauge.functions.binomial import exact_interval
from skillgauge.functions.metrics import round3

POSITIONS = [
    ("A. text", 1, 1), ("B) x", 2, 2), ("3: y", 3, 3), ("A.", None, None), ("Answer: B", None, None),
    ("The answer is B", 2, 2), ("'C'", 3, 3), ("E", None, None), ("II", 2, 2), ("I", 1, None), ("#", 3, 3),
    ("β", 2, 2), ("   ", None, None), (None, None, None), ("", None, None), ("  d\t", 4, 4), ("iv", None, None),
    ("1.23", None, None), (". text", None, None), ("the correct answer is IV", 4, 4), ("`2`", 2, 2), ("BC", None, None),
    (" A. text", 1, 1), ("the answer is 'C'", None, 3), ("10", None, None), ("V", None, None), ("κ", None, None),
]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_answer_positions(spark):
    got = values(
        spark, [(t,) for t, _, _ in POSITIONS], "a string", "a", answer_position(F.col("a")), answer_position(F.col("a"), True)
    )
    assert got == POSITIONS


def test_choice_positions(spark):
    rows = [("A. cat", ["dog", "cat"]), ("cat", ["dog", "cat"]), ("A. cow", ["dog", "cat"]), (None, ["dog"]), ("A. x. y", ["x", "x. y"])]
    got = values(spark, rows, "a string, c array<string>", choice_position(F.col("a"), F.col("c")))
    assert got == [(2,), (None,), (None,), (None,), (2,)]


def test_question_text(spark):
    rows = [("Question: x\n\nA. …",), ("Q: x",), ("Question: a Question: b",), ("Question:\n y \n\nz",)]
    assert values(spark, rows, "a string", tx.question_text(F.col("a"))) == [("x",), (None,), ("a",), ("y",)]


def test_round_half_even(spark):
    rows = [(0.0625,), (0.0995,), (0.1875,), (None,)]
    assert values(spark, rows, "a double", round3(F.col("a"))) == [(0.062,), (0.1,), (0.188,), (None,)]


def test_scores_in_text(spark):
    rows = [('text {"1":{"reasoning":"r","score":3}} end',), ("no json",), ('{"1": 5, "2": {"score": "x"}}',), ("{broken",)]
    scores = tx.scoring_map(F.col("a"))
    got = values(spark, rows, "a string", tx.score_or_default(scores, "1"), tx.score_or_default(scores, "2"))
    assert got == [(3.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]


def test_chat_messages(spark):
    text = (
        "<|im_start|>system\nSort the harvest reports.\n<|im_end|>\n<|im_start|>system name=field_clerk\nTwo crates of pears.\n<|im_end|>\n"
        "<|im_start|>user\nWhere do they go?\n<|im_end|>\n"
    )
    ((messages,), (none,)) = values(spark, [(text,), ("plain",)], "a string", tx.chat_messages(F.col("a")))
    assert [(m["role"], m["content"], m["attributes"]) for m in messages] == [
        ("system", "Sort the harvest reports.", None),
        ("system", "Two crates of pears.", {"name": "field_clerk"}),
        ("user", "Where do they go?", None),
    ]
    assert none is None


def test_template_values_are_not_expanded(spark):
    fill = tx.fill_template("{{a}} {x}|{y}", {"x": F.col("x"), "y": F.col("y")})
    assert values(spark, [("{y}", "z")], "x string, y string", fill) == [("{a} {y}|z",)]


def test_names(spark):
    columns = [tx.file_stem(F.col("a")), tx.safe_file_name(F.col("a")), tx.short_model_name(F.col("a"))]
    assert values(spark, [("d/mmlu.x.parquet",)], "a string", *columns) == [("mmlu.x", "d_mmlu_x_parquet", "mmlu.x.parquet")]


def test_ratio_labels(spark):
    rows = [(305, 851), (0, 274), (0, 0), (1, 64)]
    assert values(spark, rows, "a int, b int", tx.ratio_label(F.col("a"), F.col("b"))) == [
        ("305 / 851 = 0.35840",), ("0 / 274 = 0.00000",), ("0 / 0 = 0.00000",), ("1 / 64 = 0.01562",)
    ]


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_exact_intervals(spark):
    cases = [(7, 20, 0.05), (0, 10, 0.05), (10, 10, 0.01), (3, 5, 0.01), (499, 500, 0.05), (250, 500, 0.01), (1, 400, 0.05)]
    cases += [(None, 20, 0.05), (123_456, 1_000_000, 0.05)]
    interval = exact_interval(F.col("k"), F.col("n"), F.col("a"))
    got = values(spark, cases, "k bigint, n bigint, a double", interval["lo"], interval["hi"])
    assert got[0] == pytest.approx((0.1539092, 0.5921885), abs=1e-7)
    assert got[1][0] == 0.0 and got[2][1] == 1.0 and got[7] == (None, None)
    for (k, n, a), (lo, hi) in zip(cases[:7], got):
        if k > 0:
            assert tail(k, n, lo) == pytest.approx(a / 2, abs=1e-9)
        if k < n:
            assert 1 - tail(k + 1, n, hi) == pytest.approx(a / 2, abs=1e-9)
    p, half = 0.123456, 1.96 * math.sqrt(0.123456 * (1 - 0.123456) / 1e6)
    assert got[8] == pytest.approx((p - half, p + half), abs=2e-6)


def test_seeded_draws_are_uniform(spark):
    row = spark.range(20000).select(tx.seeded_uniform(1, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u"), F.countDistinct("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and row[1] >= 0 and row[2] < 1 and row[3] == 20000
