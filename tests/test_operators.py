import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgauge.operators import (
    assess, bridge, clustering, corpora, filters, indexing, inference, kmeans, profiles, ratings, robustness, sweep, tree,
)
from skillgauge.plans import questions
from skillgauge.sources import documents as docs, logs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- logs --------------------------------------------------------------------------------------


def test_biased_orders(spark):
    log = spark.createDataFrame(
        [(1, 5, "correct_first"), (2, 5, None), (3, 0, "correct_last"), (4, None, "correct_first"), (5, 5, "random")],
        "id int, shots int, choices_order string",
    )
    assert [r[0] for r in rows(filters.drop_biased_orders(log).select("id"))] == [2, 3, 4, 5]
    assert filters.drop_biased_orders(log.drop("shots")).count() == 5


def make_log(spark, records):
    schema = (
        "evaluation_id string, model string, language string, dataset string, shots int, sample_index bigint, "
        "choices_order string, enumerator string, score double, raw_input string, closest_answer string"
    )
    return spark.createDataFrame(records, schema)


def test_low_performing_questions(spark):
    base = ("m", "en", "d", 0)
    log = make_log(
        spark,
        [
            ("e1", *base, 1, None, "x", 0.0, None, "A. a"),
            ("e2", *base, 1, None, "x", 0.0, "text two", "B. b"),
            ("e2", *base, 1, None, "y", 1.0, "later copy", "C. c"),
            ("e3", *base, 2, None, "x", 1.0, "good", "A. a"),
            ("e4", *base, None, None, "x", 0.0, "no key", "A. a"),
            ("e5", *base, 3, None, "x", None, None, None),
            ("e6", *base, 4, None, "x", 0.0, None, "E. e"),
        ],
    )
    got = rows(questions.low_performing_questions(log).select("sample_index", "average_score", "question").fillna("-"))
    assert got == [(1, 0.0, "text two"), (4, 0.0, "-")]
    answers = rows(questions.saved_answers(log, columns=["evaluation_id"]).select("evaluation_id", "chosen_position"))
    assert answers == [("e1", 1), ("e2", 2)]


def test_one_evaluation_holding_most_rows(spark):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("evaluation_id"), F.col("id").alias("score")
    )
    kept = robustness.dedup_first(hot, ["evaluation_id"], ["score"])
    plan = kept._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]
    assert kept.count() == 40_001
    assert kept.filter("evaluation_id = 'hot'").first()["score"] == 0
    assert robustness.dedup_first(hot.drop("evaluation_id"), ["evaluation_id"], ["score"]).count() == 60_000


def test_statuses(spark):
    base = ("m", "en")
    log = make_log(
        spark,
        [
            ("a", *base, "low", 0, 1, None, "x", 0.0, "q", "A. a"),
            ("b", *base, "high", 0, 1, None, "x", 1.0, "q", "A. a"),
            ("c", *base, "biased", 5, 1, "correct_first", "x", 1.0, "q", "A. a"),
            ("d", *base, "keyless", 0, None, None, "x", 1.0, "q", "A. a"),
            ("e", *base, "unmapped", 0, 1, None, "x", 0.0, "q", "E. a"),
        ],
    )
    grid = robustness.configurations(spark, ["m"], ["en"], [0, 5], ["low", "high", "biased", "keyless", "unmapped"]).filter(
        "(dataset = 'biased') = (shots = 5)"
    )
    status = robustness.configuration_status(log, grid, 0.5)
    mapped = robustness.answer_status(status, questions.low_performing_answers(log))
    assert dict(rows(mapped.select("dataset", "status"))) == {
        "low": "success", "high": "no_low_performers", "biased": "empty_after_filters",
        "keyless": "no_samples_after_grouping", "unmapped": "invalid_mappings",
    }


def test_missing_layout_is_empty(spark, tmp_path):
    assert logs.scan_layout(spark, str(tmp_path), "org/m", "en", 0, ["x.parquet"]).count() == 0
    folder = tmp_path / "m" / "en" / "0_shot" / "x.parquet"
    spark.createDataFrame([("e", "org/m")], "evaluation_id string, model string").write.parquet(str(folder))
    found = logs.scan_layout(spark, str(tmp_path), "org/m", "en", 0, ["x.parquet"])
    assert found.count() == 1 and "choices_order" in found.columns
    some = logs.scan_layout(spark, str(tmp_path), ["org/m", "org/absent"], benchmarks=["x", "gone"]).collect()
    assert [(r["language"], r["shots"], r["model_folder"], r["benchmark"]) for r in some] == [("en", 0, "m", "x")]


# ---- trees -------------------------------------------------------------------------------------


def stats_table(spark, nodes):
    return spark.createDataFrame([("t", *n) for n in nodes], "tree_id string, path array<int>, size bigint, lo double, hi double")


def test_extraction_stops_at_big_failing_children(spark):
    def extracted(child_size):
        stats = stats_table(
            spark,
            [([], 100, 0.1, 0.4), ([0], child_size, 0.3, 0.6), ([1], 60, 0.1, 0.3), ([1, 0], 30, 0.1, 0.3), ([0, 0], 6, 0.0, 0.4), ([2], 4, None, None)],
        )
        return sorted(list(r["path"]) for r in tree.extract_nodes(stats, 0.5).collect())

    assert extracted(25) == [[0, 0], [1]]
    assert extracted(19) == [[]]


def brute_sweep(nodes, direction="lower"):
    by_path = {tuple(p): (size, lo, hi) for p, size, lo, hi in nodes}
    top = [by_path[()]] + [v for p, v in by_path.items() if len(p) == 1 and v[0] >= 20]
    extreme = max(v[2] for v in top) if direction == "lower" else min(v[1] for v in top)
    step, out = 0, []
    while True:
        def passes(p):
            size, lo, hi = by_path[p]
            gap = (extreme - hi) if direction == "lower" else (lo - extreme)
            return hi is not None and step - 1 < gap / 1e-4

        able = {
            p for p in by_path
            if by_path[p][2] is not None and passes(p)
            and all(passes(c) for c in by_path if len(c) == len(p) + 1 and c[: len(p)] == p and by_path[c][0] >= 20)
        }
        taken = {p for p in able if not any(p[:i] in able for i in range(len(p)))}
        if not taken:
            return out
        out.append(taken)
        step += 1


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("direction", ["lower", "higher"])
def test_sweep_matches_brute_force(spark, seed, direction):
    rng = np.random.default_rng(seed)
    nodes = [([], 400, 0.30, 0.31)]
    for a in range(3):
        nodes.append(([a], int(rng.integers(5, 120)), *sorted(rng.uniform(0.25, 0.36, 2).tolist())))
        for b in range(3):
            size = int(rng.integers(3, 40))
            nodes.append(([a, b], size, *(sorted(rng.uniform(0.2, 0.4, 2).tolist()) if size >= 5 else (None, None))))
    expected = brute_sweep(nodes, direction)
    stats = stats_table(spark, nodes)
    ranges = sweep.step_ranges(stats, direction)
    descriptions = stats.select("tree_id", "path", tree.path_text(F.col("path")).alias("description"))
    got = {r["step"]: list(r["profile"]) for r in sweep.sweep_profiles(ranges, descriptions).collect()}
    current, named = None, [sorted("/".join(map(str, p)) for p in taken) for taken in expected]
    for step, profile in enumerate(named):
        current = got.get(step, current)
        assert current == profile
    assert max(got, default=-1) < len(expected)


def test_profiles_of_a_million_nodes_are_told_apart_without_lists(spark):
    n, last = 1_000_000, 1000
    node = spark.range(n).select(F.lit("t").alias("tree_id"), F.array(F.col("id").cast("int")).alias("path"), "id")
    after = F.when(F.col("id") == 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(last // 2)).cast("int") * 2 - 1)
    ranges = node.select("tree_id", "path", after.alias("after"), F.lit(last).alias("until"))
    descriptions = node.select("tree_id", "path", F.concat(F.lit("d"), (F.col("id") % 1000).cast("string")).alias("description"))
    steps = sweep.profile_steps(ranges, descriptions)
    assert steps.count() == sweep.profile_identities(steps).count() == last // 2
    assert steps.agg(F.max("profile_size"), F.max("last")).first() == (n, last)
    again = ranges.select("tree_id", "path", F.when(F.col("after") < 501, -1).otherwise(F.col("after")).alias("after"), "until")
    assert sweep.profile_steps(again, descriptions).filter("step = 1000 - 1").select("id_1", "id_2").collect() == steps.filter("step = 1000 - 1").select("id_1", "id_2").collect()


def test_equal_profiles_at_different_steps_have_one_identity(spark):
    ranges = spark.createDataFrame([("t", [0], -1, 9), ("t", [1], 2, 4), ("t", [2], 6, 7)], "tree_id string, path array<int>, after int, until int")
    descriptions = spark.createDataFrame([("t", [0], "a"), ("t", [1], "b"), ("t", [2], "b")], "tree_id string, path array<int>, description string")
    steps = sweep.profile_steps(ranges, descriptions)
    assert [(r["step"], r["last"], r["profile_size"]) for r in steps.orderBy("step").collect()] == [(0, 2, 1), (3, 4, 2), (5, 6, 1), (7, 7, 2), (8, 9, 1)]
    found = sweep.profile_identities(steps)
    assert sorted((r["profile_size"], r["step"], r["last"]) for r in found.collect()) == [(1, 0, 9), (2, 3, 7)]
    assert rows(sweep.distinct_profiles(ranges, descriptions).select("profile_index", "profile")) == [(0, "a"), (1, "a[###***###]b")]
    assert rows(sweep.profile_members(ranges, descriptions, found)) == [("t", 0, "a"), ("t", 3, "a"), ("t", 3, "b")]


def test_located_node_itself_is_not_tested(spark):
    ranges = spark.createDataFrame([("t", [0, 1], 5)], "tree_id string, path array<int>, qualifies_until int")
    paths = spark.createDataFrame([("t", [0, 1]), ("t", [0, 1, 2])], "tree_id string, path array<int>")
    assert [list(r["path"]) for r in sweep.extracted_until(paths, ranges).collect()] == [[0, 1, 2]]


def test_tree_documents(spark):
    text = '{"subtrees": {"3": {"subtrees": [5, 6, {"subtrees": 7, "input": "q"}], "description": "d"}, "4": 8}}'
    nodes = docs.parse_trees(spark.createDataFrame([("t", text)], "tree_id string, value string"))
    got = sorted((list(r["path"]), r["kind"], r["instance_id"] or 0, r["clustered"], r["description"] or "", r["input"] or "") for r in nodes.collect())
    assert got == [
        ([], "inner", 0, True, "", ""),
        ([3], "inner", 0, False, "d", ""),
        ([3], "leaf", 5, False, "", ""),
        ([3], "leaf", 6, False, "", ""),
        ([3, 2], "inner", 0, False, "", "q"),
        ([3, 2], "leaf", 7, False, "", ""),
        ([4], "leaf", 8, False, "", ""),
    ]
    leaves = docs.tree_leaves(nodes).withColumns({"wins": F.lit(1), "trials": F.lit(1)})
    assert rows(tree.roll_up(leaves).select(tree.path_text(F.col("path")), "size")) == [("", 4), ("3", 3), ("3/2", 1), ("4", 1)]


# ---- profiles ----------------------------------------------------------------------------------


def test_stored_overlap_report(spark):
    # Counts of a published report and the averages it gives.
    recall = [(4, 119), (21, 275), (79, 93), (0, 274), (6, 91), (61, 94), (42, 127), (40, 154), (220, 372), (10, 96)]
    precision = [(305, 851), (89, 143)]
    table = [(1, "recall", a / b) for a, b in recall] + [(1, "precision", a / b) for a, b in precision]
    report = assess.overlap_report(spark.createDataFrame(table, "profile_id int, side string, ratio double")).first()
    assert report["recall"] == pytest.approx(0.2960323120766632)
    assert report["precision"] == pytest.approx(0.4903897512593165)
    assert report["f1"] == pytest.approx(0.3691941481605517)


def test_published_means_and_errors(spark):
    # Published results of repeated runs, their mean and error.
    runs = [("sampled", v) for v in (51.4, 50.2, 52.1, 51.4, 53.3)] + [("single", 48.7)]
    got = {r["method"]: r for r in assess.mean_and_error(spark.createDataFrame(runs, "method string, value double"), ["method"]).collect()}
    assert (round(got["sampled"]["mean"], 2), round(got["sampled"]["stderr"], 2)) == (51.68, 0.45)
    assert got["single"]["stderr"] is None


def test_empty_sets_count_as_full_success(spark):
    profile = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (1, "a")], "profile_id int, capability string")
    association = spark.createDataFrame([("a", 1, "YES"), ("a", 2, "YES"), ("b", 1, "NO")], "capability string, instance_id int, label string")
    results = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "instance_id int, wins int, trials int")
    means = assess.profile_means(profile, assess.capability_performance(association, results))
    assert rows(means) == [(1, 3, pytest.approx(2 / 3)), (2, 1, 1.0)]
    assert rows(assess.union_performance(profile, association, results)) == [(1, 2, 0.5), (2, 0, 1.0)]


def test_balanced_assignment(spark):
    wanted = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.when(j <= 2, 5.0).otherwise((1 + (F.col("id") * j) % 3).cast("double")))
    scores = spark.range(3000).select(F.col("id").alias("instance_id"), wanted.alias("scores"))
    assigned = profiles.balanced_assignment(scores, 6)
    assert assigned.filter((F.size("assignment") != 2) | (F.size(F.array_distinct("assignment")) != 2)).count() == 0
    for row in profiles.assignment_report(assigned).collect():
        assert row["load"] == pytest.approx(row["target"], rel=0.101)


def test_balanced_assignment_of_few_instances(spark):
    rng = np.random.default_rng(6)
    scores = [(i, rng.integers(1, 6, 8).astype(float).tolist()) for i in range(41)]
    table = spark.createDataFrame(scores, "instance_id int, scores array<double>")
    assigned = {r["instance_id"]: r["assignment"] for r in profiles.balanced_assignment(table, 8).collect()}
    assert set(assigned) == set(range(41)) and all(len(set(a)) == 2 for a in assigned.values())
    mass = np.array([s for _, s in scores]).sum(0)
    for number, (least, most) in enumerate(profiles.load_bounds(mass.tolist(), 41), 1):
        assert least <= sum(number in a for a in assigned.values()) <= most
    gap = profiles.assignment_gap(table, 8).first()
    assert gap["value"] == sum(scores[i][1][number - 1] for i, a in assigned.items() for number in a)
    assert 0 <= gap["gap"] < 0.05


def test_loads_that_cannot_be_met_say_why():
    with pytest.raises(ValueError, match="capability 1"):
        profiles.load_bounds([1.0, 30.0, 30.0], 5)
    with pytest.raises(ValueError, match="add up to"):
        profiles.load_bounds([10.0] * 3, 2, tolerance=0.3)
    assert profiles.load_bounds([1.0, 1.0], 10) == [(9, 10), (9, 10)]


def test_ratings_of_two_to_one_odds(spark):
    battles = [("a", "b", "model_a")] * 2 + [("a", "b", "model_b")] + [("b", "a", "model_a")] + [("b", "a", "model_b")] * 2
    wins = ratings.pairwise_wins(spark.createDataFrame(battles, "model_a string, model_b string, winner string"))
    assert rows(wins) == [("a", "b", 8), ("b", "a", 4)]
    got = {r["model"]: r["rating"] for r in ratings.bradley_terry(wins).collect()}
    assert got["a"] - got["b"] == pytest.approx(120.41, abs=0.01)
    assert got["a"] + got["b"] == pytest.approx(2000)
    anchored = {r["model"]: r["rating"] for r in ratings.bradley_terry(wins, ("b", 1114.0)).collect()}
    assert anchored["b"] == pytest.approx(1114.0)


def fitted_by_hand(weights, n):
    """Strengths of n models by plain minorise-maximise steps over a matrix of wins."""
    w = np.zeros((n, n))
    for (a, b), x in weights.items():
        w[a, b] += x
    p = np.ones(n)
    for _ in range(20_000):
        p = w.sum(1) / ((w + w.T) / (p[:, None] + p[None, :])).sum(1)
        p /= np.exp(np.log(p).mean())
    return 400 * np.log10(p) + 1000


def test_ratings_equal_plain_steps(spark):
    rng = np.random.default_rng(8)
    weights = {(a, b): int(rng.integers(1, 30)) for a in range(12) for b in range(12) if a != b and (abs(a - b) in (1, 11) or rng.random() < 0.1)}
    wins = spark.createDataFrame([(f"m{a:02d}", f"m{b:02d}", x) for (a, b), x in weights.items()], "model_a string, model_b string, weight int")
    wanted = fitted_by_hand(weights, 12).tolist()
    got = [r["rating"] for r in ratings.bradley_terry(wins).orderBy("model").collect()]
    assert got == pytest.approx(wanted, abs=0.01)
    dense = wins.filter("model_a < 'm05' AND model_b < 'm05'").unionByName(spark.createDataFrame([(f"m0{a}", f"m0{b}", 3) for a in range(5) for b in range(5) if a != b], wins.schema))
    alone, tables = ({r["model"]: r["rating"] for r in ratings.bradley_terry(dense, task_pairs=n).collect()} for n in (100, 0))
    assert tables == pytest.approx(alone, abs=0.01)


def test_unconnected_models_are_rated_apart(spark):
    pairs = [("a", "b", 2), ("b", "a", 1), ("c", "d", 1), ("d", "c", 4)]
    wins = spark.createDataFrame(pairs, "model_a string, model_b string, weight int")
    assert rows(ratings.comparable_groups(wins)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    got = {r["model"]: r["rating"] for r in ratings.bradley_terry(wins, ("a", 900.0)).collect()}
    assert got["a"] == pytest.approx(900) and got["a"] - got["b"] == pytest.approx(120.41, abs=0.01)
    assert got["c"] + got["d"] == pytest.approx(2000) and got["d"] - got["c"] == pytest.approx(240.82, abs=0.01)


def test_a_model_that_never_lost_has_no_rating(spark):
    wins = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "b", 1)], "model_a string, model_b string, weight int")
    with pytest.raises(ValueError, match="never lost or never won: a"):
        ratings.bradley_terry(wins)


def test_many_models(spark):
    n = 20_000
    near = spark.range(n).select(F.col("id").alias("a"), F.explode(F.array(*[F.lit(d) for d in (1, 7, 61, 997, 5003)])).alias("d"))
    pairs = near.select(F.col("a").cast("string").alias("model_a"), ((F.col("a") + F.col("d")) % n).cast("string").alias("model_b"), (1 + F.pmod(F.xxhash64("a", "d"), F.lit(3))).alias("weight"))
    wins = pairs.unionByName(pairs.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (F.col("weight") % 2 + 2).alias("weight")))
    rated = ratings.bradley_terry(wins, digits=1)
    assert rated.count() == n and rated.agg(F.avg("rating")).first()[0] == pytest.approx(1000)


def test_pairs_need_every_tally(spark):
    battles = [("a", "b", "model_a"), ("b", "a", "model_b"), ("b", "a", "model_a"), ("a", "b", "model_b"), ("a", "c", "model_a")]
    wins = ratings.pairwise_wins(spark.createDataFrame(battles, "model_a string, model_b string, winner string"))
    assert rows(wins) == [("a", "b", 4), ("b", "a", 4)]


def test_first_place_decides_a_question_score(spark):
    catalogue = spark.createDataFrame([(0, 0, "1", " q "), (0, 1, "2", "q"), (1, 0, "3", "r")], "s int, p int, idx string, question string")
    scores = spark.createDataFrame([("2", 0.5), ("3", 0.25)], "idx string, score double")
    asked = spark.createDataFrame([("\tq\n",), ("r",), ("x",)], "question string")
    assert rows(bridge.lookup_scores(asked, catalogue, scores, ["s", "p"])) == [("\tq\n", -1.0), ("r", 0.25), ("x", -1.0)]


# ---- corpora -----------------------------------------------------------------------------------


def test_last_id_owns_a_first_message(spark):
    talks = spark.createDataFrame([(1, "A "), (2, "a"), (3, "b")], "conv_id int, text_0 string")
    assert [r["conv_id"] for r in corpora.dedup_first_messages(talks, "conv_id", "conv_id").orderBy("conv_id").collect()] == [2, 3]


def test_missing_output_is_an_error(spark):
    inputs = spark.createDataFrame([("x",), ("y",)], "input string")
    outputs = spark.createDataFrame([("x", "1")], "input string, output string")
    with pytest.raises(ValueError):
        corpora.lookup_outputs(inputs, outputs)
    assert corpora.lookup_outputs(inputs, outputs, strict=False).count() == 1


def test_global_index_is_dense(spark):
    indexed = indexing.shuffled_index(spark.range(5000), 1, "id")
    assert sorted(r["index"] for r in indexed.collect()) == list(range(5000))


# ---- model calls -------------------------------------------------------------------------------


def test_failing_rows_are_marked(spark):
    def provider(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [{"response": t.upper(), "prompt_tokens": 1, "completion_tokens": 2} for t in texts]

    prompts = spark.createDataFrame([(i, "bad" if i % 7 == 0 else f"t{i}") for i in range(50)], "id int, prompt string")
    got = {r["id"]: r for r in inference.complete(prompts, provider).collect()}
    assert len(got) == 50
    assert all(r["failed"] == (i % 7 == 0) and r["response"] == (None if i % 7 == 0 else f"T{i}") for i, r in got.items())


def test_descriptions_bottom_up(spark):
    leaves = [("t", [0], 1, "one"), ("t", [0], 2, "two"), ("t", [1, 0], 3, "three"), ("t", [1, 0], 4, "four"), ("t", [1], 5, "five")]
    table = spark.createDataFrame(leaves, "tree_id string, path array<int>, instance_id bigint, text string")

    def provider(texts):
        return [{"response": f" <{x}> "} for x in texts]

    got = {tuple(r["path"]): r["description"] for r in inference.describe_nodes(table, "{group_number}:{skill_descriptions}", provider).collect()}

    def text(members):
        order = sorted(members, key=lambda m: (hashlib.md5(f"42:{m[0]}".encode()).hexdigest(), m[0]))
        listing = "\n".join(f"### Skill #{i + 1}\n{m[1]}\n" for i, m in enumerate(order))
        return f"<{len(order)}:{listing}>"

    low = text([("3", "three"), ("4", "four")])
    left, right = text([("1", "one"), ("2", "two")]), text([("node 0", low), ("5", "five")])
    assert got == {(1, 0): low, (0,): left, (1,): right, (): text([("node 0", left), ("node 1", right)])}


def test_shrinking_capabilities(spark):
    table = spark.createDataFrame([(i, f"c{i}") for i in range(23)], "index bigint, capability string")

    def provider(texts):
        return [{"response": "\n".join(line.strip() for line in x.split("\n")[:4]) + "\n \n"} for x in texts]

    first = inference.shrink_round(table, "{capability_list}", provider, wanted=2, factor=5)
    assert [r["capability"] for r in first.orderBy("index").collect()] == ["(1) c0", "(2) c1", "(1) c10", "(2) c11", "(1) c20", "(2) c21"]
    final = inference.shrink_capabilities(table, "{capability_list}", provider, wanted=2, factor=5)
    assert final.count() == 2


def test_cache_is_filled_once(spark):
    caps = spark.createDataFrame([("a",), ("b",)], "capability string")
    instances = spark.createDataFrame([(1, "i", "o"), (2, "i", "o")], "instance_id int, input string, output string")
    cache = spark.createDataFrame([("a", 1, "NO"), ("a", 2, None), ("z", 1, "YES")], "capability string, instance_id int, label string")
    filled = inference.annotate(caps, instances, cache, "{capability}{input}{output}", lambda xs: [{"response": "YES"} for _ in xs])
    assert rows(filled) == [("a", 1, "NO"), ("a", 2, "YES"), ("b", 1, "YES"), ("b", 2, "YES"), ("z", 1, "YES")]


# ---- clustering --------------------------------------------------------------------------------


def silhouette(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    scores = []
    for i, own in enumerate(labels):
        same = [j for j in range(len(x)) if labels[j] == own and j != i]
        if not same:
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, [j for j in range(len(x)) if labels[j] == other]].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def blobs(spark, n=90):
    rng = np.random.default_rng(0)
    centers = np.eye(6)[[0, 2, 4]] * 4
    points = [centers[i % 3] + rng.normal(0, 0.15, 6) for i in range(n)]
    return np.array(points), spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "instance_id bigint, embedding array<float>")


def test_silhouette_matches_definition(spark):
    points, vectors = blobs(spark)
    labels = [i % 5 if i != 7 else 9 for i in range(len(points))]
    table = vectors.withColumn("label", F.when(F.col("instance_id") == 7, 9).otherwise(F.col("instance_id") % 5))
    got = clustering.cosine_silhouette(table).first()["silhouette"]
    assert got == pytest.approx(silhouette(points.astype(np.float32).astype(float), labels), abs=1e-9)


def tree_rows(tree):
    leaves, centroids = tree
    return rows(leaves), sorted((tuple(r["path"]), r["cluster"], tuple(round(x, 6) for x in r["centroid"])) for r in centroids.collect())


@pytest.mark.parametrize("partitions, options", [(3, {}), (17, {}), (3, {"task_bytes": 1000, "block_bytes": 500})])
def test_clustering_partitions_instances(spark, partitions, options):
    points, vectors = blobs(spark)
    leaves, centroids = clustering.build_tree(vectors.repartition(partitions), **options)
    placed = leaves.collect()
    assert sorted(r["instance_id"] for r in placed) == list(range(len(points)))
    top = {}
    for r in placed:
        top.setdefault(r["path"][0], set()).add(r["instance_id"] % 3)
    assert sorted(map(tuple, top.values())) == [(0,), (1,), (2,)]
    located = {r["instance_id"]: list(r["path"]) for r in clustering.locate(vectors, centroids, "tree").collect()}
    assert located == {r["instance_id"]: list(r["path"]) for r in placed}


def test_one_task_and_many_blocks_give_the_same_tree(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (70, 5)).round(3).tolist()
    points += [points[0]] * 4 + [[0.0] * 5] * 3
    vectors = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "instance_id bigint, embedding array<float>")
    whole = tree_rows(clustering.build_tree(vectors.repartition(2)))
    spread = tree_rows(clustering.build_tree(vectors.repartition(7), task_bytes=900, block_bytes=300))
    assert whole == spread


def test_clustering_runs_until_fits_settle(spark):
    # Evenly spread points on a curve: steps from any starts are many and small.
    points = np.array([[np.cos(i / 150), np.sin(i / 150), 0.0] for i in range(400)]).astype(np.float32).astype(float)
    draws = np.random.default_rng(1).random((400, 10))
    first = kmeans.starts(points, np.arange(400), draws, 6)
    enough = kmeans.tolerance(400, points.sum(0), (points * points).sum(0))
    assert enough == pytest.approx(kmeans.TOLERANCE * points.var(axis=0).mean())
    for k in range(2, 7):
        centres = kmeans.fit(points, points[first[:k]], enough, 300)
        own = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        assert sum(((points[own == c].mean(axis=0) - centres[c]) ** 2).sum() for c in range(k)) <= 2 * enough
    with pytest.raises(RuntimeError, match="not settled"):
        kmeans.fit(points, points[first], enough, 1)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "instance_id bigint, embedding array<float>")
    with pytest.raises(RuntimeError, match="not settled"):
        clustering.build_tree(vectors, max_children=6, steps=1, task_bytes=100)


def test_clustering_starts_are_different_rows():
    # All but three rows are equal: starts by hash alone nearly always fall on one point.
    points = np.array([[1.0, 0.0]] * 97 + [[0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])
    draws = np.random.default_rng(2).random((100, 10))
    first = kmeans.starts(points, np.arange(100), draws, 9)
    assert len({tuple(points[i]) for i in first}) == len(first) == 4


def test_cosine_scores_match_definition():
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (40, 3))
    labels = np.array([i % 4 if i != 7 else 4 for i in range(40)])
    unit = kmeans.units(points)
    scores = kmeans.cosine_scores(unit, labels, *kmeans.cluster_sums(unit, labels, 5))
    assert scores.mean() == pytest.approx(silhouette(points, labels.tolist()))


def test_empty_table_has_an_empty_tree(spark):
    leaves, centroids = clustering.build_tree(spark.createDataFrame([], "instance_id bigint, embedding array<float>"))
    assert leaves.count() == centroids.count() == 0



def test_broken_files_are_named_and_the_rest_is_read(spark, tmp_path):
    base, schema = str(tmp_path / "log"), "evaluation_id string, score double"
    spark.createDataFrame([("e1", 1.0)], schema).write.parquet(f"{base}/m/en/0_shot/good.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{base}/m/en/0_shot/none.parquet")
    spark.createDataFrame([("PAR1 but no table",)], "x string").write.text(f"{base}/m/en/5_shot/odd[1].parquet")
    kind = spark.createDataFrame([], schema).schema
    found = logs.broken_files(spark, base, schema=kind).drop("file").collect()
    assert [tuple(r) for r in found] == [("m", "en", 5, "odd[1]", "no table file")]
    log = logs.scan_layout(spark, base, schema=kind, skip_broken=True)
    assert rows(log.select("evaluation_id", "benchmark")) == [("e1", "good")]
    assert logs.broken_files(spark, f"{base}/nowhere", schema=kind).count() == 0


def test_rows_that_were_not_saved_are_a_save_error(spark):
    schema = "model string, language string, dataset string, shots int"
    wanted = spark.createDataFrame([("m", "en", "d", 0)] * 2 + [("m", "en", "e", 0)], schema)
    saved = spark.createDataFrame([("m", "en", "d", 0), ("m", "en", "e", 0)], schema)
    assert rows(robustness.save_status(wanted, saved)) == [("m", "en", "d", 0, "save_error")]


@pytest.mark.parametrize("n, merge", [(1, 0), (137, 0), (500, 3), (999, 40), (1000, 0), (1200, 0), (40, 2000)])
def test_large_samples_are_cut_by_hash_prefixes(spark, n, merge):
    table = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    wanted = [r["id"] for r in table.orderBy(F.md5(F.concat_ws(":", F.lit("5"), F.col("id").cast("string"))), "id").limit(n).collect()]
    assert [r["id"] for r in indexing.sample_rows(table, n, 5, "id", merge=merge).collect()] == wanted
    equal = spark.range(300).select(F.lit(1).alias("k"))
    assert indexing.sample_rows(equal, min(n, 300), 5, "k", merge=merge).count() == min(n, 300)


def test_open_prompts_are_asked_again_until_answered(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fails_twice(texts):
        if len(texts) > 1:
            raise RuntimeError("one at a time")
        [text] = texts
        seen = len(list(calls.glob(f"{text}-*")))
        (calls / f"{text}-{seen}").touch()
        if seen < 2:
            raise RuntimeError(f"busy {seen}")
        return [{"response": text.upper(), "prompt_tokens": 1, "completion_tokens": 2}]

    prompts = spark.createDataFrame([(i, None if i == 7 else f"p{i % 5}", "e") for i in range(20)], "i int, prompt string, note string")
    two = inference.complete_all(prompts, fails_twice, str(tmp_path / "ledger"), rounds=2, wait=0.0)
    assert {(r["failed"], r["error"]) for r in two.filter("i <> 7").collect()} == {(True, "RuntimeError: busy 1")}
    done = inference.complete_all(prompts, fails_twice, str(tmp_path / "ledger"), wait=0.0).orderBy("i").collect()
    assert [r["response"] for r in done] == [None if i == 7 else f"P{i % 5}" for i in range(20)]
    assert not any(r["failed"] for r in done) and not any(r["error"] for r in done)
    again = inference.complete_all(prompts, fails_twice, str(tmp_path / "ledger"), wait=0.0)
    assert again.count() == 20 and len(list(calls.iterdir())) == 15


def test_no_prompts(spark, tmp_path):
    empty = spark.createDataFrame([], "prompt string")
    assert inference.complete_all(empty, len, str(tmp_path / "none")).count() == 0


def test_a_corpus_can_be_sampled_before_and_after(spark):
    turns = [(i, 2, "user", "assistant", f"question {i % 40}", "answer", "English", "English") for i in range(60)]
    table = spark.createDataFrame(turns, "conv_id int, turns int, role_0 string, role_1 string, text_0 string, text_1 string, language_0 string, language_1 string")
    first = {r["conv_id"] for r in indexing.sample_rows(table.select("conv_id"), 30, 42, "conv_id").collect()}
    got = {r["conv_id"] for r in corpora.instruction_corpus(table, "conv_id", "language", size=10, sample_first=30).collect()}
    assert len(got) == 10 and got <= {max(i for i in first if i % 40 == k % 40) for k in first}
