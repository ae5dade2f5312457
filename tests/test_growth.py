"""Steps that must not grow faster than their input."""

import inspect
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks import log_checks, registry
from skillgauge.operators import assess, clustering, inference, kmeans, tree
from skillgauge.sources import logs


def small_log(spark):
    return spark.range(40).select(
        F.when(F.col("id") % 2 == 0, "org/a").otherwise("org/b").alias("model"), F.lit("en").alias("language"), F.lit("d").alias("dataset"),
        F.when(F.col("id") % 4 < 2, 0).otherwise(5).alias("shots"), "id",
    )


def test_a_log_is_made_once_however_many_files_it_is_laid_out_in(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    log = small_log(spark)
    base = log_checks.laid_out(SimpleNamespace(spark=spark, eval_log=lambda: log.mapInArrow(counted, log.schema)), ["org/a", "org/b"], [0, 5])
    assert made.value == 40
    back = logs.scan_layout(spark, base, schema=log.drop("language").schema)
    assert sorted(r["id"] for r in back.collect()) == list(range(40))


def test_a_path_is_taken_apart_once_per_file(spark, tmp_path):
    log = small_log(spark).drop("language")
    log.write.parquet(f"{tmp_path}/a+b/en/5_shot/d.parquet")
    back = logs.scan_layout(spark, str(tmp_path), schema=log.schema)
    assert "regexp" not in back._jdf.queryExecution().executedPlan().toString().lower()
    assert {tuple(r) for r in back.select("model_folder", "language", "shots", "benchmark").collect()} == {("a+b", "en", 5, "d")}


def test_lists_of_profiles_are_not_shuffled(spark):
    pairs = spark.createDataFrame([("x", 1), ("y", 1), ("x", 2), ("z", 3)], "capability string, instance_id int").withColumn("label", F.lit("YES"))
    profiles = spark.createDataFrame([(7, "x"), (7, "y"), (8, "y"), (None, "z")], "profile_id int, capability string")
    numbered = assess._numbered(profiles, ["profile_id"])
    plan = assess._profiles_of_instances(assess.associated(pairs), profiles, numbered, ["profile_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan
    members = assess.profile_members(profiles, pairs)
    assert {tuple(r) for r in members.collect()} == {(7, 1), (7, 2), (8, 1), (None, 3)} and members.count() == 4


def test_overlap_counts_by_number(spark):
    pairs = spark.createDataFrame([("x", 1), ("y", 1), ("x", 2), ("z", 3)], "capability string, instance_id int").withColumn("label", F.lit("YES"))
    profiles = spark.createDataFrame([(7, "y"), (8, "z")], "profile_id int, capability string")
    found = assess.overlap(spark.createDataFrame([("x",)], "capability string"), profiles, pairs)
    assert {tuple(r) for r in found.select("profile_id", "side", "capability", "part", "whole").collect()} == {
        (7, "recall", "x", 1, 2), (8, "recall", "x", 0, 2), (7, "precision", "y", 1, 1), (8, "precision", "z", 0, 1)
    }


def test_a_mean_score_does_not_depend_on_the_order_of_additions(spark):
    leaves = spark.range(10).select(F.lit("t").alias("tree_id"), F.array(F.lit(1)).alias("path"), F.lit(0.1).alias("score")).coalesce(1)
    assert [r["mean_score"] for r in tree.roll_up_scores(leaves).collect()] == [0.1, 0.1]
    odd = leaves.withColumn("score", F.lit(1e300))
    assert all(abs(r["mean_score"] / 1e300 - 1) < 1e-9 for r in tree.roll_up_scores(odd).collect())


def test_calls_hold_slices_of_bounded_size():
    batch = pa.RecordBatch.from_pydict({"prompt": ["x" * 1000] * 20_000})
    sizes = [len(part) for part in inference._slices(batch)]
    assert sum(sizes) == 20_000 and max(sizes) * 1000 <= inference.CALL_BYTES


def test_unusable_labels_are_replaced_where_they_are_asked_for(spark):
    cache = spark.createDataFrame([("a", 1, "YES"), ("a", 2, "maybe"), ("b", 1, None), ("c", 1, "maybe")], "capability string, instance_id int, label string")
    instances = spark.createDataFrame([(1, "i", "o"), (2, "i", "o")], "instance_id int, input string, output string")
    found = inference.annotate(spark.createDataFrame([("a",), ("b",)], "capability string"), instances, cache, "{capability}", lambda texts: [{"response": "NO"} for _ in texts])
    assert {tuple(r) for r in found.collect()} == {("a", 1, "YES"), ("a", 2, "NO"), ("b", 1, "NO"), ("b", 2, "NO"), ("c", 1, "maybe")}


def test_equal_answers_are_counted_before_their_choices_are_joined(spark):
    plan = registry.queries()["h2_choice_position"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join", 1)[1]


def test_slow_fits_go_on_until_they_settle(monkeypatch):
    # All starts at one end of a line: some counts take more than 300 steps, as random vectors do from 60,000 rows on.
    line = np.c_[np.arange(2000) / 2000, np.zeros((2000, 63))]
    taken = []
    moved = kmeans.moved
    monkeypatch.setattr(kmeans, "starts", lambda x, ids, draws, most: list(range(most)))
    monkeypatch.setattr(kmeans, "moved", lambda centroids, *sums: taken.append(len(centroids)) or moved(centroids, *sums))
    steps = inspect.signature(clustering.build_tree).parameters["steps"].default
    labels, centroids = kmeans.split(line, np.arange(2000), np.ones((2000, 1)), 24, steps)
    assert max(map(taken.count, set(taken))) > 300
    assert (np.bincount(labels) > 0).all() and len(centroids) == labels.max() + 1


def test_a_fit_that_goes_in_a_circle_has_settled():
    fit = kmeans.Fit(np.array([[0.0], [9.0]]), 0.0)
    there, back = (np.array([1, 1]), np.array([[1.0], [8.0]])), (np.array([1, 1]), np.array([[2.0], [7.0]]))
    while not fit.settled:
        fit.step(*(back if fit.steps % 2 else there))
    assert fit.steps < 10


def test_nodes_split_in_waves_give_the_same_tree(spark, monkeypatch):
    points = np.random.default_rng(6).normal(0, 1, (60, 4)).round(3).tolist()
    vectors = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "instance_id bigint, embedding array<float>")

    def found(**options):
        leaves, centroids = clustering.build_tree(vectors, max_children=4, **options)
        return sorted(map(str, leaves.collect())), sorted(map(str, centroids.drop("centroid").collect()))

    whole = found()
    monkeypatch.setattr(clustering, "FIT_BYTES", 600)
    blocks = clustering._blocks_of(vectors.withColumn("draws", F.array(F.lit(0.5))), "tree", 300)
    halves = blocks.unionByName(blocks.withColumn("path", F.array(F.lit(1)))).unionByName(blocks.withColumn("path", F.array(F.lit(2))))
    assert [wave.select("path").distinct().count() for wave in clustering._waves(halves, 4)] == [2, 1]
    assert found(task_bytes=320, block_bytes=160) == whole


def test_a_plan_of_located_rows_grows_with_the_depth_alone(spark):
    # A chain: at each depth, cluster 1 holds one point and cluster 0 the rest.
    depth = 11
    rows = [("tree", [0] * d, c, [float(d) if c else d + 10.0]) for d in range(depth) for c in (0, 1)]
    centroids = spark.createDataFrame(rows, "tree_id string, path array<int>, cluster int, centroid array<double>")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "instance_id bigint, embedding array<double>")
    found = clustering.locate(vectors, centroids, "tree")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= depth
    expected = {}
    for i in range(12):
        path = []
        for d in range(depth):
            path.append(min((0, 1), key=lambda c: (abs(i - rows[2 * d + c][3][0]), c)))
            if path[-1]:
                break
        expected[i] = path
    assert {r["instance_id"]: list(r["path"]) for r in found.collect()} == expected and len(set(map(len, expected.values()))) > 3
