"""Queries over capability trees: C4-C6, D8-D10, D25, H7, I3-I7, E5, E9, G5, G6."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.functions.metrics import significant
from skillgauge.operators import sweep, tree
from skillgauge.plans import weaknesses

def path():
    return tree.path_text(F.col("path")).alias("path")


def statistics(t, alpha=0.05):
    return tree.node_statistics(t.accuracy(), [alpha])


@check("c4_leaf_metrics", "SELECT instance_id, concat(l1, '/', l2, '/', l3) AS path, acc AS wins, 1 AS trials FROM tree_leaf")
def _(t):
    leaves = t.leaves().select("tree_id", "instance_id", "path")
    return tree.leaf_metrics(leaves, t.accuracy().select("instance_id", "wins", "trials")).select(
        "instance_id", path(), "wins", "trials"
    )


@check("d8_tree_roll_up", "SELECT path, depth, size, acc AS sum_metrics FROM tree_node")
def _(t):
    return tree.roll_up(t.accuracy()).select(path(), "depth", "size", "sum_metrics")


@check("d9_win_rate_roll_up", "SELECT path, size, pref AS sum_metrics, size * 2 AS trials FROM tree_node")
def _(t):
    return tree.roll_up(t.win_rate()).select(path(), "size", "sum_metrics", "trials")


@check("d10_exact_interval", "SELECT path, size, v.alpha, round(lo, 6) AS lo, round(hi, 6) AS hi FROM tree_node CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) v(alpha) LEFT JOIN bound ON k = acc AND n = size AND bound.alpha = v.alpha AND size >= 5")
def _(t):
    return tree.with_intervals(tree.roll_up(t.accuracy())).select(
        path(), "size", "alpha", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")
    )


@check("d25_robustness_tree", """
WITH s AS (SELECT l1, l2, l3, c_acctbal AS score FROM tree_leaf JOIN customer ON c_custkey = instance_id WHERE instance_id % 10 <> 0)
SELECT CASE WHEN GROUPING(l1) = 1 THEN '' WHEN GROUPING(l2) = 1 THEN concat(l1) WHEN GROUPING(l3) = 1 THEN concat(l1, '/', l2) ELSE concat(l1, '/', l2, '/', l3) END AS path,
  count(*) AS size, round(avg(score), 4) AS mean_score FROM s GROUP BY ROLLUP (l1, l2, l3)""")
def _(t):
    scores = t.raw("customer").select(
        F.col("c_custkey").alias("instance_id"),
        F.when(F.col("c_custkey") % 10 == 0, -1.0).otherwise(F.col("c_acctbal")).alias("score"),
    )
    return tree.roll_up_scores(t.leaves().join(scores, "instance_id")).select(
        path(), "size", F.round("mean_score", 4).alias("mean_score")
    )


@check("h7_significance", "SELECT path, coalesce(hi < 0.5, false) AS weak, coalesce(lo > 0.4, false) AS strong FROM acc_stat")
def _(t):
    lo, hi = F.col("lo"), F.col("hi")
    return statistics(t).filter("size >= 5").select(
        path(),
        F.coalesce(significant(lo, hi, 0.5, "lower"), F.lit(False)).alias("weak"),
        F.coalesce(significant(lo, hi, 0.4, "higher"), F.lit(False)).alias("strong"),
    )


@check("i3_node_statistics", "SELECT path, depth, size, pref AS sum_metrics, v.alpha, round(lo, 6) AS lo, round(hi, 6) AS hi FROM tree_node CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) v(alpha) LEFT JOIN bound ON k = pref AND n = size * 2 AND bound.alpha = v.alpha AND size >= 5")
def _(t):
    return tree.node_statistics(t.win_rate()).select(
        path(), "depth", "size", "sum_metrics", "alpha", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")
    )


# One fixed threshold, tried without the sweep.
EXTRACTED = """
able AS (SELECT path, size FROM acc_stat p WHERE {passes} AND NOT EXISTS (SELECT 1 FROM acc_stat c WHERE c.depth > 0 AND c.up = p.path AND c.size >= 20 AND NOT ({child}))),
taken AS (SELECT * FROM able a WHERE NOT EXISTS (SELECT 1 FROM able b WHERE a.path <> b.path AND (b.path = '' OR starts_with(a.path, concat(b.path, '/')))))"""
WEAK = EXTRACTED.format(passes="hi < 0.5", child="c.hi < 0.5")
STRONG = EXTRACTED.format(passes="lo > 0.4", child="c.lo > 0.4")


@check("i4_extract_weak_nodes", f"WITH {WEAK} SELECT path, size FROM taken")
def _(t):
    return tree.extract_nodes(statistics(t), 0.5).select(path(), "size")


@check("i4_extract_strong_nodes", f"WITH {STRONG} SELECT path, size FROM taken")
def _(t):
    return tree.extract_nodes(statistics(t), 0.4, "higher").select(path(), "size")


@check("c5_result_descriptions", "SELECT path, size, acc AS sum_metrics, concat('skill ', path) AS description FROM tree_node")
def _(t):
    return tree.with_descriptions(tree.roll_up(t.accuracy()), t.descriptions()).select(
        path(), "size", "sum_metrics", "description"
    )


@check("c6_instances_on_path", f"WITH {WEAK} SELECT instance_id, l.path AS end_path, k.path AS path FROM located l JOIN taken k ON k.path = '' OR starts_with(l.path, concat(k.path, '/'))")
def _(t):
    nodes = tree.extract_nodes(statistics(t), 0.5).select(*tree.NODE)
    return tree.instances_on_path(t.located(), nodes).select(
        "instance_id", tree.path_text(F.col("end_path")).alias("end_path"), path()
    )


@check("i5_weakness_profile", f"WITH {WEAK} SELECT concat('skill ', k.path) AS capability, k.size, instance_id FROM taken k JOIN tree_leaf ON k.path = '' OR starts_with(concat(l1, '/', l2, '/', l3, '/'), concat(k.path, '/'))")
def _(t):
    return tree.weakness_profile(statistics(t), t.descriptions(), t.leaves(), 0.5).select(
        "capability", "size", "instance_id"
    )


def ranges(t, direction="lower"):
    return sweep.step_ranges(statistics(t), direction)


@check("i6_step_ranges", "SELECT path, size, min(step) - 1 AS after, max(step) AS until FROM extracted_low GROUP BY ALL")
def _(t):
    return ranges(t).filter("until > after").select(
        path(), "size", F.col("after").cast("bigint").alias("after"), F.col("until").cast("bigint").alias("until")
    )


@check("i6_profile_changes", "SELECT step, profile_size, array_to_string(profile, ';') AS profile FROM (SELECT *, lag(profile) OVER (ORDER BY step) AS before FROM low_profile) WHERE before IS DISTINCT FROM profile")
def _(t):
    profiles = sweep.sweep_profiles(ranges(t), t.descriptions())
    return profiles.select(
        F.col("step").cast("bigint").alias("step"), "profile_size", F.array_join("profile", ";").alias("profile")
    )


@check("g5_distinct_profiles", "SELECT row_number() OVER (ORDER BY profile) - 1 AS profile_index, profile_size, profile FROM (SELECT DISTINCT profile_size, array_to_string(profile, '[###***###]') AS profile FROM low_profile)")
def _(t):
    profiles = sweep.distinct_profiles(ranges(t), t.descriptions())
    return profiles.select(F.col("profile_index").cast("bigint").alias("profile_index"), "profile_size", "profile")


@check("g5_profile_identities", "SELECT min(step)::BIGINT AS first_step, max(step)::BIGINT AS last_step, profile_size FROM low_profile GROUP BY profile, profile_size")
def _(t):
    found = sweep.profile_identities(sweep.profile_steps(ranges(t), t.descriptions()))
    return found.select(F.col("step").cast("bigint").alias("first_step"), F.col("last").cast("bigint").alias("last_step"), "profile_size")


@check("i6_profile_members", "SELECT step::BIGINT AS step, unnest(profile) AS description FROM (SELECT *, lag(profile) OVER (ORDER BY step) AS before FROM low_profile) WHERE before IS DISTINCT FROM profile")
def _(t):
    """The members of every profile of the sweep, a row each."""
    found = ranges(t)
    steps = sweep.profile_steps(found, t.descriptions())
    return sweep.profile_members(found, t.descriptions(), steps).select(F.col("step").cast("bigint").alias("step"), "description")


@check("l2_weakness_profiles", "SELECT profile_size, unnest(arg_max(profile, step)) AS capability FROM low_profile WHERE profile_size <= 20 GROUP BY profile_size")
def _(t):
    """From placed instances and their results to the profiles of all sizes, in one plan."""
    measured = t.accuracy().select("instance_id", "wins", "trials")
    found = weaknesses.weakness_profiles(t.leaves().select("tree_id", "instance_id", "path"), measured, t.descriptions(), 20)
    return found.select("profile_size", "capability")


@check("g6_profile_per_size", "SELECT profile_size, array_to_string(arg_max(profile, step), ';') AS profile FROM low_profile WHERE profile_size <= 20 GROUP BY profile_size")
def _(t):
    profiles = sweep.profile_per_size(sweep.sweep_profiles(ranges(t), t.descriptions(), 20), 20)
    return profiles.select("profile_size", F.array_join("profile", ";").alias("profile"))


def performance_sql(side, extreme, sign):
    return f"""
WITH counted AS (SELECT step, count(*) AS instances, avg(result) AS performance FROM
  (SELECT DISTINCT e.step, l.instance_id, l.result FROM located l JOIN extracted_{side} e ON e.path = '' OR starts_with(l.path, concat(e.path, '/'))) GROUP BY step),
start AS (SELECT {extreme} AS extreme FROM acc_stat WHERE depth = 0 OR (depth = 1 AND size >= 20))
SELECT step, round(extreme {sign} 0.0001::DOUBLE * (step - 1), 6) AS threshold, instances, round(performance, 9) AS performance FROM counted, start"""


@check("i7_weak_performance", performance_sql("low", "max(hi)", "-"))
def _(t):
    return performance(t, "lower")


@check("i7_strong_performance", performance_sql("high", "min(lo)", "+"))
def _(t):
    return performance(t, "higher")


def performance(t, direction):
    located = t.located()
    table = sweep.sweep_performance(located.drop("result"), ranges(t, direction), located, direction)
    return table.select(
        F.col("step").cast("bigint").alias("step"),
        F.round("threshold", 6).alias("threshold"),
        "instances",
        F.round("performance", 9).alias("performance"),
    )


@check("e5_persistence", "SELECT o_orderkey, min(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS extracted FROM orders")
def _(t):
    flags = t.raw("orders").select(
        "o_orderkey", F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("step"), (F.col("o_orderstatus") != "F").alias("extracted")
    )
    return sweep.persistent(flags).select("o_orderkey", "extracted")


@check("e9_first_empty_stop", """
WITH c AS (SELECT o_custkey AS profile_id, o_orderpriority AS step, count(*) FILTER (o_orderstatus = 'O') AS members FROM orders GROUP BY ALL)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.profile_id = c.profile_id AND d.step <= c.step AND d.members = 0)""")
def _(t):
    steps = t.raw("orders").groupBy(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("step")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("members")
    )
    return sweep.first_empty_stop(steps, "members", ["profile_id"], "step")
