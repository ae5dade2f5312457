"""Queries that score profiles: B7, B12, B14, C7, C8, C10, D11-D18, D21, D23, D26, E3, E4, F1, G1-G4, G7, H6, H10, H14, H16, H17, H22, I10, I12."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.plans import weaknesses
from skillgauge.functions.metrics import is_label, preference_rate
from skillgauge.functions.text import ratio_label, score_or_default, scoring_map, json_object_text
from skillgauge.operators import assess, filters, profiles, tree
from checks.tree_checks import statistics

MAX_SIZE = 40


def results(t):
    return t.accuracy().select("instance_id", "wins", "trials")


def split(t):
    """Instances with an urgent order."""
    return t.raw("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("instance_id")).distinct()


SPLIT = "(SELECT DISTINCT o_custkey AS instance_id FROM orders WHERE o_orderpriority = '1-URGENT')"


@check("b7_named_split", f"SELECT instance_id, acc AS wins FROM tree_leaf SEMI JOIN {SPLIT} USING (instance_id)")
def _(t):
    return filters.select_split(results(t), split(t)).select("instance_id", "wins")


@check("g1_split_complement", f"SELECT instance_id, acc AS wins FROM tree_leaf ANTI JOIN {SPLIT} USING (instance_id)")
def _(t):
    return filters.select_split(results(t), split(t), complement=True).select("instance_id", "wins")


@check("b12_valid_metrics", "SELECT c_nationkey, count(*) AS valid_count FROM customer WHERE c_custkey % 10 <> 0 GROUP BY c_nationkey")
def _(t):
    metrics = t.raw("customer").select("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(1).alias("metric"))
    return filters.valid_metrics(metrics).groupBy("c_nationkey").agg(F.count("*").alias("valid_count"))


@check("b14_clear_outcomes", "SELECT instance_id, CASE WHEN pref_a = 1 AND pref_b = 1 THEN 'positive' ELSE 'negative' END AS outcome FROM tree_leaf WHERE pref_a = pref_b")
def _(t):
    return filters.outcome_groups(t.win_rate()).select("instance_id", "outcome")


@check("c8_capability_results", "SELECT capability, count(*) AS instances, CAST(sum(acc) AS BIGINT) AS wins FROM association JOIN tree_leaf USING (instance_id) WHERE label = 'YES' GROUP BY capability")
def _(t):
    joined = assess.associated(t.association()).join(results(t), "instance_id")
    return joined.groupBy("capability").agg(F.count("*").alias("instances"), F.sum("wins").alias("wins"))


@check("c10_missing_annotations", "SELECT capability, instance_id FROM (SELECT capability, instance_id FROM (SELECT DISTINCT capability FROM profile), tree_leaf) ANTI JOIN association USING (capability, instance_id)")
def _(t):
    from skillgauge.operators.inference import missing_annotations

    wanted = t.profile().select("capability").distinct()
    return missing_annotations(wanted, t.leaves().select("instance_id"), t.association())


@check("d12_set_performance", "SELECT p.profile_id, p.capability, coalesce(CAST(sum(acc) AS DOUBLE) / count(acc), 1.0) AS performance FROM profile p LEFT JOIN (SELECT * FROM association JOIN tree_leaf USING (instance_id)) a USING (capability) GROUP BY ALL")
def _(t):
    performance = assess.capability_performance(t.association(), results(t))
    return t.profile().join(performance, "capability", "left").select(
        "profile_id", "capability", F.coalesce("performance", F.lit(1.0)).alias("performance")
    )


VAL1 = f"""
WITH p AS (SELECT profile_id, capability, coalesce(CAST(sum(acc) AS DOUBLE) / count(acc), 1.0) AS performance FROM profile LEFT JOIN (SELECT capability, acc FROM association JOIN tree_leaf USING (instance_id)) USING (capability) GROUP BY ALL),
v AS (SELECT profile_id, count(*) AS size, avg(performance) AS val1 FROM p GROUP BY ALL HAVING count(*) <= {MAX_SIZE})"""
VAL2 = """
WITH u AS (SELECT DISTINCT profile_id, instance_id, acc FROM profile JOIN association USING (capability) JOIN tree_leaf USING (instance_id)),
v AS (SELECT p.profile_id, count(u.acc) AS num, coalesce(CAST(sum(acc) AS DOUBLE) / count(acc), 1.0) AS val2 FROM (SELECT DISTINCT profile_id FROM profile) p LEFT JOIN u ON u.profile_id = p.profile_id GROUP BY ALL)"""


def val1(t):
    return assess.profile_means(t.profile(), assess.capability_performance(t.association(), results(t)), MAX_SIZE)


@check("d13_profile_means", VAL1 + " SELECT size, round(min(val1), 9) AS val1 FROM v GROUP BY size")
def _(t):
    return assess.best_per_size(val1(t), "size", "val1").withColumn("val1", F.round("val1", 9))


@check("d14_profile_unions", VAL2 + " SELECT num, round(min(val2), 9) AS val2 FROM v GROUP BY num")
def _(t):
    scored = assess.union_performance(t.profile(), t.association(), results(t))
    return assess.best_per_size(scored, "num", "val2").withColumn("val2", F.round("val2", 9))


@check("e4_running_best", VAL1 + ", c AS (SELECT 'acc' AS method, size, min(val1) AS val1 FROM v GROUP BY size) SELECT method, size, round(min(val1) OVER (ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100, 7) AS best FROM c")
def _(t):
    curve = assess.best_per_size(val1(t), "size", "val1").withColumn("method", F.lit("acc"))
    return assess.running_best(curve, "size", "val1", ["method"]).select("method", "size", F.round("best", 7).alias("best"))


def truth(t):
    return t.raw("part").filter("p_brand = 'Brand#1'").select(F.col("p_name").alias("capability")).distinct()


OVERLAP = """
WITH tr AS (SELECT DISTINCT p_name AS capability FROM part WHERE p_brand = 'Brand#1'),
up AS (SELECT DISTINCT profile_id, instance_id FROM profile JOIN association USING (capability)), ut AS (SELECT DISTINCT instance_id FROM tr JOIN association USING (capability)),
r AS (SELECT p.profile_id, 'recall' AS side, a.capability, count(up.instance_id) AS part, count(*) AS whole FROM (SELECT DISTINCT profile_id FROM profile) p CROSS JOIN (SELECT * FROM association SEMI JOIN tr USING (capability)) a LEFT JOIN up ON up.profile_id = p.profile_id AND up.instance_id = a.instance_id GROUP BY ALL),
q AS (SELECT profile_id, 'precision' AS side, capability, count(ut.instance_id) AS part, count(*) AS whole FROM profile JOIN association a USING (capability) LEFT JOIN ut USING (instance_id) GROUP BY ALL),
o AS (SELECT * FROM r UNION ALL SELECT * FROM q)"""


def overlap(t):
    return assess.overlap(truth(t), t.profile(), t.association())


@check("d15_overlap_report", OVERLAP + ", s AS (SELECT profile_id, avg(part / whole) FILTER (side = 'recall') AS recall, avg(part / whole) FILTER (side = 'precision') AS p FROM o GROUP BY profile_id) SELECT profile_id, round(recall, 8) AS recall, round(p, 8) AS precision, round(2 * recall * p / (recall + p), 8) AS f1 FROM s")
def _(t):
    report = assess.overlap_report(overlap(t))
    return report.select("profile_id", *[F.round(c, 8).alias(c) for c in ("recall", "precision", "f1")])


@check("h14_ratio_labels", OVERLAP + " SELECT profile_id, side, capability, printf('%d / %d = %.5f', part, whole, round_even(part / whole, 5)) AS label FROM o")
def _(t):
    return overlap(t).select("profile_id", "side", "capability", "label")


@check("d23_best_f1", OVERLAP + ", s AS (SELECT profile_id, avg(part / whole) FILTER (side = 'recall') AS r, avg(part / whole) FILTER (side = 'precision') AS p FROM o GROUP BY profile_id) SELECT 'd' AS dataset, 0.2::DOUBLE AS drate, concat('m', profile_id % 3) AS method, round(max(2 * r * p / (r + p)), 8) AS best_f1 FROM s GROUP BY ALL")
def _(t):
    reports = assess.overlap_report(overlap(t)).select(
        F.lit("d").alias("dataset"), F.lit(0.2).alias("drate"), F.concat(F.lit("m"), (F.col("profile_id") % 3).cast("string")).alias("method"), "f1"
    )
    return assess.best_f1(reports).withColumn("best_f1", F.round("best_f1", 8))


@check("d16_located_performance", """
WITH n AS (SELECT path, tau FROM acc_stat, (VALUES (CAST(0.46 AS DOUBLE)), (0.48), (0.5), (0.55)) v(tau) WHERE hi < tau),
f AS (SELECT DISTINCT l.instance_id, l.result, n.tau FROM located l JOIN n ON n.path = '' OR starts_with(l.path, concat(n.path, '/')))
SELECT tau AS threshold, count(*) AS instances, round(avg(result), 9) AS performance FROM f GROUP BY tau""")
def _(t):
    taus = F.explode(F.array(*[F.lit(x) for x in (0.46, 0.48, 0.5, 0.55)]))
    nodes = statistics(t).withColumn("threshold", taus).filter("hi < threshold").select("tree_id", "path", "threshold")
    flags = tree.instances_on_path(t.located(), nodes).select("instance_id", "threshold").distinct().withColumn("extracted", F.lit(True))
    return assess.located_performance(flags, t.located()).withColumn("performance", F.round("performance", 9))


@check("d17_overall_mean", f"SELECT round(avg(acc), 9) AS overall, count(acc) AS instances FROM tree_leaf ANTI JOIN {SPLIT} USING (instance_id)")
def _(t):
    held_out = filters.select_split(t.accuracy(), split(t), complement=True)
    return assess.overall_mean(held_out, "wins").withColumn("overall", F.round("overall", 9))


@check("d18_mean_and_error", """
WITH r AS (SELECT o_orderpriority AS method, o_orderstatus AS seed, avg(o_totalprice) AS v FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderstatus = 'F' GROUP BY ALL)
SELECT method, round(avg(v), 4) AS mean, CASE WHEN count(v) > 1 THEN round(stddev_pop(v) / sqrt(count(v)), 4) END AS stderr, count(v) AS runs FROM r GROUP BY method""")
def _(t):
    orders = t.raw("orders").filter("o_orderpriority <> '5-LOW' OR o_orderstatus = 'F'")
    runs = orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("seed")).agg(F.avg("o_totalprice").alias("value"))
    return assess.mean_and_error(runs, ["method"]).withColumns({"mean": F.round("mean", 4), "stderr": F.round("stderr", 4)})


@check("g2_set_union", "SELECT DISTINCT profile_id, instance_id FROM profile JOIN association USING (capability)")
def _(t):
    return assess.profile_members(t.profile(), t.association())


@check("g3_intersection_ratio", f"WITH a AS (SELECT DISTINCT profile_id, instance_id FROM profile JOIN association USING (capability)) SELECT profile_id, count(s.instance_id) AS part, count(*) AS whole, round(count(s.instance_id) / count(*), 9) AS ratio FROM a LEFT JOIN {SPLIT} s USING (instance_id) GROUP BY profile_id")
def _(t):
    sets = assess.profile_members(t.profile(), t.association())
    return assess.intersection_ratio(sets, split(t), ["profile_id"]).withColumn("ratio", F.round("ratio", 9))


@check("g4_set_differences", f"SELECT (SELECT count(*) FROM tree_leaf ANTI JOIN {SPLIT} USING (instance_id)) AS only_left, (SELECT count(*) FROM {SPLIT} ANTI JOIN tree_leaf USING (instance_id)) AS only_right")
def _(t):
    return assess.set_differences(t.leaves(), split(t))


def capabilities(t):
    return t.spark.range(1, 21).select(F.col("id").alias("number"), F.concat(F.lit("cap "), F.col("id").cast("string")).alias("capability"))


def rates(t):
    return t.leaves().select("instance_id", preference_rate(F.col("pref_a"), F.col("pref_b")).alias("result"))


LONG = "(SELECT instance_id, cap_1 AS number FROM assignment UNION ALL SELECT instance_id, cap_2 FROM assignment)"
RATE = "((pref_a = 1)::INT + (pref_b = 1)::INT) / 2"


@check("h6_preference_rate", f"SELECT instance_id, {RATE} AS result FROM tree_leaf")
def _(t):
    return rates(t)


@check("g7_flatten", f"SELECT instance_id, number FROM {LONG}")
def _(t):
    return profiles.explode_assignment(t.assignment())


@check("c7_assigned_results", f"SELECT instance_id, number, concat('cap ', number) AS capability, {RATE} AS result FROM {LONG} JOIN tree_leaf USING (instance_id)")
def _(t):
    return profiles.assigned_results(t.assignment(), capabilities(t), rates(t)).select("instance_id", "number", "capability", "result")


@check("d11_assigned_performance", f"SELECT number, concat('cap ', number) AS capability, round(avg({RATE}), 9) AS performance, count(*) AS instances FROM {LONG} JOIN tree_leaf USING (instance_id) GROUP BY number")
def _(t):
    return profiles.assigned_performance(t.assignment(), capabilities(t), rates(t)).withColumn("performance", F.round("performance", 9))


@check("d26_instances_in_order", f"SELECT concat('cap ', number) AS capability, s.instance_id * 7919 % 1000003 AS position, s.instance_id FROM {LONG} JOIN {SPLIT} s USING (instance_id)")
def _(t):
    order = split(t).withColumn("position", F.col("instance_id") * 7919 % 1000003)
    return profiles.instances_in_order(t.assignment(), capabilities(t), order)


PREFIX = f"""
WITH p AS (SELECT concat('m', number % 2) AS method, number, concat('cap ', number) AS capability, avg({RATE}) AS performance FROM {LONG} JOIN tree_leaf USING (instance_id) GROUP BY number)
SELECT method, CAST(row_number() OVER w AS INT) AS profile_size, array_to_string(list(capability) OVER w, ';') AS profile FROM p WINDOW w AS (PARTITION BY method ORDER BY performance, number ROWS UNBOUNDED PRECEDING)"""


def growing(t, size=None):
    performance = profiles.assigned_performance(t.assignment(), capabilities(t), rates(t)).withColumn(
        "method", F.concat(F.lit("m"), (F.col("number") % 2).cast("string"))
    )
    return profiles.growing_profiles(performance, "number", ["method"], size).select(
        "method", "profile_size", F.array_join("profile", ";").alias("profile")
    )


@check("e3_growing_profiles", PREFIX)
def _(t):
    return growing(t)


@check("f1_capability_order", f"SELECT * FROM ({PREFIX}) WHERE profile_size = 10")
def _(t):
    return growing(t, 10)


RESPONSE = "concat('Scores: ', CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE concat('{\"1\": {\"reasoning\": \"r\", \"score\": ', c_custkey % 5 + 1, '}, \"2\": {\"reasoning\": \"s {x}\"}, \"3\": {\"score\": \"', c_nationkey % 4, '\"}, \"4\": 7}') END, ' done')"


def responses(t):
    key = F.col("c_custkey")
    body = F.concat(
        F.lit('{"1": {"reasoning": "r", "score": '), (key % 5 + 1).cast("string"), F.lit('}, "2": {"reasoning": "s {x}"}, "3": {"score": "'),
        (F.col("c_nationkey") % 4).cast("string"), F.lit('"}, "4": 7}'),
    )
    text = F.concat(F.lit("Scores: "), F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(body), F.lit(" done"))
    return t.raw("customer").select(key.alias("instance_id"), text.alias("response"))


@check("h9_json_in_text", f"SELECT c_custkey AS instance_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN regexp_extract({RESPONSE}, '\\{{.*\\}}') END AS object, CASE WHEN c_mktsegment <> 'BUILDING' THEN 4 END AS entries FROM customer")
def _(t):
    text = F.col("response")
    return responses(t).select(
        "instance_id", json_object_text(text).alias("object"), F.when(scoring_map(text).isNotNull(), F.size(scoring_map(text))).alias("entries")
    )


@check("h10_score_default", "SELECT c_custkey AS instance_id, n AS capability, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN n = 1 THEN c_custkey % 5 + 1 WHEN n = 3 THEN c_nationkey % 4 ELSE 1.0 END::DOUBLE AS score FROM customer, (VALUES (1), (2), (3), (4), (5)) v(n)")
def _(t):
    return profiles.parsed_scores(responses(t), 5)


@check("d21_prior_mass", "SELECT n AS capability, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN n = 1 THEN c_custkey % 5 + 1 WHEN n = 3 THEN c_nationkey % 4 ELSE 1.0 END)::DOUBLE AS mass FROM customer, (VALUES (1), (2), (3), (4), (5)) v(n) GROUP BY n")
def _(t):
    return profiles.prior_mass(profiles.parsed_scores(responses(t), 5))


HASH = "('0x' || substr(md5(concat('7:', instance_id, ':{turn}')), 1, 13))::BIGINT / 4503599627370496.0"
PLANTED = """
WITH k AS (SELECT instance_id, count(a.capability) AS planted FROM tree_leaf LEFT JOIN (SELECT * FROM association WHERE capability IN (SELECT DISTINCT p_name FROM part WHERE p_brand = 'Brand#1' AND p_size <= 5)) a USING (instance_id) GROUP BY instance_id)"""


def planted(t):
    return t.raw("part").filter("p_brand = 'Brand#1' AND p_size <= 5").select(F.col("p_name").alias("capability")).distinct()


def synthetic(t, draws):
    return assess.synthetic_results(t.leaves(), t.association(), planted(t), 0.7, 0.8, 7, draws)


@check("h16_attacked_probability", PLANTED + " SELECT instance_id, planted, round(0.7 * power(0.8, planted), 9)::DOUBLE AS probability FROM k")
def _(t):
    return synthetic(t, 1).select("instance_id", "planted", F.round("probability", 9).alias("probability"))


@check("h17_seeded_draw", PLANTED + f" SELECT instance_id, ({HASH.format(turn=0)} < 0.7 * power(0.8, planted))::INT AS wins FROM k")
def _(t):
    return synthetic(t, 1).select("instance_id", "wins")


@check("i12_synthetic_results", PLANTED + f" SELECT instance_id, planted, ({HASH.format(turn=0)} < 0.7 * power(0.8, planted))::INT + ({HASH.format(turn=1)} < 0.7 * power(0.8, planted))::INT AS wins, 2 AS trials FROM k")
def _(t):
    return synthetic(t, 2).drop("probability")


@check("h22_label_validity", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'yes, it is' END AS label, c_custkey % 4 < 2 AS valid FROM customer")
def _(t):
    kind = F.col("c_custkey") % 4
    label = F.when(kind == 0, "YES").when(kind == 1, "NO").when(kind == 2, "yes, it is")
    return t.raw("customer").select("c_custkey", label.alias("label"), is_label(label).alias("valid"))


SCORED = """WITH s AS (SELECT c_custkey AS k, j, CASE WHEN j = c_custkey % 20 + 1 OR j = (c_custkey * 7) % 20 + 1 THEN 5.0 ELSE 1 + (c_custkey * j) % 4 END::DOUBLE AS score
FROM customer, range(1, 21) r(j))"""


@check("i10_balanced_assignment", SCORED + """ SELECT j::INT AS number, round(2.0 * (SELECT count(*) FROM customer) * sum(score) / (SELECT sum(score) FROM s), 6) AS target, TRUE AS balanced, 0::BIGINT AS odd_picks,
(SELECT sum(score) FROM (SELECT score, row_number() OVER (PARTITION BY k ORDER BY score DESC) AS n FROM s) WHERE n <= 2) AS most FROM s GROUP BY j""")
def _(t):
    """Every load within a tenth of its target, two different picks each, and a total that no bound on it undercuts."""
    scores = balanced_scores(t)
    assigned = profiles.balanced_assignment(scores, 20)
    report = profiles.assignment_report(assigned)
    picked = F.array_distinct("assignment")
    odd = assigned.agg(F.count_if((F.size("assignment") != 2) | (F.size(picked) != 2) | (F.array_min(picked) < 1) | (F.array_max(picked) > 20)).alias("odd_picks"))
    most = scores.agg(F.sum(F.aggregate(F.slice(F.sort_array("scores", asc=False), 1, 2), F.lit(0.0), lambda total, x: total + x)).alias("most"))
    inside = F.col("load").between(0.9 * F.col("target") - 1e-9, 1.1 * F.col("target") + 1e-9)
    facts = F.broadcast(odd.crossJoin(most))
    return report.select("number", F.round("target", 6).alias("target"), inside.alias("balanced")).crossJoin(facts)


def balanced_scores(t):
    key = F.col("c_custkey")
    wanted = F.transform(
        F.sequence(F.lit(1), F.lit(20)),
        lambda j: F.when((j == key % 20 + 1) | (j == (key * 7) % 20 + 1), 5.0).otherwise((1 + (key * j) % 4).cast("double")),
    )
    return t.raw("customer").select(key.alias("instance_id"), wanted.alias("scores"))


@check("l3_assessment_curves", f"""
SELECT curve, size, round(value, 9) AS value, round(min(value) OVER (PARTITION BY curve ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100, 7) AS best FROM (
  SELECT 'entries' AS curve, size::BIGINT AS size, value FROM ({VAL1} SELECT size, min(val1) AS value FROM v GROUP BY size)
  UNION ALL
  SELECT 'union' AS curve, num::BIGINT AS size, value FROM ({VAL2} SELECT num, min(val2) AS value FROM v GROUP BY num))""")
def _(t):
    curves = weaknesses.assessment_curves(t.profile(), t.association(), results(t), MAX_SIZE)
    return curves.select("curve", "size", F.round("value", 9).alias("value"), F.round("best", 7).alias("best"))
