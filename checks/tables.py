"""The given tables in the shapes the operators expect, and the same shapes as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skillgauge.functions.metrics import preference_wins
from skillgauge.operators.tree import path_text, prefixes
from skillgauge.session import spread


# Tables that grow with the scale and carry the work of a query.
LONG_TABLES = {"lineitem", "orders", "customer", "documents"}


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table, f"{self.sf_dir}/{name}") if name in LONG_TABLES else table

    def eval_log(self) -> DataFrame:
        """Perturbed prompts: one row per line item."""
        supplier = F.col("l_suppkey") % 3
        line = F.col("l_linenumber")
        return (
            self.raw("lineitem")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                (F.col("l_orderkey") * 10 + line).alias("evaluation_id"),
                F.col("l_partkey").alias("sample_index"),
                F.when(supplier == 0, "org/model-a").when(supplier == 1, "org/model-b").otherwise("org/model-c").alias("model"),
                F.lit("en").alias("language"),
                F.concat(F.lit("mmlu."), F.lower("p_type")).alias("dataset"),
                F.when(F.col("l_linestatus") == "F", 5).otherwise(0).alias("shots"),
                F.when(F.col("l_returnflag") == "A", "correct_first").when(F.col("l_returnflag") == "R", "random").alias("choices_order"),
                F.when(line % 3 == 0, "capitals").when(line % 3 == 1, "numbers").otherwise("roman").alias("enumerator"),
                F.when(F.col("l_discount") >= 0.07, 1.0).otherwise(0.0).alias("score"),
                F.concat(F.lit("Question: "), "p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("raw_input"),
                F.concat(F.substring(F.lit("ABCDE"), (line % 5 + 1).cast("int"), F.lit(1)), F.lit(". "), "p_name").alias("closest_answer"),
            )
        )

    def choices(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("mmlu."), F.lower("p_type")).alias("dataset"),
            key.alias("sample_index"),
            # The order turns with the key, and one part in seven is not listed.
            F.when(key % 4 == 0, F.array("p_name", "p_brand", "p_type", F.lit("none")))
            .when(key % 4 == 1, F.array("p_brand", "p_name", "p_type", F.lit("none")))
            .when(key % 4 == 2, F.array("p_brand", "p_type", F.when(key % 7 != 0, F.col("p_name")).otherwise("other"), F.lit("none")))
            .otherwise(F.array("p_brand", "p_type", F.lit("none"), F.when(key % 7 != 0, F.col("p_name")).otherwise("other")))
            .alias("choices"),
        )

    def leaves(self) -> DataFrame:
        """Leaves of a three-level tree with both kinds of metric."""
        key = F.col("c_custkey")
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.lit("t").alias("tree_id"),
                key.alias("instance_id"),
                F.array(F.col("n_regionkey"), F.col("n_nationkey"), (key % 10).cast("int")).alias("path"),
                F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("acc"),
                F.when(F.col("c_acctbal") > 3000, 1).otherwise(2).alias("pref_a"),
                F.when(key % 2 == 0, 1).otherwise(2).alias("pref_b"),
            )
        )

    def accuracy(self) -> DataFrame:
        return self.leaves().select(
            "tree_id", "instance_id", "path", F.col("acc").alias("wins"), F.lit(1).alias("trials")
        )

    def win_rate(self) -> DataFrame:
        return self.leaves().select(
            "tree_id", "instance_id", "path", preference_wins(F.col("pref_a"), F.col("pref_b")).alias("wins"), F.lit(2).alias("trials")
        )

    def descriptions(self) -> DataFrame:
        """A text for every inner node."""
        nodes = self.leaves().select("tree_id", F.explode(prefixes(F.col("path"))).alias("path")).distinct()
        return nodes.withColumn("description", F.concat(F.lit("skill "), path_text(F.col("path"))))

    def located(self) -> DataFrame:
        """Instances outside the tree, located in it, with their result."""
        key = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.lit("t").alias("tree_id"),
                key.alias("instance_id"),
                F.array(F.col("n_regionkey"), F.col("n_nationkey"), (key % 10).cast("int")).alias("path"),
                F.when(F.col("s_acctbal") > 4000, 1.0).otherwise(0.0).alias("result"),
            )
        )

    def association(self) -> DataFrame:
        return (
            self.raw("lineitem").select("l_partkey", "l_orderkey")
            .join(self.raw("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("p_name").alias("capability"), F.col("o_custkey").alias("instance_id"))
            .distinct()
            .withColumn("label", F.lit("YES"))
        )

    def profile(self) -> DataFrame:
        return (
            self.raw("part")
            .filter("p_type = 'ECONOMY'")
            .select(F.col("p_size").alias("profile_id"), F.col("p_name").alias("capability"))
            .distinct()
        )

    def assignment(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("instance_id"),
            F.array(key % 20 + 1, (key * 7) % 20 + 1).alias("assignment"),
        )

    def battles(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").filter(F.col("o_custkey") % 6 != F.col("o_orderkey") % 6).select(
            F.col("o_orderkey").alias("battle_id"),
            F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("question"),
            F.concat(F.lit("m"), (F.col("o_custkey") % 6).cast("string")).alias("model_a"),
            F.concat(F.lit("m"), (F.col("o_orderkey") % 6).cast("string")).alias("model_b"),
            F.when(status == "F", "model_a")
            .when(status == "O", "model_b")
            .when(F.col("o_orderpriority") == "5-LOW", "tie (bothbad)")
            .otherwise("tie")
            .alias("winner"),
            F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("answer_a"),
            F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("answer_b"),
        )

    def question_catalogue(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_type").alias("subject"),
            F.col("p_partkey").alias("idx"),
            F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand", F.lit(" ")).alias("question"),
            F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("score"),
        )

    def first_turns(self) -> DataFrame:
        def at(turn: int, column: str):
            return F.max(F.when(F.col("turn") == turn, F.col(column)))

        return self.raw("conversations").groupBy("conv_id").agg(
            at(0, "role").alias("role_0"),
            at(0, "text").alias("text_0"),
            at(1, "role").alias("role_1"),
            at(1, "text").alias("text_1"),
            F.count("*").alias("turns"),
        )

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings")


CTES = {
    "eval_log": """
SELECT l_orderkey * 10 + l_linenumber AS evaluation_id, l_partkey AS sample_index,
       CASE l_suppkey % 3 WHEN 0 THEN 'org/model-a' WHEN 1 THEN 'org/model-b' ELSE 'org/model-c' END AS model,
       'en' AS language, concat('mmlu.', lower(p_type)) AS dataset,
       CASE WHEN l_linestatus = 'F' THEN 5 ELSE 0 END AS shots,
       CASE l_returnflag WHEN 'A' THEN 'correct_first' WHEN 'R' THEN 'random' END AS choices_order,
       CASE l_linenumber % 3 WHEN 0 THEN 'capitals' WHEN 1 THEN 'numbers' ELSE 'roman' END AS enumerator,
       CASE WHEN l_discount >= CAST(0.07 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score,
       concat('Question: ', p_name, ' #', CAST(p_partkey AS STRING)) AS raw_input,
       concat(substring('ABCDE', CAST(l_linenumber % 5 + 1 AS INT), 1), '. ', p_name) AS closest_answer
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # The first copy of each evaluation inside its configuration.
    "clean_log": """
SELECT * EXCLUDE (copy) FROM (
  SELECT *, row_number() OVER (PARTITION BY model, language, dataset, shots, evaluation_id
    ORDER BY sample_index NULLS FIRST, choices_order NULLS FIRST, enumerator NULLS FIRST, score NULLS FIRST, raw_input, closest_answer) AS copy
  FROM eval_log) WHERE copy = 1""",
    "kept_log": """
SELECT * FROM clean_log WHERE shots IS DISTINCT FROM 5 OR coalesce(choices_order NOT IN ('correct_first', 'correct_last'), true)""",
    "question_scores": """
SELECT model, language, dataset, shots, sample_index, sum(score) AS total_score, count(score) AS instance_count,
       CAST(round_even(sum(score) / count(score), 3) AS DOUBLE) AS average_score, arg_min(raw_input, evaluation_id) AS question
FROM kept_log WHERE sample_index IS NOT NULL GROUP BY ALL""",
    "choices": """
SELECT concat('mmlu.', lower(p_type)) AS dataset, p_partkey AS sample_index, CASE p_partkey % 4 WHEN 0 THEN [p_name, p_brand, p_type, 'none'] WHEN 1 THEN [p_brand, p_name, p_type, 'none']
  WHEN 2 THEN [p_brand, p_type, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE 'other' END, 'none']
  ELSE [p_brand, p_type, 'none', CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE 'other' END] END AS choices FROM part""",
    "tree_leaf": """
SELECT c_custkey AS instance_id, n_regionkey AS l1, n_nationkey AS l2, CAST(c_custkey % 10 AS INT) AS l3,
       CASE WHEN c_acctbal > CAST(5000 AS DOUBLE) THEN 1 ELSE 0 END AS acc,
       CASE WHEN c_acctbal > CAST(3000 AS DOUBLE) THEN 1 ELSE 2 END AS pref_a,
       CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS pref_b
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "tree_node": """
SELECT CASE WHEN GROUPING(l1) = 1 THEN '' WHEN GROUPING(l2) = 1 THEN concat(l1) WHEN GROUPING(l3) = 1 THEN concat(l1, '/', l2) ELSE concat(l1, '/', l2, '/', l3) END AS path,
  CAST(3 - GROUPING(l1) - GROUPING(l2) - GROUPING(l3) AS INT) AS depth, count(*) AS size, CAST(sum(acc) AS BIGINT) AS acc,
  CAST(sum((pref_a = 1)::INT + (pref_b = 1)::INT) AS BIGINT) AS pref
FROM tree_leaf GROUP BY ROLLUP (l1, l2, l3)""",
    # Exact interval bounds by bisection on the binomial tails.
    "bound": """
SELECT k, n, alpha,
  CASE WHEN k = 0 THEN 0.0 ELSE list_reduce(range(50), lambda a, x: CASE WHEN list_sum(list_transform(range(k, n + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a.lo + a.hi) / 2) + (n - i) * ln(1 - (a.lo + a.hi) / 2)))) < alpha / 2
    THEN struct_pack(lo := (a.lo + a.hi) / 2, hi := a.hi) ELSE struct_pack(lo := a.lo, hi := (a.lo + a.hi) / 2) END,
    struct_pack(lo := 0::DOUBLE, hi := 1::DOUBLE)).lo END AS lo,
  CASE WHEN k = n THEN 1.0 ELSE list_reduce(range(50), lambda a, x: CASE WHEN list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a.lo + a.hi) / 2) + (n - i) * ln(1 - (a.lo + a.hi) / 2)))) > alpha / 2
    THEN struct_pack(lo := (a.lo + a.hi) / 2, hi := a.hi) ELSE struct_pack(lo := a.lo, hi := (a.lo + a.hi) / 2) END,
    struct_pack(lo := 0::DOUBLE, hi := 1::DOUBLE)).hi END AS hi
FROM (SELECT DISTINCT acc AS k, size AS n FROM tree_node WHERE size >= 5 UNION SELECT DISTINCT pref, size * 2 FROM tree_node WHERE size >= 5), (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) v(alpha)""",
    "acc_stat": """
SELECT path, regexp_replace(path, '/?[^/]*$', '') AS up, depth, size, lo, hi FROM tree_node LEFT JOIN bound ON k = acc AND n = size AND alpha = 0.05 WHERE size >= 5""",
    "located": """
SELECT s_suppkey AS instance_id, concat(n_regionkey, '/', n_nationkey, '/', s_suppkey % 10) AS path,
  CASE WHEN s_acctbal > 4000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS result FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # Every step of a threshold sweep tried on every node, in both directions.
    "sweep_low": """
SELECT s.path, s.up, s.depth, s.size, i AS step, i - 1 < ((SELECT max(hi) FROM acc_stat WHERE depth = 0 OR (depth = 1 AND size >= 20)) - hi) / 0.0001::DOUBLE AS passes
FROM acc_stat s, range(0, 10002) r(i)""",
    "sweep_high": """
SELECT s.path, s.up, s.depth, s.size, i AS step, i - 1 < (lo - (SELECT min(lo) FROM acc_stat WHERE depth = 0 OR (depth = 1 AND size >= 20))) / 0.0001::DOUBLE AS passes
FROM acc_stat s, range(0, 10002) r(i)""",
    "able_low": """
SELECT p.path, p.step, p.size FROM sweep_low p ANTI JOIN (SELECT up, step FROM sweep_low WHERE depth > 0 AND size >= 20 AND NOT passes) b ON b.up = p.path AND b.step = p.step WHERE passes""",
    "able_high": """
SELECT p.path, p.step, p.size FROM sweep_high p ANTI JOIN (SELECT up, step FROM sweep_high WHERE depth > 0 AND size >= 20 AND NOT passes) b ON b.up = p.path AND b.step = p.step WHERE passes""",
    "extracted_low": """
SELECT a.path, a.step, a.size FROM able_low a ANTI JOIN able_low b ON a.step = b.step AND a.path <> b.path AND (b.path = '' OR starts_with(a.path, concat(b.path, '/')))""",
    "extracted_high": """
SELECT a.path, a.step, a.size FROM able_high a ANTI JOIN able_high b ON a.step = b.step AND a.path <> b.path AND (b.path = '' OR starts_with(a.path, concat(b.path, '/')))""",
    "low_profile": """
SELECT step, count(*) AS profile_size, list_sort(list(concat('skill ', path))) AS profile FROM extracted_low
WHERE step < (SELECT min(i) FROM range(0, 10003) r(i) WHERE i NOT IN (SELECT step FROM extracted_low)) GROUP BY step""",
    "association": """
SELECT DISTINCT p_name AS capability, o_custkey AS instance_id, 'YES' AS label
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "profile": """
SELECT DISTINCT p_size AS profile_id, p_name AS capability FROM part WHERE p_type = 'ECONOMY'""",
    "assignment": """
SELECT c_custkey AS instance_id, c_custkey % 20 + 1 AS cap_1, (c_custkey * 7) % 20 + 1 AS cap_2 FROM customer""",
    "battles": """
SELECT o_orderkey AS battle_id, concat('q', CAST(o_custkey AS STRING)) AS question,
       concat('m', CAST(o_custkey % 6 AS STRING)) AS model_a, concat('m', CAST(o_orderkey % 6 AS STRING)) AS model_b,
       CASE o_orderstatus WHEN 'F' THEN 'model_a' WHEN 'O' THEN 'model_b'
            ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'tie (bothbad)' ELSE 'tie' END END AS winner,
       concat('a', CAST(o_orderkey AS STRING)) AS answer_a, concat('b', CAST(o_orderkey AS STRING)) AS answer_b
FROM orders WHERE o_custkey % 6 <> o_orderkey % 6""",
    "question_catalogue": """
SELECT p_type AS subject, p_partkey AS idx, concat(' ', p_name, ' ', p_brand, ' ') AS question,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS score
FROM part""",
    "first_turns": """
SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS role_0, max(CASE WHEN turn = 0 THEN text END) AS text_0,
       max(CASE WHEN turn = 1 THEN role END) AS role_1, max(CASE WHEN turn = 1 THEN text END) AS text_1, count(*) AS turns
FROM conversations GROUP BY conv_id""",
}
