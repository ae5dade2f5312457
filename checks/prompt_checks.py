"""Queries that make prompts from whole tables: E6, E8, H12, B14, F4, H11."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.plans import prompts


def instances(t):
    return t.raw("customer").select(
        F.col("c_custkey").alias("instance_id"), F.col("c_name").alias("input"), F.col("c_mktsegment").alias("output")
    )


SECTION = "concat('### Question #', row_number() OVER w, chr(10), c_name, chr(10), chr(10), '### Solution #', row_number() OVER w, chr(10), c_mktsegment, chr(10))"


@check("e6_discovery_prompts", f"""
WITH i AS (SELECT *, row_number() OVER (ORDER BY md5(concat('0:', c_custkey)), c_custkey) - 1 AS idx FROM customer),
s AS (SELECT idx // 20 AS chunk, idx, {SECTION} AS s FROM i WINDOW w AS (PARTITION BY idx // 20 ORDER BY idx))
SELECT chunk, concat(count(*), ' instances', chr(10), string_agg(s, chr(10) ORDER BY idx)) AS prompt FROM s GROUP BY chunk""")
def _(t):
    return prompts.discovery_prompts(instances(t), "{instance_num} instances\n{inputs_and_outputs}", ("Question", "Solution"))


@check("b14_contrast_prompt", f"""
WITH o AS (SELECT instance_id, c_name, c_mktsegment, CASE WHEN pref_a = 1 THEN 'p' ELSE 'n' END AS side, md5(concat('0:', instance_id)) AS h FROM tree_leaf JOIN customer ON c_custkey = instance_id WHERE pref_a = pref_b),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY side ORDER BY h, instance_id) <= 50),
s AS (SELECT side, h, {SECTION} AS s FROM k WINDOW w AS (PARTITION BY side ORDER BY h)),
l AS (SELECT side, count(*) AS n, string_agg(s, chr(10) ORDER BY h) AS t FROM s GROUP BY side)
SELECT concat('Find 20. Failed ', n.n, ': ', n.t, ' Solved ', p.n, ': ', p.t) AS prompt FROM l n JOIN l p ON n.side = 'n' AND p.side = 'p'""")
def _(t):
    template = "Find {capability_num}. Failed {negative_instance_num}: {negative_inputs_and_outputs} Solved {positive_instance_num}: {positive_inputs_and_outputs}"
    return prompts.contrast_prompt(instances(t), t.win_rate(), template, ("Question", "Solution"))


@check("h12_scoring_prompts", "SELECT c_custkey AS instance_id, concat('Score 2 of (1) a', chr(10), chr(10), '(2) b', chr(10), ' for ', c_name, ' / ', c_mktsegment, ' as {json}') AS prompt FROM customer")
def _(t):
    return prompts.scoring_prompts(instances(t), ["a", "b"], "Score {num_capabilities} of {capability_list} for {input} / {output} as {json}")


@check("h12_annotation_prompts", "SELECT c_custkey AS instance_id, concat('Q: ', c_name, ' A: ', c_mktsegment) AS prompt FROM customer")
def _(t):
    return prompts.annotation_prompts(instances(t), "Q: {input} A: {output}")


@check("h11_answer_lines", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS line, capability FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS capability FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(160), chr(8195), chr(12288)))) AS l FROM documents)) WHERE capability <> ''")
def _(t):
    return prompts.answer_lines(t.raw("documents").select("doc_id", F.col("text").alias("response")), "doc_id")
