"""Queries over texts: A4-A6, A8, A11-A14, B8-B11, B15, C1, C9, C13, C14, D19, D20, D22, D24, D28, E2, E6-E8, F2, F4-F6, F8, H5, H11-H13, H15, H18-H21, I8, I9, I11, I13-I16, J1-J3."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.functions import text as tx
from skillgauge.operators import bridge, corpora, filters, indexing, inference, ratings, tree
from skillgauge.session import cut_lineage, scratch_path
from skillgauge.sources import documents as docs, sinks

# ---- sources -----------------------------------------------------------------------------------


@check("a4_json_array_scan", "SELECT c_custkey AS instance_id, c_name AS problem, c_mktsegment AS solution FROM customer")
def _(t):
    path = scratch_path(t.spark, "arrays")
    items = t.raw("customer").select(
        F.floor(F.col("c_custkey") / 50).alias("file"), "c_custkey", F.struct(F.col("c_name").alias("problem"), F.col("c_mktsegment").alias("solution")).alias("item")
    )
    arrays = items.groupBy("file").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "item"))), lambda x: x["item"])).alias("value")
    )
    arrays.repartition("file").write.partitionBy("file").option("lineSep", " ").text(path)
    rows = docs.scan_json_array(t.spark, path, "struct<problem:string,solution:string>")
    number = F.regexp_extract("file", r"file=(\d+)", 1).cast("bigint")
    return rows.select((number * 50 + F.col("position")).alias("instance_id"), "problem", "solution")


@check("a5_json_lines_scan", "SELECT event_id, event_type AS data_topic, value FROM events")
def _(t):
    path = scratch_path(t.spark, "lines")
    t.raw("events").select("event_id", F.col("event_type").alias("data_topic"), "value").write.json(path)
    return docs.scan_json_lines(t.spark, path, "event_id bigint, data_topic string, value double")


def tree_documents(t):
    """One tree per hundred customers: clusters of ten, each a list of instances."""
    key = F.col("c_custkey")
    groups = t.raw("customer").groupBy(F.floor(key / 100).alias("tree"), (F.floor(key / 10) % 10).cast("string").alias("cluster")).agg(
        F.array_sort(F.collect_list("c_custkey")).alias("subtrees")
    )
    trees = groups.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("subtrees")))).alias("subtrees"))
    return trees.select(F.concat(F.lit("tree-"), F.col("tree").cast("string")).alias("tree_id"), F.to_json(F.struct("subtrees")).alias("value"))


@check("a6_tree_scan", """
SELECT concat('tree-', c_custkey // 100) AS tree_id, concat(c_custkey // 10 % 10) AS path, 1 AS depth, 'leaf' AS kind, c_custkey AS instance_id FROM customer
UNION ALL SELECT DISTINCT concat('tree-', c_custkey // 100), concat(c_custkey // 10 % 10), 1, 'inner', NULL FROM customer
UNION ALL SELECT DISTINCT concat('tree-', c_custkey // 100), '', 0, 'inner', NULL FROM customer""")
def _(t):
    return docs.parse_trees(tree_documents(t)).select("tree_id", tree.path_text(F.col("path")).alias("path"), "depth", "kind", "instance_id")


@check("a8_report_scan", "SELECT c_nationkey AS nation, round(avg(c_acctbal), 3) AS mean FROM customer GROUP BY c_nationkey")
def _(t):
    path = scratch_path(t.spark, "reports")
    stats = t.raw("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    report = F.concat(
        F.lit("         score\ncount  "), F.col("n").cast("string"), F.lit("\nmean     "), F.format_string("%.3f", F.round("m", 3)),
        F.lit("\n        score\n        count  mean\nkind\nA      3  0.5\n"),
    )
    stats.select(F.col("c_nationkey").alias("nation"), report.alias("value")).repartition("nation").write.partitionBy("nation").option("lineSep", "\u0001").text(path)
    return docs.scan_reports(t.spark, path).select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("int").alias("nation"), "mean")


@check("a12_numbered_profiles", "SELECT profile_id, capability FROM profile")
def _(t):
    base = scratch_path(t.spark, "profiles")
    lists = t.profile().groupBy("profile_id").agg(F.to_json(F.array_sort(F.collect_list("capability"))).alias("value"))
    lists.select(F.col("profile_id").alias("size"), "value").repartition("size").write.partitionBy("size").option("lineSep", " ").text(base)
    return docs.scan_numbered(t.spark, base + "/size={PLACEHOLDER}", 120).select("profile_id", "capability")


@check("a13_sorted_json_sink", "SELECT p_size AS size, count(*) AS parts, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY p_size")
def _(t):
    path = scratch_path(t.spark, "curve")
    sinks.write_sorted_json(t.raw("part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("parts"), F.sum("p_partkey").alias("keys")), path, "size")
    return t.spark.read.schema("size int, parts bigint, keys bigint").json(path)


def catalogue_documents(t):
    """Question maps in blocks of a hundred parts, so that no document grows with the table."""
    part = t.question_catalogue()
    block = F.floor(F.col("idx") / 100).alias("block")
    entries = part.groupBy(block, "subject").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("idx", "question"))), lambda e: F.struct(e["idx"].cast("string"), e["question"]))).alias("m")
    )
    return entries.groupBy("block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("subject", "m")))).alias("value"))


@check("a14_question_catalogue", "SELECT subject, concat(idx) AS idx, question FROM question_catalogue")
def _(t):
    return docs.explode_catalogue(catalogue_documents(t)).select("subject", "idx", "question")


# ---- bridge ------------------------------------------------------------------------------------


def lookups(t):
    wanted = F.concat(F.lit("\t"), "p_name", F.lit(" "), F.when(F.col("p_size") % 7 == 0, "Brand#none").otherwise(F.col("p_brand")), F.lit("\n"))
    return t.raw("part").select("p_partkey", wanted.alias("question"))


SCORED = """
WITH f AS (SELECT trim(question) AS q, score, row_number() OVER (PARTITION BY trim(question) ORDER BY subject, idx) AS rn FROM question_catalogue),
k AS (SELECT q, coalesce(score, -1) AS score FROM f WHERE rn = 1),
w AS (SELECT p_partkey, concat(p_name, ' ', CASE WHEN p_size % 7 = 0 THEN 'Brand#none' ELSE p_brand END) AS q FROM part)"""


@check("c1_question_lookup", SCORED + " SELECT p_partkey, coalesce(k.score, -1) AS score FROM w LEFT JOIN k USING (q)")
def _(t):
    catalogue = t.question_catalogue()
    scores = catalogue.select("idx", "score").dropna()
    return bridge.lookup_scores(lookups(t), catalogue, scores, ["subject", "idx"]).select("p_partkey", "score")


@check("i11_scored_tree", SCORED + " SELECT concat('tree-', p_partkey // 100) AS tree_id, p_partkey % 100 AS step, w.q AS question, coalesce(k.score, -1) AS score FROM w LEFT JOIN k USING (q)")
def _(t):
    key = F.col("p_partkey")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nA. one\nQuestion: again"))
    records = lookups(t).select(F.floor(key / 100).alias("tree"), F.struct((key % 100).cast("int").alias("step"), F.struct(prompt.alias("input")).alias("node")).alias("record"))
    trees = records.groupBy("tree").agg(F.transform(F.array_sort(F.collect_list("record")), lambda r: r["node"]).alias("subtrees"))
    nodes = docs.parse_trees(trees.select(F.concat(F.lit("tree-"), F.col("tree").cast("string")).alias("tree_id"), F.to_json(F.struct("subtrees")).alias("value")))
    catalogue = t.question_catalogue()
    scored = bridge.scored_tree(nodes, catalogue, catalogue.select("idx", "score").dropna(), ["subject", "idx"])
    return scored.select("tree_id", F.element_at("path", 1).cast("bigint").alias("step"), "question", "score")


PAIRS = "WITH s AS (SELECT sample_index, CAST(round_even(avg(score), 3) AS DOUBLE) AS score FROM eval_log GROUP BY ALL), p AS (SELECT p_type AS category, s.score, p_retailprice / 7000 + p_size / 50000 AS skill FROM s JOIN part ON p_partkey = sample_index)"


def question_pairs(t):
    scores = t.eval_log().groupBy("sample_index").agg(F.bround(F.avg("score"), 3).alias("score"))
    part = t.raw("part").select(F.col("p_partkey").alias("sample_index"), F.col("p_type").alias("category"), (F.col("p_retailprice") / 7000 + F.col("p_size") / 50000).alias("skill"))
    return scores.join(part, "sample_index")


@check("d24_correlation", PAIRS + ", r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx, rank() OVER (ORDER BY skill) + (count(*) OVER (PARTITION BY skill) - 1) / 2 AS ry FROM p) SELECT round(corr(score, skill), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS questions FROM r")
def _(t):
    return bridge.correlations(question_pairs(t), "score", "skill").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "questions")


@check("d28_robustness_groups", PAIRS + " SELECT category, CASE WHEN score >= 0.35 THEN 'high' ELSE 'low' END AS robustness, count(*) AS questions, round(avg(score), 6) AS mean_score, round(avg(skill), 6) AS mean_skill FROM p GROUP BY ALL")
def _(t):
    groups = bridge.robustness_groups(question_pairs(t), 0.35)
    return groups.withColumns({"mean_score": F.round("mean_score", 6), "mean_skill": F.round("mean_skill", 6)})


@check("h5_question_text", "SELECT evaluation_id, trim(substr(raw_input, 10)) AS question, count(*) AS \"rows\" FROM eval_log GROUP BY ALL")
def _(t):
    prompt = F.concat("raw_input", F.lit("  \n\nA. one\n\nQuestion: more"))
    return t.eval_log().select("evaluation_id", tx.question_text(prompt).alias("question")).groupBy("evaluation_id", "question").agg(F.count("*").alias("rows"))


# ---- conversations -----------------------------------------------------------------------------

SPACE = tx.WHITESPACE.replace("'", "''")
KEY = f"lower(trim(text_0, '{SPACE}'))"
TOKENS = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"
VALID = f"turns >= 2 AND role_0 = 'user' AND role_1 = 'assistant' AND trim(text_0, '{SPACE}') <> '' AND trim(text_1, '{SPACE}') <> '' AND text_1 <> chr(8203)"
SPEAKERS = {"first": "user", "second": "assistant"}


@check("b8_topic_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def _(t):
    return filters.topic_starts_with(t.raw("documents"), "src1", "source").select("doc_id", "source")


@check("b9_valid_dialogues", f"SELECT conv_id, turns FROM first_turns WHERE {VALID}")
def _(t):
    return filters.role_tagged_dialogues(t.first_turns(), **SPEAKERS).select("conv_id", "turns")


@check("b9_language_dialogues", f"SELECT conv_id FROM first_turns WHERE turns >= 2 AND turns % 3 <> 0 AND trim(text_0, '{SPACE}') <> '' AND trim(text_1, '{SPACE}') <> ''")
def _(t):
    language = F.when(F.col("turns") % 3 == 0, "French").otherwise("English")
    tagged = t.first_turns().withColumns({"language_0": F.lit("English"), "language_1": language})
    return filters.language_tagged_dialogues(tagged).select("conv_id")


@check("b10_no_control_tokens", "SELECT conv_id, turn FROM conversations WHERE NOT contains(text, 'un')")
def _(t):
    return filters.without_control_tokens(t.raw("conversations"), "text", "un").select("conv_id", "turn")


@check("b11_token_limit", f"SELECT conv_id, {TOKENS.format('text_0')} + {TOKENS.format('text_1')} AS tokens FROM first_turns WHERE {TOKENS.format('text_0')} + {TOKENS.format('text_1')} <= 300")
def _(t):
    kept = filters.within_token_limit(t.first_turns(), ["text_0", "text_1"], 300)
    return kept.select("conv_id", (tx.token_count(F.col("text_0")) + tx.token_count(F.col("text_1"))).cast("bigint").alias("tokens"))


@check("e2_first_message_dedup", f"SELECT conv_id FROM first_turns WHERE text_0 IS NOT NULL QUALIFY conv_id = max(conv_id) OVER (PARTITION BY {KEY})")
def _(t):
    return corpora.dedup_first_messages(t.first_turns().dropna(subset=["text_0"]), "conv_id", "conv_id").select("conv_id")


@check("h15_first_message_key", f"SELECT conv_id, turn, substr(lower(trim(text, '{SPACE}')), 1, 512) AS key FROM conversations")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", tx.first_message_key(F.col("text"), 512).alias("key"))


CORPUS = f"SELECT conv_id, text_0 AS instruction, text_1 AS response FROM (SELECT * FROM first_turns WHERE {VALID} AND {TOKENS.format('text_0')} + {TOKENS.format('text_1')} <= 4096 QUALIFY conv_id = max(conv_id) OVER (PARTITION BY {KEY}))"


@check("i13_role_tagged_corpus", CORPUS)
def _(t):
    return corpora.instruction_corpus(t.first_turns(), "conv_id", **SPEAKERS)


@check("i13_sampled_corpus", CORPUS + " ORDER BY md5(concat('42:', conv_id)), conv_id LIMIT 50")
def _(t):
    """The sample of the finished corpus that a training set asks for."""
    return corpora.instruction_corpus(t.first_turns(), "conv_id", size=50, **SPEAKERS)


@check("i13_language_tagged_corpus", f"""
SELECT conv_id, text_0 AS instruction, text_1 AS response FROM first_turns WHERE turns >= 2 AND trim(text_0, '{SPACE}') <> '' AND trim(text_1, '{SPACE}') <> '' AND {TOKENS.format('text_0')} + {TOKENS.format('text_1')} <= 4096
QUALIFY conv_id = max(conv_id) OVER (PARTITION BY substr({KEY}, 1, 512))""")
def _(t):
    tagged = t.first_turns().withColumns({"language_0": F.lit("English"), "language_1": F.lit("English")})
    return corpora.instruction_corpus(tagged, "conv_id", "language", key_length=512)


@check("f4_shuffle_and_take", "SELECT doc_id FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 100")
def _(t):
    return indexing.sample_rows(t.raw("documents").select("doc_id"), 100, 42, "doc_id")


@check("f5_sample_per_group", "SELECT lang, doc_id, CAST(rn AS INT) AS sample_rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', doc_id)), doc_id) AS rn FROM documents) WHERE rn <= 5")
def _(t):
    return indexing.sample_per_group(t.raw("documents").select("lang", "doc_id"), 5, 7, ["lang"], "doc_id")


@check("f6_shuffle_in_group", "SELECT conv_id, array_to_string(list(turn ORDER BY md5(concat('42:', conv_id, ':', turn))), ',') AS turns FROM conversations GROUP BY conv_id")
def _(t):
    order = tx.seeded_hash(42, F.col("conv_id"), F.col("turn"))
    turns = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("h"), "turn"))).alias("m"))
    return turns.select("conv_id", F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ",").alias("turns"))


@check("f8_train_eval_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('3:', doc_id)), doc_id) <= 64 THEN 'eval' ELSE 'train' END AS part FROM documents")
def _(t):
    train, held_out = indexing.train_eval_split(t.raw("documents").select("doc_id"), 64, 3, "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(held_out.withColumn("part", F.lit("eval")))


@check("e6_shuffled_chunks", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS index, (row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1) // 20 AS chunk FROM documents")
def _(t):
    return indexing.chunks(indexing.shuffled_index(t.raw("documents").select("doc_id"), 42, "doc_id"), 20)


@check("e8_numbered_listing", "SELECT conv_id, count(*) AS members, string_agg(s, chr(10) ORDER BY turn) AS listing FROM (SELECT conv_id, turn, concat('### Question #', row_number() OVER w, chr(10), role, chr(10), chr(10), '### Answer #', row_number() OVER w, chr(10), text, chr(10)) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id")
def _(t):
    listing = indexing.numbered_listing(t.raw("conversations"), ["conv_id"], ["turn"], [("Question", "role"), ("Answer", "text")])
    return listing.withColumn("members", F.col("members").cast("bigint"))


# ---- battles -----------------------------------------------------------------------------------

SIDES = "(SELECT question, model_a AS model, answer_a AS answer, battle_id * 2 AS o FROM battles UNION ALL SELECT question, model_b, answer_b, battle_id * 2 + 1 FROM battles)"
PREFERENCE = ["m3", "m1", "m5", "m0"]
LAST = f"(SELECT question, model, arg_max(answer, o) AS answer FROM {SIDES} GROUP BY ALL)"


@check("e7_last_answer", f"SELECT question, model, answer FROM {LAST}")
def _(t):
    return corpora.last_answers(t.battles())


@check("c13_preferred_answer", f"SELECT question, arg_min(answer, list_position(['m3', 'm1', 'm5', 'm0'], model)) AS response FROM {LAST} WHERE model IN ('m3', 'm1', 'm5', 'm0') GROUP BY question")
def _(t):
    return corpora.preferred_answers(corpora.last_answers(t.battles()), PREFERENCE)


@check("b15_picked_only", f"SELECT q.question, p.response FROM (SELECT DISTINCT question FROM battles) q JOIN (SELECT question, arg_min(answer, list_position(['m3', 'm1'], model)) AS response FROM {LAST} WHERE model IN ('m3', 'm1') GROUP BY question) p USING (question)")
def _(t):
    picks = corpora.preferred_answers(corpora.last_answers(t.battles()), ["m3", "m1"])
    return filters.picked_only(t.battles().select("question").distinct().join(picks, "question", "left"), "response")


@check("i14_arena_corpus", f"SELECT question AS instruction, arg_min(answer, list_position(['m3', 'm1', 'm5', 'm0'], model)) AS response FROM {LAST} WHERE model IN ('m3', 'm1', 'm5', 'm0') GROUP BY question")
def _(t):
    return corpora.arena_corpus(t.battles(), PREFERENCE)


WINS = """
(SELECT model_a, model_b, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT model_a, model_b, 2 AS w FROM battles WHERE winner = 'model_a'
  UNION ALL SELECT model_b, model_a, 2 FROM battles WHERE winner = 'model_b' UNION ALL SELECT model_a, model_b, 1 FROM battles WHERE starts_with(winner, 'tie')
  UNION ALL SELECT model_b, model_a, 1 FROM battles WHERE starts_with(winner, 'tie')) GROUP BY ALL)"""


@check("d19_pairwise_wins", f"SELECT * FROM {WINS}")
def _(t):
    return ratings.pairwise_wins(t.battles())


def rated(t):
    return ratings.bradley_terry(cut_lineage(ratings.pairwise_wins(t.battles())))


# Minorise-maximise steps from equal strengths; ratings have mean 1000 as an unpenalised fit from zero has.
MM = f"""
WITH RECURSIVE wins AS MATERIALIZED {WINS},
n AS MATERIALIZED (SELECT a.model_a, a.model_b, a.weight + b.weight AS n FROM wins a JOIN wins b ON a.model_a = b.model_b AND a.model_b = b.model_a),
total AS MATERIALIZED (SELECT model_a AS model, sum(weight) AS w FROM wins GROUP BY model_a),
fit AS (SELECT 0 AS i, model, CAST(1 AS DOUBLE) AS p FROM total
  UNION ALL SELECT f.i + 1, t.model, t.w / sum(n.n / (f.p + g.p)) FROM fit f JOIN fit g ON f.i = g.i JOIN n ON n.model_a = f.model AND n.model_b = g.model JOIN total t ON t.model = f.model WHERE f.i < 60 GROUP BY f.i, t.model, t.w),
r AS (SELECT model, 400 * (log10(p) - avg(log10(p)) OVER ()) + 1000 AS rating FROM fit WHERE i = 60)"""


@check("d20_bradley_terry", MM + " SELECT model, round(rating, 2) AS rating FROM r")
def _(t):
    return rated(t).withColumn("rating", F.round("rating", 2))


@check("f2_rating_table", MM + " SELECT model, round(rating, 2) AS rating, CAST(row_number() OVER (ORDER BY rating DESC) AS INT) AS rank FROM r")
def _(t):
    return ratings.rating_table(rated(t)).withColumn("rating", F.round("rating", 2))


# ---- text functions ----------------------------------------------------------------------------


@check("h11_lines", f"SELECT doc_id, len(l) AS lines, l[1] AS first, l[-1] AS last FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{SPACE}')), lambda x: x <> '') AS l FROM documents)")
def _(t):
    found = tx.lines(F.col("text"))
    return t.raw("documents").select("doc_id", found.alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("lines"), F.try_element_at("l", F.lit(1)).alias("first"), F.try_element_at("l", F.lit(-1)).alias("last")
    )


@check("h12_template_fill", "SELECT item_id, concat('Task {x}: ', text, ' (', item_id, ')') AS filled, concat('In: ', text, ' {keep} ', item_id) AS replaced FROM benchmark")
def _(t):
    values = {"input": F.col("text"), "id": F.col("item_id")}
    return t.raw("benchmark").select(
        "item_id",
        tx.fill_template("Task {{x}}: {input} ({id})", values).alias("filled"),
        tx.replace_template("In: {input} {keep} {id}", values).alias("replaced"),
    )


@check("h13_chat_messages", f"""
SELECT conv_id, turn, 3 AS messages, 'system' AS role_1, 'example_' || role AS name, trim(text, '{SPACE}') AS content_2, trim(role, '{SPACE}') AS role_3 FROM conversations""")
def _(t):
    body = F.concat(
        F.lit("\n<|im_start|>system name=example_"), "role", F.lit(" kind=a=b\nBe brief.\n<|im_end|>\n<|im_start|>user\n"), "text",
        F.lit("\n<|im_end|> \n<|im_start|>"), "role", F.lit("\nok<|im_end|>\n"),
    )
    m = F.col("m")
    return t.raw("conversations").select("conv_id", "turn", tx.chat_messages(body).alias("m")).select(
        "conv_id", "turn", F.size(m).alias("messages"), m[0]["role"].alias("role_1"), m[0]["attributes"]["name"].alias("name"),
        m[1]["content"].alias("content_2"), m[2]["role"].alias("role_3"),
    )


# Fixed value: the task suffix, written out so that the SQL does not depend on the library.
@check("h18_training_messages", "SELECT conv_id, concat('<|im_start|>user', chr(10), text_0, chr(10), 'Please reason step by step, and put your final answer within \\boxed{}.<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), text_1, '<|im_end|>') AS rendered FROM first_turns WHERE turns >= 2")
def _(t):
    both = t.first_turns().filter("turns >= 2")
    return both.select("conv_id", tx.render_messages(tx.training_messages(F.col("text_0"), F.col("text_1"))).alias("rendered"))


def words(column):
    return F.transform(F.split(column, " "), lambda w: F.length(w))


@check("h19_masked_batches", """
WITH r AS (SELECT conv_id, list_transform(string_split(concat(text_0, ' ', text_1), ' '), lambda x: length(x)) AS ids, len(string_split(text_0, ' ')) AS n, conv_id // 8 AS batch FROM first_turns WHERE turns >= 2),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM r)
SELECT conv_id, longest AS width, CAST(list_sum(ids) AS BIGINT) AS token_sum, longest - len(ids) + n AS ignored, CAST(len(list_filter(ids, lambda x: x <> 0)) AS BIGINT) AS attended FROM m""")
def _(t):
    both = t.first_turns().filter("turns >= 2")
    rows = both.select(
        "conv_id", F.floor(F.col("conv_id") / 8).alias("batch"), words(F.concat_ws(" ", "text_0", "text_1")).alias("tokens"), F.size(F.split("text_0", " ")).alias("n")
    ).withColumn("labels", corpora.masked_labels(F.col("tokens"), F.col("n")))
    add = lambda a, x: a + x
    return corpora.padded_batches(rows, "batch", 0).select(
        "conv_id", F.size("tokens").cast("bigint").alias("width"),
        F.aggregate("tokens", F.lit(0).cast("int"), add).cast("bigint").alias("token_sum"),
        F.size(F.filter("labels", lambda x: x == corpora.IGNORED)).cast("bigint").alias("ignored"),
        F.aggregate("attention_mask", F.lit(0).cast("int"), add).cast("bigint").alias("attended"),
    )


@check("h20_output_fix", "SELECT doc_id, CASE WHEN lang = 'en' THEN concat(chr(10), text) ELSE text END AS output FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", tx.fix_output(F.col("text"), F.col("lang"), ("en",)).alias("output"))


@check("h21_embedding_text", "SELECT item_id, concat('The model has the following skill or capability: ', text) AS embedding_text FROM benchmark")
def _(t):
    return t.raw("benchmark").select("item_id", tx.embedding_text(F.col("text"), "skill").alias("embedding_text"))


# ---- model calls, with deterministic stand-ins for the model -------------------------------------


def length_provider():
    def provider(texts):
        return [{"response": "YES" if len(x) % 2 == 0 else "NO", "prompt_tokens": len(x), "completion_tokens": 1} for x in texts]

    return provider


def digest_provider():
    def provider(texts):
        import hashlib

        return [{"response": " " + hashlib.md5(x.encode()).hexdigest() + "\n", "prompt_tokens": len(x), "completion_tokens": 32} for x in texts]

    return provider


@check("j1_batch_completion", "SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'YES' ELSE 'NO' END AS response, length(text) AS prompt_tokens, CAST(1 AS BIGINT) AS completion_tokens, false AS failed FROM documents")
def _(t):
    return inference.complete(t.raw("documents").select("doc_id", F.col("text").alias("prompt")), length_provider()).drop("prompt")


@check("j2_batch_embedding", "SELECT item_id, 2 AS dimensions, CAST(length(text) AS DOUBLE) AS first, length(text) AS prompt_tokens FROM benchmark")
def _(t):
    def provider(texts):
        return [{"embedding": [float(len(x)), 1.0], "prompt_tokens": len(x)} for x in texts]

    embedded = inference.embed(t.raw("benchmark"), provider)
    return embedded.select("item_id", F.size("embedding").alias("dimensions"), F.element_at("embedding", 1).cast("double").alias("first"), "prompt_tokens")


@check("j3_batch_moderation", "SELECT doc_id, CASE WHEN length(text) % 5 > 0 THEN length(text) > 1000 END AS flagged FROM documents")
def _(t):
    def provider(texts):
        if any(len(x) % 5 == 0 for x in texts):
            raise RuntimeError("refused")
        return [{"moderation": {"flagged": len(x) > 1000, "score": 0.5}} for x in texts]

    return inference.moderate(t.raw("documents").select("doc_id", "text"), provider).select("doc_id", "moderation.flagged")


@check("d22_usage_cost", "SELECT CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'text-embedding-3-small' END AS model, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, round(sum(length(text)) / 1e6 * CASE conv_id % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 0.15 ELSE 0.02 END + sum(turn) / 1e6 * CASE conv_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 0.6 ELSE 0 END, 9)::DOUBLE AS cost FROM conversations GROUP BY conv_id % 3")
def _(t):
    kind = F.col("conv_id") % 3
    usage = t.raw("conversations").select(
        F.when(kind == 0, "gpt-4o").when(kind == 1, "gpt-4o-mini").otherwise("text-embedding-3-small").alias("model"),
        F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"),
    )
    return inference.usage_cost(usage).withColumn("cost", F.round("cost", 9))


@check("a11_annotation_cache", """
WITH caps AS (SELECT DISTINCT capability FROM profile),
grid AS (SELECT capability, instance_id, concat(capability, ' / ', c_name, ' / ', c_mktsegment) AS prompt FROM caps, tree_leaf JOIN customer ON c_custkey = instance_id)
SELECT capability, instance_id, label FROM association
UNION ALL SELECT capability, instance_id, CASE WHEN length(prompt) % 2 = 0 THEN 'YES' ELSE 'NO' END FROM grid ANTI JOIN association USING (capability, instance_id)""")
def _(t):
    instances = t.raw("customer").select(F.col("c_custkey").alias("instance_id"), F.col("c_name").alias("input"), F.col("c_mktsegment").alias("output"))
    wanted = t.profile().select("capability")
    return inference.annotate(wanted, instances, t.association(), "{capability} / {input} / {output}", length_provider())


def octal_leaves(t):
    """Customers as a tree of eight children per node, as deep as their number asks for."""
    key = F.col("c_custkey")
    top = t.raw("customer").agg(F.max("c_custkey")).first()[0]
    depth = max(1, len(oct(int(top))) - 2)
    steps = [F.floor(key / 8**i) % 8 for i in range(depth - 1, 0, -1)]
    path = F.array(*[s.cast("int") for s in steps]) if steps else F.array().cast("array<int>")
    return t.raw("customer").select(F.lit("t").alias("tree_id"), path.alias("path"), key.alias("instance_id"), F.col("c_name").alias("text"))


OCTAL_PROMPT = "concat(len(l), ' skills:', chr(10), array_to_string(list_transform(l, lambda x, i: concat('### Skill #', i, chr(10), x, chr(10))), chr(10)))"


@check("i8_node_descriptions", f"""
WITH RECURSIVE top AS (SELECT length(format('{{:o}}', max(c_custkey))) AS d FROM customer),
nodes AS (
  SELECT d - 1 AS depth, c_custkey // 8 AS m, list(c_name ORDER BY md5(concat('42:', c_custkey)), c_custkey::VARCHAR) AS l FROM customer, top GROUP BY ALL
  UNION ALL
  SELECT depth - 1 AS depth, m // 8 AS m, list(md5({OCTAL_PROMPT}) ORDER BY md5(concat('42:node ', m % 8)), m) AS l FROM nodes WHERE depth > 0 GROUP BY depth - 1, m // 8
)
SELECT CASE WHEN depth = 0 THEN '' ELSE array_to_string(string_split(lpad(format('{{:o}}', m), depth::INTEGER, '0'), ''), '/') END AS path, len(l) AS members, md5({OCTAL_PROMPT}) AS description FROM nodes""")
def _(t):
    described = inference.describe_nodes(octal_leaves(t), "{group_number} skills:\n{skill_descriptions}", digest_provider())
    return described.select(tree.path_text(F.col("path")).alias("path"), "members", "description")


@check("i9_shrunk_capabilities", f"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS capability
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, '{SPACE}')) AS l FROM documents)
),
rounds AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS i, capability, count(*) OVER () AS n FROM found WHERE capability <> ''
  UNION ALL
  SELECT (i // 80) * 20 + i % 80 AS i, capability, (n // 80) * 20 + least(20, n % 80) AS n FROM rounds WHERE n > 20 AND i % 80 < 20
)
SELECT i AS index, capability FROM rounds WHERE n <= 20""")
def _(t):
    """Every line of every document as a capability; the model stand-in answers with the first twenty it is shown."""

    def provider(texts):
        import re

        shown = [[re.sub(r"^\(\d+\) ", "", line) for line in x.split("\n") if re.match(r"\(\d+\) ", line)] for x in texts]
        return [{"response": "\n".join(listed[:20])} for listed in shown]

    rows = t.raw("documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "capability"))
    indexed = indexing.dense_index(rows, F.floor(F.col("doc_id") / 1000), "doc_id", "line")
    return inference.shrink_capabilities(indexed, "Keep {num_capabilities} of {current_num_capabilities}:\n{capability_list}", provider)


def pools(t):
    """Inputs generated per capability and brand, so that a pool stays short."""
    return t.raw("part").groupBy(F.concat_ws(" ", "p_name", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string")).alias("capability")).agg(
        F.array_sort(F.collect_list(F.concat(F.lit("input "), F.format_string("%012d", "p_partkey")))).alias("inputs")
    )


POOLS = "pools AS (SELECT concat_ws(' ', p_name, p_brand, p_partkey // 1000) AS capability, list(concat('input ', lpad(concat(p_partkey), 12, '0')) ORDER BY p_partkey) AS inputs FROM part GROUP BY 1)"


@check("c9_output_lookup", "SELECT concat('input ', lpad(concat(p_partkey), 12, '0')) AS input, p_type AS output FROM part")
def _(t):
    inputs = pools(t).select(F.explode("inputs").alias("input"))
    return corpora.lookup_outputs(inputs, outputs(t))


def outputs(t):
    return t.raw("part").select(F.concat(F.lit("input "), F.format_string("%012d", "p_partkey")).alias("input"), F.col("p_type").alias("output"))


@check("c14_capability_inputs", f"WITH {POOLS} SELECT capability, 'input ' || substr(input, 7) AS input FROM (SELECT capability, unnest(inputs) AS input FROM pools)")
def _(t):
    instances = t.raw("part").groupBy(F.concat_ws(" ", "p_name", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string")).alias("capability")).agg(
        F.collect_list("p_partkey").alias("instances")
    )
    inputs = t.raw("part").select(F.col("p_partkey").alias("instance_id"), F.concat(F.lit("input "), F.format_string("%012d", "p_partkey")).alias("input"))
    return corpora.capability_inputs(instances, inputs).select("capability", "input")


@check("i15_training_set", f"""
WITH {POOLS}, flat AS (SELECT capability, unnest(inputs) AS input, unnest(range(len(inputs))) AS position FROM pools)
SELECT capability, position, input, concat(chr(10), p_type) AS output FROM (SELECT * FROM flat ORDER BY md5(concat('5:', capability, ':', position)), capability, position LIMIT 128) JOIN part ON concat('input ', lpad(concat(p_partkey), 12, '0')) = input""")
def _(t):
    return corpora.training_set(pools(t), pools(t), outputs(t), "DS-1000", 128, 5).withColumn("position", F.col("position").cast("bigint"))


@check("i16_top_up_prompts", """
WITH have AS (SELECT p_name AS capability, count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND p_size <= 10 GROUP BY p_name),
pool AS (SELECT p_name AS capability, p_partkey AS instance_id, row_number() OVER (PARTITION BY p_name ORDER BY md5(concat('0:', p_partkey)), p_partkey) AS rn FROM part QUALIFY rn <= 320),
size AS (SELECT capability, count(*) AS m FROM pool GROUP BY capability),
draws AS (SELECT capability, m, unnest(range(coalesce(n, 0) + 1, 65)) AS draw FROM size LEFT JOIN have USING (capability)),
slots AS (SELECT capability, m, draw, unnest(range(least(5, m))) AS slot FROM draws),
ex AS (SELECT s.capability, draw, instance_id, ((draw - 1) * 5 + slot) % m + 1 AS rn FROM slots s JOIN pool p ON p.capability = s.capability AND p.rn = ((draw - 1) * 5 + slot) % m + 1),
num AS (SELECT capability, draw, concat('### Question #', row_number() OVER w, chr(10), 'example ', instance_id, chr(10)) AS s, row_number() OVER w AS k FROM ex WINDOW w AS (PARTITION BY capability, draw ORDER BY md5(concat('0:', draw, ':', rn))))
SELECT capability, draw, concat(capability, ' with ', count(*), ' examples:', chr(10), string_agg(s, chr(10) ORDER BY k)) AS prompt FROM num GROUP BY capability, draw""")
def _(t):
    part = t.raw("part")
    members = part.select(F.col("p_name").alias("capability"), F.col("p_partkey").alias("instance_id"), F.concat(F.lit("example "), F.col("p_partkey").cast("string")).alias("input"))
    cached = part.filter("p_type = 'ECONOMY' AND p_size <= 10").select(F.col("p_name").alias("capability"))
    prompts = inference.example_prompts(members, cached, "{capability} with {instance_num} examples:\n{example_inputs}")
    return prompts.withColumn("draw", F.col("draw").cast("bigint"))
