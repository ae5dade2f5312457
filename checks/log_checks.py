"""Queries of the log half: A1-A3, A7, A9, A10, B1-B6, B13, C2, C3, C12, D1-D7, E1, F3, H1-H4, I17, I18."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.functions.answers import answer_position, choice_array, choice_position
from skillgauge.functions.metrics import round3
from skillgauge.functions.text import configuration_label, file_stem, safe_file_name, short_model_name
from skillgauge.operators import filters, robustness
from skillgauge.plans import questions
from skillgauge.session import cut_lineage, scratch_path
from skillgauge.sources import logs, sinks

CONFIG = robustness.CONFIGURATION
COPY_ORDER = ["sample_index", "choices_order", "enumerator", "score", "raw_input", "closest_answer"]
KEYS = ["sample_index", *CONFIG]


def clean(t):
    return robustness.dedup_first(t.eval_log(), ["evaluation_id", *CONFIG], COPY_ORDER)


def kept(t):
    return filters.drop_biased_orders(clean(t))


def scores(t):
    return robustness.question_robustness(kept(t), KEYS)


def written_log(t):
    path = scratch_path(t.spark, "log")
    log = t.eval_log().withColumns({"model_folder": short_model_name(F.col("model")), "benchmark": F.col("dataset")})
    sinks.write_partitions(log, path, ["model_folder", "language", "shots", "benchmark"])
    return path, log.schema


def laid_out(t, models, shots, datasets=(None,)):
    """The log as `{model}/{language}/{shots}_shot/{benchmark}.parquet`; without datasets one file holds them all."""
    base, staged = scratch_path(t.spark, "layout"), scratch_path(t.spark, "staged")
    # The log is joined once; each file is a narrow copy of its rows.
    log = t.eval_log().drop("language")
    log.filter(F.col("model").isin(list(models)) & F.col("shots").isin(list(shots))).write.parquet(staged)
    log = t.spark.read.schema(log.schema).parquet(staged)
    for model in models:
        for n in shots:
            for dataset in datasets:
                rows = log.filter((F.col("model") == model) & (F.col("shots") == n))
                rows = rows if dataset is None else rows.filter(F.col("dataset") == dataset)
                rows.write.parquet(f"{base}/{model.rsplit('/', 1)[-1]}/en/{n}_shot/{dataset or 'all'}.parquet")
    return base


LOG_COLUMNS = "evaluation_id, sample_index, model, language, dataset, shots, choices_order, enumerator, score, raw_input, closest_answer"
SLICE = ["evaluation_id", "sample_index", "model", "dataset", "shots", "score"]


@check("a1_layout_scan", f"SELECT {', '.join(SLICE)} FROM eval_log WHERE model = 'org/model-a' AND language = 'en' AND shots = 5 AND dataset IN ('mmlu.economy', 'mmlu.promo')")
def _(t):
    base = laid_out(t, ["org/model-a", "org/model-b"], [5], ["mmlu.economy", "mmlu.promo", "mmlu.small"])
    # One benchmark that is asked for has no file.
    wanted = ["mmlu.economy.parquet", "mmlu.promo.parquet", "mmlu.absent.parquet"]
    return logs.scan_layout(t.spark, base, "org/model-a", "en", 5, wanted, t.eval_log().schema).select(*SLICE)


@check("a1_partition_scan", f"SELECT {', '.join(SLICE)} FROM eval_log WHERE model = 'org/model-a' AND language = 'en' AND shots = 5 AND dataset IN ('mmlu.economy', 'mmlu.promo')")
def _(t):
    path, schema = written_log(t)
    slice_ = logs.scan_partitions(t.spark, path, schema, "org/model-a", "en", 5, ["mmlu.economy.parquet", "mmlu.promo.parquet"])
    return slice_.select(*SLICE)


@check("a2_file_name_scan", f"SELECT {', '.join(SLICE)} FROM eval_log WHERE model = 'org/model-b' AND shots = 0 AND dataset IN ('mmlu.small', 'mmlu.large')")
def _(t):
    path = scratch_path(t.spark, "files")
    log = t.eval_log()
    name = F.concat_ws("_", short_model_name(F.col("model")), F.concat(F.lit("shots"), F.col("shots").cast("string")), "dataset")
    sinks.write_partitions(log.withColumn("file", name), path, ["file"])
    found = logs.scan_matching_files(t.spark, path, log.schema, "org/model-b", 0, ["mmlu.small", "mmlu.large"])
    return found.select(*SLICE)


@check("a3_single_file_scan", "SELECT dataset, sample_index, count(*) AS \"rows\", sum(score) AS total_score FROM eval_log WHERE model = 'org/model-c' AND shots = 0 AND dataset = 'mmlu.promo' GROUP BY ALL")
def _(t):
    base = scratch_path(t.spark, "single")
    slice_ = filters.select_runs(t.eval_log(), "org/model-c", 0, ["mmlu.promo"])
    sinks.write_single_file(slice_.withColumn("generated_text", F.col("raw_input")), base, "model-c", 0, "mmlu.promo")
    log = logs.scan_single_file(t.spark, base, "model-c", 0, "mmlu.promo")
    return log.groupBy("dataset", "sample_index").agg(F.count("*").alias("rows"), F.sum("score").alias("total_score"))


@check("a7_benchmark_catalogue", """
WITH named AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'mmlu.economics' WHEN 'LARGE' THEN 'mmlu_pro.law'
    WHEN 'MEDIUM' THEN 'race.high' WHEN 'PROMO' THEN 'hellaswag' WHEN 'SMALL' THEN 'unlisted.small' ELSE 'social_iqa' END AS dataset FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p_partkey) AS rn FROM named)
SELECT p_partkey, dataset,
  CASE dataset WHEN 'mmlu.economics' THEN 'cais/mmlu' WHEN 'mmlu_pro.law' THEN 'TIGER-Lab/MMLU-Pro' WHEN 'race.high' THEN 'ehovy/race'
       WHEN 'hellaswag' THEN 'Rowan/hellaswag' ELSE 'allenai/social_i_qa' END AS source,
  CASE dataset WHEN 'mmlu.economics' THEN 'all' WHEN 'mmlu_pro.law' THEN 'law' WHEN 'race.high' THEN 'high' ELSE 'default' END AS subset,
  CASE dataset WHEN 'social_iqa' THEN 'validation' ELSE 'test' END AS split
FROM ranked WHERE dataset <> 'unlisted.small' AND (dataset = 'mmlu.economics' OR rn <= 110)""")
def _(t):
    kind = F.col("p_type")
    named = t.raw("part").select(
        "p_partkey",
        F.when(kind == "ECONOMY", "mmlu.economics").when(kind == "LARGE", "mmlu_pro.law").when(kind == "MEDIUM", "race.high")
        .when(kind == "PROMO", "hellaswag").when(kind == "SMALL", "unlisted.small").otherwise("social_iqa").alias("dataset"),
    )
    return logs.with_benchmark_source(named, "p_partkey", capped=True).select("p_partkey", "dataset", "source", "subset", "split")


@check("a9_partitioned_sink", "SELECT 'org_repo' AS repo, language, shots, regexp_replace(model, '.*/', '') AS model_folder, dataset AS benchmark, count(*) AS \"rows\", sum(average_score) AS total FROM question_scores WHERE average_score < 0.5 GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "results")
    sinks.write_by_configuration(questions.low_performing_questions(t.eval_log()), path, "org/repo")
    back = t.spark.read.parquet(path)
    return back.groupBy("repo", "language", "shots", "model_folder", "benchmark").agg(
        F.count("*").alias("rows"), F.bround(F.sum("average_score"), 6).alias("total")
    )


@check("a10_skip_existing_extract", "SELECT model, dataset, count(*) AS \"rows\", sum(score) AS total_score FROM eval_log WHERE model <> 'org/model-c' GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "extract")
    log = t.eval_log()
    first = robustness.configurations(t.spark, ["org/model-a"], ["en"], [0, 5], ["mmlu.economy", "mmlu.promo"])
    datasets = ["mmlu.economy", "mmlu.promo", "mmlu.small", "mmlu.large", "mmlu.medium", "mmlu.standard"]
    every = robustness.configurations(t.spark, ["org/model-a", "org/model-b"], ["en"], [0, 5], datasets)
    for requested in (first, every):
        sinks.extract_missing(log, requested, path, ["model", "dataset"])
    return t.spark.read.parquet(path).groupBy("model", "dataset").agg(
        F.count("*").alias("rows"), F.sum("score").alias("total_score")
    )


@check("b1_drop_columns", "SELECT evaluation_id, sample_index, model, language, dataset, shots, choices_order, enumerator, score FROM eval_log")
def _(t):
    return filters.drop_columns(t.eval_log(), ["raw_input", "closest_answer", "cumulative_logprob"])


@check("b2_select_runs", f"SELECT {LOG_COLUMNS} FROM eval_log WHERE model = 'org/model-a' AND shots = 0 AND dataset IN ('mmlu.economy', 'mmlu.large')")
def _(t):
    return filters.select_runs(t.eval_log(), "org/model-a", 0, ["mmlu.economy.parquet", "mmlu.large.parquet"])


@check("b3_select_dimensions", f"SELECT {LOG_COLUMNS} FROM eval_log WHERE model = 'org/model-b' AND shots = 5 AND dataset = 'mmlu.medium' AND enumerator = 'roman' AND choices_order = 'random'")
def _(t):
    return filters.select_runs(
        t.eval_log(), "org/model-b", 5, ["mmlu.medium"], enumerator="roman", choices_order="random", separator="none", template="x"
    )


@check("b4_select_runs_older", "SELECT evaluation_id, sample_index, model, shots, dataset, enumerator AS template, choices_order FROM eval_log WHERE model = 'org/model-c' AND shots = 0 AND dataset = 'mmlu.small' AND enumerator = 'numbers' AND choices_order = 'random'")
def _(t):
    older = t.eval_log().select("evaluation_id", "sample_index", "model", "shots", "dataset", F.col("enumerator").alias("template"), "choices_order")
    return filters.select_runs_older(older, "org/model-c", 0, "mmlu.small", template="numbers", choices_order="random")


@check("b5_few_shot_orders", f"SELECT {LOG_COLUMNS} FROM eval_log WHERE shots IS DISTINCT FROM 5 OR choices_order IS NULL OR choices_order NOT IN ('correct_first', 'correct_last')")
def _(t):
    return filters.drop_biased_orders(t.eval_log())


@check("b6_low_performers", "SELECT model, dataset, shots, sample_index, average_score FROM question_scores WHERE average_score < 0.1")
def _(t):
    return filters.low_performers(scores(t), 0.1).select("model", "dataset", "shots", "sample_index", "average_score")


@check("b13_mapped_answers", "SELECT evaluation_id, model, shots, sample_index, position('ABCD' IN 'ABCD') + strpos('ABCD', substr(closest_answer, 1, 1)) - 1 AS chosen_position FROM clean_log WHERE substr(closest_answer, 1, 1) <> 'E'")
def _(t):
    rows = clean(t).withColumn("chosen_position", answer_position(F.col("closest_answer")))
    return filters.mapped_answers(rows).select(
        "evaluation_id", "model", "shots", "sample_index", F.col("chosen_position").cast("bigint").alias("chosen_position")
    )


@check("c2_example_lookup", "SELECT evaluation_id, model, dataset, shots, sample_index, nullif(list_position(choices, substr(closest_answer, strpos(closest_answer, '. ') + 2)), 0)::INT AS chosen_position FROM clean_log JOIN choices USING (dataset, sample_index) WHERE chosen_position IS NOT NULL")
def _(t):
    rows = robustness.examples_for_rows(clean(t), t.choices())
    return rows.select("evaluation_id", "model", "dataset", "shots", "sample_index", "chosen_position")


@check("c3_rows_of_low_performers", "SELECT evaluation_id, model, dataset, shots, sample_index, score FROM kept_log SEMI JOIN (SELECT * FROM question_scores WHERE average_score < 0.1) USING (model, language, dataset, shots, sample_index)")
def _(t):
    rows = kept(t)
    low = filters.low_performers(robustness.question_accuracy(rows, KEYS), 0.1, "accuracy")
    return robustness.keep_low_rows(rows, low, KEYS).select("evaluation_id", "model", "dataset", "shots", "sample_index", "score")


def grid(t):
    return robustness.configurations(
        t.spark, ["org/model-a", "org/model-b", "org/model-z"], ["en"], [0, 5], ["mmlu.economy.parquet", "mmlu.large.parquet", "mmlu.absent.parquet"]
    )


GRID = "SELECT m.model, 'en' AS language, s.shots, d.dataset FROM (VALUES ('org/model-a'), ('org/model-b'), ('org/model-z')) m(model), (VALUES (0), (5)) s(shots), (VALUES ('mmlu.economy'), ('mmlu.large'), ('mmlu.absent')) d(dataset)"


@check("c12_requested_configurations", f"SELECT model, dataset, shots, count(*) AS \"rows\" FROM eval_log SEMI JOIN ({GRID}) USING (model, language, shots, dataset) GROUP BY ALL")
def _(t):
    return robustness.restrict_to(t.eval_log(), grid(t)).groupBy("model", "dataset", "shots").agg(F.count("*").alias("rows"))


@check("d1_question_robustness", "SELECT model, dataset, shots, sample_index, total_score, instance_count, average_score, question FROM question_scores")
def _(t):
    table = cut_lineage(scores(t))
    return table.join(questions.question_texts(t.eval_log(), table), KEYS, "left").select(
        "model", "dataset", "shots", "sample_index", "total_score", "instance_count", "average_score", "question"
    )


@check("d2_question_accuracy", "SELECT model, dataset, shots, sample_index, sum(score) AS correct_count, count(score) AS total_count, CAST(round_even(sum(score) / count(score), 3) AS DOUBLE) AS accuracy FROM kept_log GROUP BY ALL")
def _(t):
    return robustness.question_accuracy(kept(t), KEYS).drop("language")


@check("d3_model_counts", "SELECT model, count(*) AS \"rows\" FROM eval_log GROUP BY model")
def _(t):
    return robustness.model_counts(t.eval_log())


@check("d4_question_configurations", "SELECT sample_index, count(*) AS configurations, sum(score) AS total_score FROM kept_log GROUP BY sample_index")
def _(t):
    return robustness.question_configurations(kept(t))


@check("d5_low_performer_summary", "SELECT min(average_score) AS min_score, max(average_score) AS max_score, count(*) FILTER (average_score < 0.5) AS low_count, count(*) AS total_count, avg(CASE WHEN average_score < 0.5 THEN 1 ELSE 0 END) AS low_share FROM question_scores")
def _(t):
    return robustness.low_performer_summary(scores(t), 0.5)


@check("d6_configuration_status", f"""
WITH grid AS ({GRID}), loaded AS (SELECT model, language, shots, dataset, count(*) AS n FROM clean_log GROUP BY ALL),
kept AS (SELECT model, language, shots, dataset, count(*) AS n FROM kept_log GROUP BY ALL),
grouped AS (SELECT model, language, shots, dataset, count(*) AS n, count(*) FILTER (average_score < 0.5) AS low FROM question_scores GROUP BY ALL)
SELECT model, dataset, shots, coalesce(kept.n, 0) AS initial_rows, coalesce(grouped.n, 0) AS grouped_samples, coalesce(low, 0) AS low_performer_samples,
  CASE WHEN loaded.n IS NULL THEN 'empty' WHEN kept.n IS NULL THEN 'empty_after_filters' WHEN grouped.n IS NULL THEN 'no_samples_after_grouping'
       WHEN low = 0 THEN 'no_low_performers' ELSE 'success' END AS status
FROM grid LEFT JOIN loaded USING (model, language, shots, dataset) LEFT JOIN kept USING (model, language, shots, dataset) LEFT JOIN grouped USING (model, language, shots, dataset)""")
def _(t):
    return robustness.configuration_status(clean(t), grid(t), 0.5).select(
        "model", "dataset", "shots", "initial_rows", "grouped_samples", "low_performer_samples", "status"
    )


@check("d6_status_counts", f"""
WITH grid AS ({GRID}), s AS (SELECT model, language, shots, dataset, count(*) FILTER (average_score < 0.1) AS low FROM question_scores GROUP BY ALL)
SELECT CASE WHEN low IS NULL THEN 'empty' WHEN low = 0 THEN 'no_low_performers' ELSE 'success' END AS status, count(*) AS configurations
FROM grid LEFT JOIN s USING (model, language, shots, dataset) GROUP BY ALL""")
def _(t):
    log = t.eval_log()
    status = robustness.configuration_status(clean(t), grid(t), 0.1)
    return robustness.status_counts(robustness.answer_status(status, questions.low_performing_answers(log)))


@check("d6_failed_files", f"""
WITH grid AS ({GRID}), loaded AS (SELECT model, language, shots, dataset, count(*) AS n FROM clean_log GROUP BY ALL),
kept AS (SELECT model, language, shots, dataset, count(*) AS n FROM kept_log GROUP BY ALL),
grouped AS (SELECT model, language, shots, dataset, count(*) AS n, count(*) FILTER (average_score < 0.5) AS low FROM question_scores GROUP BY ALL)
SELECT model, dataset, shots, coalesce(loaded.n, 0)::BIGINT AS loaded,
  CASE WHEN model = 'org/model-z' AND shots = 5 AND dataset = 'mmlu.large' THEN 'error' WHEN loaded.n IS NULL THEN 'empty' WHEN kept.n IS NULL THEN 'empty_after_filters'
       WHEN grouped.n IS NULL THEN 'no_samples_after_grouping' WHEN low = 0 THEN 'no_low_performers' ELSE 'success' END AS status
FROM grid LEFT JOIN loaded USING (model, language, shots, dataset) LEFT JOIN kept USING (model, language, shots, dataset) LEFT JOIN grouped USING (model, language, shots, dataset)""")
def _(t):
    """A broken file among good ones: its configuration says `error`, all others have their results."""
    base = laid_out(t, ["org/model-a", "org/model-b"], [0, 5])
    t.spark.range(1).selectExpr("'this is no table'").write.text(f"{base}/model-z/en/5_shot/mmlu.large.parquet")
    schema = t.eval_log().drop("language").schema
    log = logs.scan_layout(t.spark, base, schema=schema, skip_broken=True)
    names = grid(t).select("model", F.regexp_extract("model", "[^/]*$", 0).alias("model_folder")).distinct()
    failed = logs.broken_files(t.spark, base, schema=schema).join(names, "model_folder").select("model", "language", F.col("benchmark").alias("dataset"), "shots", F.lit("error").alias("status"))
    found = robustness.dedup_first(log, ["evaluation_id", *CONFIG], COPY_ORDER)
    return robustness.configuration_status(found, grid(t), 0.5, failed).select("model", "dataset", "shots", "loaded", "status")


@check("d7_extract_totals", "SELECT model, raw_rows, processed_rows, unique_rows FROM (SELECT model, count(*) AS raw_rows, count(DISTINCT evaluation_id) AS unique_rows FROM eval_log GROUP BY model) JOIN (SELECT model, count(*) AS processed_rows FROM kept_log GROUP BY model) USING (model)")
def _(t):
    return robustness.extract_totals(t.eval_log(), kept(t))


@check("e1_dedup_evaluations", f"""
SELECT {LOG_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY model, dataset, shots, sample_index,
  choices_order NULLS FIRST, enumerator, score, raw_input, closest_answer) AS copy FROM eval_log) WHERE copy = 1""")
def _(t):
    order = ["model", "dataset", "shots", *COPY_ORDER]
    return robustness.dedup_first(t.eval_log(), ["evaluation_id"], order)


@check("f3_first_low_performers", "SELECT sample_index, average_score FROM (SELECT sample_index, CAST(round_even(sum(score) / count(score), 3) AS DOUBLE) AS average_score FROM kept_log GROUP BY ALL) WHERE average_score < 0.3 ORDER BY sample_index LIMIT 10")
def _(t):
    table = robustness.question_robustness(kept(t).withColumn("has_text", F.lit(True)))
    return robustness.first_low_performers(table, 10, 0.3).select("sample_index", "average_score")


LABEL_TEXT = "concat(CASE l_linenumber % 7 WHEN 0 THEN 'The answer is ' WHEN 1 THEN ' ' WHEN 2 THEN '''' ELSE '' END, list_extract(['A','b','3','I','δ','@','E','II','iv','X'], CAST(l_orderkey % 10 + 1 AS INT)), CASE l_linenumber % 7 WHEN 2 THEN '''' WHEN 3 THEN '. text: more' WHEN 4 THEN ') text' WHEN 5 THEN ':' ELSE '' END)"
LABEL_CASES = "CASE WHEN label IN ('A') THEN 1 WHEN label = 'b' THEN 2 WHEN label = '3' THEN 3 WHEN label = 'I' THEN {one} WHEN label = 'δ' THEN 4 WHEN label = '@' THEN 2 WHEN label = 'II' THEN 2 END"


def label_text(t):
    line, letters = F.col("l_linenumber") % 7, F.array(*[F.lit(x) for x in ["A", "b", "3", "I", "δ", "@", "E", "II", "iv", "X"]])
    return t.raw("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(
            F.when(line == 0, "The answer is ").when(line == 1, " ").when(line == 2, "'").otherwise(""),
            F.element_at(letters, (F.col("l_orderkey") % 10 + 1).cast("int")),
            F.when(line == 2, "'").when(line == 3, ". text: more").when(line == 4, ") text").when(line == 5, ":").otherwise(""),
        ).alias("answer"),
    )


LABEL_SQL = f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {LABEL_TEXT} AS answer, l_linenumber % 7 AS form, list_extract(['A','b','3','I','δ','@','E','II','iv','X'], CAST(l_orderkey % 10 + 1 AS INT)) AS letter FROM lineitem),
b AS (SELECT *, CASE WHEN form = 5 THEN answer WHEN form = 2 AND length(letter) > 1 THEN answer ELSE letter END AS label FROM a)
SELECT answer, chosen_position, count(*) AS "rows" FROM (SELECT answer, CAST({LABEL_CASES} AS INT) AS chosen_position FROM b) GROUP BY ALL"""


@check("h1_answer_position", LABEL_SQL.replace("{one}", "1"))
def _(t):
    return label_text(t).withColumn("chosen_position", answer_position(F.col("answer"))).groupBy("answer", "chosen_position").agg(F.count("*").alias("rows"))


@check("h1b_answer_position_older", LABEL_SQL.replace("{one}", "NULL"))
def _(t):
    return label_text(t).withColumn("chosen_position", answer_position(F.col("answer"), older_rules=True)).groupBy("answer", "chosen_position").agg(F.count("*").alias("rows"))


@check("h2_choice_position", "SELECT dataset, sample_index, closest_answer, nullif(list_position(choices, substr(closest_answer, strpos(closest_answer, '. ') + 2)), 0)::INT AS chosen_position, count(*) AS \"rows\" FROM eval_log JOIN choices USING (dataset, sample_index) GROUP BY ALL")
def _(t):
    # Equal answers are counted before their position is looked up.
    answers = t.eval_log().groupBy("dataset", "sample_index", "closest_answer").agg(F.count("*").alias("rows"))
    position = choice_position(F.col("closest_answer"), F.col("choices")).alias("chosen_position")
    return answers.join(t.choices(), ["dataset", "sample_index"]).groupBy("dataset", "sample_index", "closest_answer", position).agg(F.sum("rows").alias("rows"))


@check("h3_choice_array", """
SELECT p_partkey, array_to_string(CASE p_type WHEN 'ECONOMY' THEN [p_name, 'text'] WHEN 'LARGE' THEN [p_name, 'ending'] WHEN 'MEDIUM' THEN [p_name, 'option']
  WHEN 'PROMO' THEN [p_name, p_brand, p_type] WHEN 'SMALL' THEN [p_brand, p_name] END, '|') AS choices FROM part""")
def _(t):
    kind, name = F.col("p_type"), F.col("p_name")
    dataset = (
        F.when(kind == "ECONOMY", "ai2_arc.arc_easy").when(kind == "LARGE", "hellaswag").when(kind == "MEDIUM", "mmlu_pro.law")
        .when(kind == "PROMO", "social_iqa").when(kind == "SMALL", "mmlu.anatomy").otherwise("unlisted")
    )
    choices = choice_array(
        dataset, F.array(name, F.lit("text")), F.array(name, F.lit("ending")), F.array(name, F.lit("option")),
        F.array("p_brand", "p_name"), F.array("p_name", "p_brand", "p_type"),
    )
    return t.raw("part").select("p_partkey", F.array_join(choices, "|").alias("choices"))


@check("h4_names", """
SELECT DISTINCT regexp_replace(model, '.*/', '') AS model_short, dataset AS stem, replace(replace(dataset, '/', '_'), '.', '_') AS safe_name,
  concat(regexp_replace(model, '.*/', ''), '_', language, '_', shots, 'shot_', dataset) AS label,
  concat('org_repo/', language, '/Shots_', shots, '/', regexp_replace(model, '.*/', ''), '/', dataset) AS folder FROM eval_log""")
def _(t):
    file = F.concat(F.lit("data/"), "dataset", F.lit(".parquet"))
    model, language, shots = F.col("model"), F.col("language"), F.col("shots")
    return t.eval_log().select(
        short_model_name(model).alias("model_short"),
        file_stem(file).alias("stem"),
        safe_file_name(F.col("dataset")).alias("safe_name"),
        configuration_label(model, language, shots, file).alias("label"),
        logs.output_folder(F.lit("org/repo"), language, shots, model, file).alias("folder"),
    ).distinct()


@check("h8_round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 16, 3) AS DOUBLE) AS rounded FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", round3(F.col("l_quantity") / 16).alias("rounded"))


@check("i17_low_performing_questions", "SELECT model, language, dataset, shots, sample_index, average_score, question FROM question_scores WHERE average_score < 0.5")
def _(t):
    return questions.low_performing_questions(t.eval_log())


@check("i17_from_layout", "SELECT model, language, dataset, shots, sample_index, average_score, question FROM question_scores WHERE average_score < 0.5")
def _(t):
    base = laid_out(t, ["org/model-a", "org/model-b", "org/model-c"], [0, 5])
    log = logs.scan_layout(t.spark, base, schema=t.eval_log().drop("language").schema)
    return questions.low_performing_questions(log)


@check("i18_low_performing_answers", """
SELECT model, language, dataset, shots, sample_index, evaluation_id, closest_answer, CAST(strpos('ABCD', substr(closest_answer, 1, 1)) AS INT) AS chosen_position
FROM kept_log SEMI JOIN (SELECT * FROM question_scores WHERE average_score < 0.1) USING (model, language, dataset, shots, sample_index)
WHERE strpos('ABCD', substr(closest_answer, 1, 1)) > 0""")
def _(t):
    return questions.saved_answers(t.eval_log(), columns=["evaluation_id", "closest_answer"])
