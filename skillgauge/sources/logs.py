"""Evaluation log sources (A1-A3, A7) and column normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

from skillgauge.functions.text import file_stem, short_model_name
from skillgauge.session import broadcast_if_few, cut_lineage

# Column names of both log generations and the name used here.
LOG_COLUMNS = {
    "dimensions_1: enumerator": "enumerator",
    "dimensions_2: separator": "separator",
    "dimensions_3: choices_order": "choices_order",
    "dimensions_4: instruction_phrasing_text": "instruction_phrasing",
    "dimensions_5: shots": "shots",
}
# Wide columns the analyses never read.
UNUSED_COLUMNS = ["cumulative_logprob", "generated_text", "ground_truth"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("evaluation_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("sample_index", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("raw_input", T.StringType()),
        T.StructField("closest_answer", T.StringType()),
        T.StructField("dimensions_1: enumerator", T.StringType()),
        T.StructField("dimensions_2: separator", T.StringType()),
        T.StructField("dimensions_3: choices_order", T.StringType()),
        T.StructField("dimensions_4: instruction_phrasing_text", T.StringType()),
        T.StructField("dimensions_5: shots", T.IntegerType()),
    ]
)

# Benchmark name or family -> source, subset, split, row cap. A null subset means the
# part of the benchmark name after the first dot.
BENCHMARKS = [
    ("mmlu", "cais/mmlu", "all", "test", None),
    ("mmlu_pro", "TIGER-Lab/MMLU-Pro", None, "test", 110),
    ("ai2_arc.arc_challenge", "allenai/ai2_arc", "ARC-Challenge", "test", 110),
    ("ai2_arc.arc_easy", "allenai/ai2_arc", "ARC-Easy", "test", 110),
    ("hellaswag", "Rowan/hellaswag", "default", "test", 110),
    ("social_iqa", "allenai/social_i_qa", "default", "validation", 110),
    ("openbook_qa", "allenai/openbookqa", "default", "test", 110),
    ("race.high", "ehovy/race", "high", "test", 110),
    ("race.middle", "ehovy/race", "middle", "test", 110),
]


def normalise_columns(log: DataFrame) -> DataFrame:
    """Plain names for the dimension columns; columns of either log generation that are absent stay absent."""
    return log.withColumnsRenamed({old: new for old, new in LOG_COLUMNS.items() if old in log.columns})


def _read_or_empty(spark: SparkSession, schema: T.StructType, paths: Sequence[str], base: str | None, skip_broken: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_broken).lower())
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# Fixed value: folders of the log layout.
_LAYOUT = r"([^/]+)/([^/]+)/([0-9]+)_shot/([^/]+?)(?:\.parquet)?(?:/[^/]*)?$"


def _alternatives(values: str | int | Iterable | None, suffix: str = "") -> str:
    """A path component for any of the values, or for all names."""
    if values is None:
        return f"*{suffix}"
    listed = [values] if isinstance(values, (str, int)) else list(values)
    escaped = [re.sub(r"([{}\[\]*?,\\])", r"\\\1", str(value)) for value in listed]
    return "{" + ",".join(escaped) + "}" + suffix


def _layout_path(base: str, models, languages, shots, benchmarks) -> str:
    folders = None if models is None else [m.rsplit("/", 1)[-1] for m in ([models] if isinstance(models, str) else models)]
    names = None if benchmarks is None else [n.removesuffix(".parquet") for n in ([benchmarks] if isinstance(benchmarks, str) else benchmarks)]
    return "/".join(
        [base.rstrip("/"), _alternatives(folders), _alternatives(languages), _alternatives(shots, "_shot"), _alternatives(names, ".parquet")]
    )


def _place_part(place: Column, n: int) -> Column:
    """The n-th folder of the layout in a file path."""
    return F.regexp_extract(F.url_decode(F.regexp_replace(place, r"\+", "%2B")), _LAYOUT, n)


def broken_files(
    spark: SparkSession,
    base: str,
    models: str | Iterable[str] | None = None,
    languages: str | Iterable[str] | None = None,
    shots: int | Iterable[int] | None = None,
    benchmarks: str | Iterable[str] | None = None,
    schema: T.StructType = LOG_SCHEMA,
) -> DataFrame:
    """model_folder, language, shots, benchmark, file, reason of the files of a layout that are no readable tables.

    One listing and one pass that reads no column shows which files give rows. Only of the rest, empty and broken ones,
    are the marks looked at that begin and end a table file; a file without them is `error`.
    """
    path = _layout_path(base, models, languages, shots, benchmarks)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = listing.load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "model_folder string, language string, shots int, benchmark string, file string, reason string")
    read = _read_or_empty(spark, schema, [path], None, skip_broken=True)
    seen = read.select(F.col("_metadata.file_path").alias("seen")).distinct()
    seen = seen.select(F.url_decode(F.regexp_replace("seen", r"\+", "%2B")).alias("seen"))
    plain = lambda column: F.regexp_replace(column, "^[a-z]+:/+", "/")
    silent = files.select("path").join(seen, plain(F.col("path")) == plain(F.col("seen")), "left_anti")
    # Names of what gave no rows; their contents are read in a second scan of these files alone.
    names = [row["path"] for row in silent.toLocalIterator()]
    if not names:
        suspects = files.limit(0)
    else:
        suspects = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?,\\])", r"\\\1", name) for name in names])
    mark = F.lit(b"PAR1")
    whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    found = suspects.filter(~whole | (F.col("length") < 12))
    return found.select(
        *[_place_part(F.col("path"), n).alias(name) for n, name in ((1, "model_folder"), (2, "language"))],
        _place_part(F.col("path"), 3).cast("int").alias("shots"),
        _place_part(F.col("path"), 4).alias("benchmark"),
        F.col("path").alias("file"),
        F.lit("no table file").alias("reason"),
    )


def scan_layout(
    spark: SparkSession,
    base: str,
    models: str | Iterable[str] | None = None,
    languages: str | Iterable[str] | None = None,
    shots: int | Iterable[int] | None = None,
    benchmarks: str | Iterable[str] | None = None,
    schema: T.StructType = LOG_SCHEMA,
    skip_broken: bool = False,
) -> DataFrame:
    """A1: a log laid out as `{model}/{language}/{shots}_shot/{benchmark}.parquet`, any number of slices in one scan.

    A file that cannot be read fails the job, or with `skip_broken` gives no further rows; `broken_files` names those files.

    Only the asked-for files are listed; those that are not there are skipped, and none at all gives
    an empty result. Model folder, language and shot count come from the path, which wins over columns
    of the file, and so does the benchmark.
    """
    path = _layout_path(base, models, languages, shots, benchmarks)
    log = _read_or_empty(spark, schema, [path], None, skip_broken)
    log = spark.createDataFrame([], schema).withColumn("_file", F.lit("")) if log.isEmpty() else log.withColumn("_file", F.col("_metadata.file_path"))
    # A path is taken apart once per file, not once per row; the pass that lists them reads no column.
    files = cut_lineage(log.select("_file").distinct())
    part = lambda n: _place_part(F.col("_file"), n)
    places = files.select("_file", part(1).alias("_folder"), part(2).alias("_language"), part(3).alias("_shots"), part(4).alias("_benchmark"))
    own = normalise_columns(log.join(broadcast_if_few(cut_lineage(places)), "_file").drop("_file"))
    found = {"model_folder": "_folder", "language": "_language", "shots": "_shots", "benchmark": "_benchmark"}
    return own.drop(*found).withColumnsRenamed({b: a for a, b in found.items()}).withColumn("shots", F.col("shots").cast("int"))


def scan_partitions(
    spark: SparkSession,
    base: str,
    schema: T.StructType,
    model: str | None = None,
    language: str | None = None,
    shots: int | None = None,
    benchmarks: Iterable[str] | None = None,
) -> DataFrame:
    """A1 over partition folders `model_folder=/language=/shots=/benchmark=`: the filters prune folders.

    Leave arguments out to read many slices in one job.
    """
    log = _read_or_empty(spark, schema, [base], base)
    if model is not None:
        log = log.filter(F.col("model_folder") == model.rsplit("/", 1)[-1])
    if language is not None:
        log = log.filter(F.col("language") == language)
    if shots is not None:
        log = log.filter(F.col("shots") == shots)
    if benchmarks is not None:
        log = log.filter(F.col("benchmark").isin([name.removesuffix(".parquet") for name in benchmarks]))
    return log


def scan_matching_files(
    spark: SparkSession,
    base: str,
    schema: T.StructType,
    model: str | None = None,
    shots: int | None = None,
    datasets: Sequence[str] | None = None,
) -> DataFrame:
    """A2: read the files whose path holds the model name, `shots{n}` and any of the dataset names.

    The path is file metadata, so files that do not match are never opened.
    """
    log = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
    path = F.col("_metadata.file_path")
    if model is not None:
        log = log.filter(path.contains(model.rsplit("/", 1)[-1]))
    if shots is not None:
        log = log.filter(path.contains(f"shots{shots}"))
    if datasets is not None:
        any_name = F.lit(False)
        for name in datasets:
            any_name = any_name | path.contains(name.rsplit("/", 1)[-1])
        log = log.filter(any_name)
    return log.drop(*UNUSED_COLUMNS)


def scan_single_file(
    spark: SparkSession, base: str, model: str, shots: int, dataset: str, drop: bool = True
) -> DataFrame:
    """A3: `{model}_shot{n}_{dataset}.parquet`, without the unused columns unless asked for."""
    log = spark.read.parquet(f"{base.rstrip('/')}/{model}_shot{shots}_{dataset}.parquet")
    return log.drop("family", "generated_text", "ground_truth") if drop else log


def benchmark_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed catalogue, nine rows."""
    return spark.createDataFrame(
        BENCHMARKS, "name string, source string, subset string, split string, row_cap int"
    )


def with_benchmark_source(examples: DataFrame, order: str, dataset: str = "dataset", capped: bool = False) -> DataFrame:
    """Attach source, subset and split to each example, and with `capped` keep the first rows up to the cap of its source.

    A name matches a catalogue entry when equal to it or continued by a dot. Examples of unknown
    benchmarks are dropped.
    """
    spark = examples.sparkSession
    name = F.col(dataset)
    parts = F.split(name, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    # The catalogue is nine fixed rows.
    known = (
        examples.select(name.alias(dataset))
        .distinct()
        .withColumn("name", F.explode(prefixes))
        .join(F.broadcast(benchmark_catalogue(spark)), "name")
        .withColumn("subset", F.coalesce("subset", F.substring(name, F.instr(name, ".") + 1, F.length(name))))
        .drop("name")
    )
    if not capped:
        return examples.join(known, dataset)
    ranked = examples.join(known, dataset).withColumn(
        "_row", F.row_number().over(W.partitionBy(dataset).orderBy(order))
    )
    largest_cap = max(cap for *_, cap in BENCHMARKS if cap is not None)
    capped = ranked.filter(F.col("row_cap").isNotNull() & (F.col("_row") <= largest_cap)).filter("_row <= row_cap")
    whole = examples.join(known.filter("row_cap IS NULL"), dataset)
    return capped.drop("_row").unionByName(whole)


def output_folder(repo: Column, language: Column, shots: Column, model: Column, benchmark: Column) -> Column:
    """Folder of one configuration's results."""
    return F.concat_ws(
        "/",
        F.replace(repo, F.lit("/"), F.lit("_")),
        language,
        F.concat(F.lit("Shots_"), shots.cast("string")),
        short_model_name(model),
        file_stem(benchmark),
    )
