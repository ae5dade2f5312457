"""Writers (A9-A11, A13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skillgauge.functions.text import short_model_name

CONFIGURATION_FOLDERS = ["repo", "language", "shots", "model_folder", "benchmark"]


def with_configuration_folders(results: DataFrame, repo: str) -> DataFrame:
    """The folder columns of A9, from `model`, `language`, `shots` and `dataset`."""
    return results.withColumns(
        {
            "repo": F.lit(repo.replace("/", "_")),
            "model_folder": short_model_name(F.col("model")),
            "benchmark": F.col("dataset"),
        }
    )


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str], mode: str = "overwrite") -> None:
    """Write one folder per partition value.

    The rebalance hint lets the adaptive planner split a hot folder over many tasks and merge small
    ones, so neither one giant task nor a file per task and folder comes out.
    """
    df.hint("rebalance", *partitions).write.mode(mode).partitionBy(*partitions).parquet(path)


def write_by_configuration(results: DataFrame, path: str, repo: str) -> None:
    """Results under repo / language / shots / model / benchmark."""
    write_partitions(with_configuration_folders(results, repo), path, CONFIGURATION_FOLDERS)


def existing_configurations(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """Configurations a partitioned table already holds; an absent table holds none."""
    try:
        return spark.read.schema(schema).parquet(path).select(*keys).distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], schema)
        return empty.select(*keys)


def extract_missing(log: DataFrame, requested: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A10: write the requested configurations that the table at `path` does not hold yet.

    Only the folders written are replaced, so a job that failed half-way can simply be run again.
    """
    spark = log.sparkSession
    done = existing_configurations(spark, path, keys, log.schema.toDDL())
    missing = requested.select(*keys).join(done, list(keys), "left_anti")
    rows = log.join(missing, list(keys), "left_semi")
    (
        rows.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_sorted_json(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines in key order; part files follow each other in that order."""
    df.orderBy(*keys).write.mode("overwrite").json(path)


def write_single_file(df: DataFrame, base: str, model: str, shots: int, dataset: str) -> None:
    """The file layout A3 reads."""
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{model}_shot{shots}_{dataset}.parquet")
