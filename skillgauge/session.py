"""Session set-up, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Key-like rows of at most a few hundred bytes: under 100 MB in every executor.
BROADCAST_ROWS = 250_000
# The same for tables whose rows vary in size.
BROADCAST_BYTES = 64 * 2**20


def build_session(app_name: str = "skillgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` wins over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in `spark.checkpoint.dir`. Only a local session that names none gets
    a folder of its own; a cluster without the setting is an error, since a folder on one
    machine would not survive the loss of that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="skillgauge-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back.

    For tables that a loop makes from their predecessor: a checkpoint carries over what the optimiser had inferred about its columns,
    which doubles from step to step where new columns are sums of old ones.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast when a count shows that it is small; otherwise leave the join to Spark.

    The count stops at the limit. Meant for narrow key tables that are already materialised.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised `df` for broadcast when its summed row sizes stay below the limit."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= limit else df


_SPLITS: dict[tuple[str, int], bool] = {}


def spread(df: DataFrame, name: str) -> DataFrame:
    """Deal a scan with fewer splits than cores out over the cores.

    A table written as one row group is one split, whatever its size, and everything up to the first
    shuffle would run in one task. A scan with enough splits, as any large table has, passes unchanged.
    The answer is remembered by `name`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if (name, cores) not in _SPLITS:
        _SPLITS[name, cores] = df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if _SPLITS[name, cores] else df
