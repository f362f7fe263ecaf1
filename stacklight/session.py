"""The shared work folder: where jobs cut lineage and keep tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on one machine (tests, notebooks) a temporary folder stands in."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CONF} has to name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="stacklight-"))
    return _local[0]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stacklight_path = path
    return out


def is_written(df: DataFrame) -> bool:
    """Is df a table that written() made, so that reading it again costs a scan?"""
    return hasattr(df, "_stacklight_path")


def measured(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, tuple]:
    """written(), and aggregates of the rows, gathered while they are written. With a lost executor a metric may count rows twice, so nothing but an end of a loop hangs on it."""
    seen = Observation()
    out = written(df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(metrics)]), name)
    got = seen.get
    if len(got) < len(metrics):  # a plan without rows has no metrics
        got = out.agg(*[m.alias(f"m{i}") for i, m in enumerate(metrics)]).first().asDict()
    return out, tuple(got[f"m{i}"] for i in range(len(metrics)))


def dropped(*tables: DataFrame | str) -> None:
    """Deletes tables made by written(), or paths, once nothing reads them any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_stacklight_path", None)
        if path:
            spark = SparkSession.getActiveSession()
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
