"""Session settings and the staging helpers shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Largest dimension (rows) that is ever broadcast; anything bigger is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def build_session(master: str | None = None, app: str = "flowrisk", **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written stages: the cluster's ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, is a temporary folder used.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.TemporaryDirectory(prefix="flowrisk-")
    return _local_dirs[sc.applicationId].name


def write_table(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage of iterative jobs and of relations that several branches read. The
    files outlive executors, are computed once, and give readers column pruning, filter
    pushdown and a known size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowrisk/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_stages: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived relation that several queries read, written once per application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _stages:
        _stages[full] = write_table(build(), key[-1])
    return _stages[full]


def has_stage(spark: SparkSession, key: tuple) -> bool:
    return (spark.sparkContext.applicationId, *key) in _stages


def forget_stages() -> None:
    """Build all stages anew on their next use."""
    _stages.clear()
