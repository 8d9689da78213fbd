"""Session set-up, the shared scratch folder, and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "lectern", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with the settings every operator here is written for.

    On a cluster the submitter sets master, memory and ``spark.checkpoint.dir``;
    only what is passed in is overridden.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder of its own; a
    machine's own folder would be lost on a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app_id] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SCRATCH[app_id]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def save_once(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, so that it is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fits_broadcast(table: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> bool:
    """Is a written table small enough, in rows and in bytes, to be sent to every task?

    Rows are counted first; only a table that passes is measured.
    """
    if table.count() > max_rows:
        return False
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return (table.agg(size).first()[0] or 0) <= max_bytes


def lookup_side(df: DataFrame, name: str, max_rows: int = 1_000_000) -> DataFrame:
    """The small side of a join, computed and measured before the join is planned.

    If it fits it is broadcast and the large side is not shuffled. Otherwise it
    joins by shuffle, where adaptive execution splits hot keys.
    """
    side = save_once(df, name)
    return F.broadcast(side) if fits_broadcast(side, max_rows) else side


def few_splits(scan: DataFrame, tasks_per_core: int = 2) -> int:
    """Number of partitions to repartition a scan to, or 0 if it keeps all cores busy.

    A few large files with one row group each would run the text expressions on a
    handful of tasks. At scale a scan has far more splits than there are cores, and
    its text is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return tasks_per_core * cores if scan.rdd.getNumPartitions() < cores else 0


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a scan with too few splits; others are returned untouched."""
    n = few_splits(scan)
    return scan.repartition(n) if n else scan
