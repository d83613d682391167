"""Materialisation in storage that all executors share, and helpers for column names.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back: the
table survives the loss of any executor, and a retried task reads the same rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_ROOT = f"weft-{uuid.uuid4().hex[:12]}"
_LOCAL: list[tempfile.TemporaryDirectory] = []
_USED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: below ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="weft-"))
        base = "file://" + _LOCAL[0].name
    return f"{base.rstrip('/')}/{_ROOT}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _USED.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(writer: DataFrameWriter, path: str) -> None:
    """Write Parquet and drop the shuffle files of this one execution when it has ended; nothing else ever reads them."""
    conf = writer._spark.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with its path in ``_weft_path``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    write_once(df.write, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*frames: DataFrame | None) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_weft_path", None)
        if path:
            delete(df.sparkSession, path)
            df._weft_path = None


@atexit.register
def _sweep() -> None:
    for spark, path in _USED:
        try:
            if spark.sparkContext._jsc is None:
                return
            delete(spark, path)
        except Exception:  # the session is already gone at interpreter exit; nothing depends on this clean-up
            return


ROWS_A_TASK = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` ahead of a grouping by ``keys``, dealt over as many tasks as ``rows`` need, so that a task's memory does not
    grow with the table.  Where the session's number of partitions is enough, it is left alone."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` does not have (compared as Spark does, ignoring case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
