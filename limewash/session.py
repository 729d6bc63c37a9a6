"""Session helpers: local sessions for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the cell programs profit from; safe for any other query of the session. Call it
    yourself: no other function of the library changes a session.

    The virtual machine does not compile methods beyond 8,000 bytes. Stages whose fused code
    would be larger run as separate, compiled operators instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("limewash")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Executors of a cluster share no local folder, so there the setting must exist. A local session
    without it (tests) uses one temporary folder of its own machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="limewash-")


_open: contextvars.ContextVar[tuple[list[str | DataFrame], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str | DataFrame]]:
    """Own what is stored meanwhile: on leaving, all tables that ``materialise`` wrote or ``hold`` held inside
    are removed, but for those it was told to keep. Results that are still lazy must have been used by then."""
    paths: list[str | DataFrame] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield paths
    finally:
        _open.reset(token)
        for path in paths:
            path.unpersist() if isinstance(path, DataFrame) else _remove(spark, path)


def hold(df: DataFrame) -> DataFrame:
    """Keep the rows of a lazy result, dealt and ordered as they are, on the disks of the executors, for
    as long as the ``scratch`` block or else the session lasts. Lost ones are computed again from the same splits."""
    if _open.get():
        _open.get()[-1].append(df)
    return df.persist(StorageLevel.DISK_ONLY)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a result that several later jobs read, and read it back.

    The table lives in shared storage, so a lost executor costs a re-read and not a recomputation.
    ``release`` removes it once nothing reads it any more, or else the ``scratch`` block it was written
    in, unless it is to ``keep``.
    """
    path = scratch_path(df.sparkSession, name)
    if _open.get() and not keep:
        _open.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` returned; nothing may read them afterwards."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
