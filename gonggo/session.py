"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "gonggo", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on.

    `master`, `shuffle_partitions` and `driver_memory` stay with the cluster's
    own settings unless given.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in `spark.checkpoint.dir`. Only a local master may fall
    back to a temporary folder; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gonggo-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written once and read from there after.

    Used before a table is scanned by several jobs (model fits, scheme comparisons). The files
    outlive any executor.
    """
    return written(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """`df` as a Parquet stage in the shared folder, read back.

    Unlike a checkpoint it is read with column pruning and pushed-down filters. Once it is written, nothing
    reads the shuffle files of its making, so they go.
    """
    path = shared_folder(df.sparkSession, name)
    if _short_lived:
        _short_lived[-1].append(path)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Folders written inside each open `short_lived`, the innermost last.
_short_lived: list[list[str]] = []


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stages written inside go at the end, so that a long chain of them holds no more disk than its last steps.

    What is yielded writes a result that stays. Nothing else made inside may be read after.
    """
    paths: list[str] = []
    _short_lived.append(paths)

    def kept(df: DataFrame) -> DataFrame:
        inner = _short_lived.pop()
        try:
            return written(df, "kept")
        finally:
            _short_lived.append(inner)

    try:
        yield kept
    finally:
        _short_lived.pop()
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# What one broadcast lookup may take: its rows' bytes, as measured after it is written.
LOOKUP_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of `df`: fixed widths as they are, texts and arrays as counted."""
    def width(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.octet_length(name)
        if kind == "array<string>":
            return F.aggregate(name, F.lit(0).cast("bigint"), lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        if kind.startswith("array"):
            return F.size(name) * (64 if "string" in kind else 16)
        return F.lit({"bigint": 8, "double": 8, "int": 4, "float": 4, "boolean": 1}.get(kind, 16))

    parts = [F.sum(F.coalesce(width(f"`{n}`", k), F.lit(0)).cast("bigint") + 8) for n, k in df.dtypes]
    return sum(v or 0 for v in df.agg(*parts).first())


def lookup(df: DataFrame, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """`df` as a written stage, marked for broadcast if its measured size allows.

    Beyond the bound it is returned unmarked; the join is then a shuffled one with the same result.
    """
    return marked(written(df, "lookup"), max_bytes)


def marked(stage: DataFrame, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """A written stage, marked for broadcast if its measured size allows."""
    return F.broadcast(stage) if measured_bytes(stage) <= max_bytes else stage


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside; what was set before is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


# Bytes of one Arrow batch where `arrow_rows` rules; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows and BATCH_BYTES for the jobs that run inside; the settings are put back after.

    For jobs on long texts or packed keys: a task holds a few MB of them at a time, on both sides of the pipe.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with (setting(spark, name, str(min(rows, before) if before > 0 else rows)),
          setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")):
        yield
