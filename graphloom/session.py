"""Session construction and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "graphloom", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark rely on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where everything runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of so many rows at most is stored in as many files as tasks run at once.
FEW_ROWS = 1 << 18


def cut_few(df: DataFrame, most: int) -> DataFrame:
    """``cut`` of a table with ``most`` rows at most. Of few rows, not every partition becomes a file.

    A checkpoint has a file and its checksum for each partition, however empty, and where the folder is a local one, Hadoop starts
    a process for each of them. The tasks that make the rows stay as they are; a small exchange follows them.
    """
    return cut(df.repartition(df.sparkSession.sparkContext.defaultParallelism) if most <= FEW_ROWS else df)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_few`` of a table whose size shows only when it is there, and its number of rows. Until then it is on the executors' disks."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        n = kept.count()
        return cut_few(kept, n), n
    finally:
        kept.unpersist()


_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where a session has Spark's default: texts are long, and each running
#: task holds its batches on both sides.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python workers import it by name."""
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    bundle = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_bundle.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(bundle))
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder, and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
