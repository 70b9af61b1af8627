"""Session helpers: a local session for tests and the durable checkpoint folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "daybill", cpus: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark; on a cluster use the cluster's own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, read from the session; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="daybill-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later passes survive the loss of an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: as durable, but compressed by column.

    Spark drops the shuffle files of the write when it is done. Partitions and their order are not kept.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/daybill-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(place)


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to a Python step, unless the session sets its own: rows of long texts would otherwise
#: come ten thousand at a time.
ARROW_BYTES = 3_900_000
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would.

    The driver zips its own copy and Spark serves the file to every executor, so Python steps run where nothing is installed.
    A session without a bound on the bytes of Arrow batches gets ``ARROW_BYTES``.
    """
    context = spark.sparkContext
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="daybill-ship-"), "daybill.zip")
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
