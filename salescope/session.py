"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are designed for. Joins and aggregations are left to
# AQE, which picks broadcast joins from measured stage sizes and splits skewed
# join partitions; nothing here fixes a partition count for a large cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "salescope", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **ENGINE_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each session.

    The archive lies on the driver; Spark serves it to the executors, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_salescope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="salescope-code-"), "salescope_code.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.join("salescope", os.path.relpath(path, root)))
    context.addPyFile(name)
    context._salescope_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Root for intermediate tables: ``spark.checkpoint.dir`` as the session has it.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    application = spark.sparkContext.applicationId  # the setting is static, so the folder is remembered here
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="salescope-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused by another run."""
    return os.path.join(shared_folder(spark), "salescope", f"{label}-{uuid.uuid4().hex}")


ROWS_PER_TASK = 250_000
LEFT_TO_SPARK = 1_000_000  # so few rows need no partitions of their own


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``ROWS_PER_TASK`` of ``rows`` rows; few rows are left to Spark.

    Spark joins shuffle partitions up to a size after compression, so that what a task sorts grows with how well
    its rows compress. Frames that are joined are dealt by the same number.
    """
    return df if rows <= LEFT_TO_SPARK else df.repartition(-(-rows // ROWS_PER_TASK), *keys)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
