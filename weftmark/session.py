"""Session defaults and the shared working folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "weftmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    The zone is fixed because weeks and days are calendar periods. Adaptive execution picks join sides by
    measured size, coalesces small shuffle partitions and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# applications whose workers have this package
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run where it is not installed.

    The archive lies on the driver, which serves it to the executors.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-package-")
    archive = shutil.make_archive(f"{folder}/{root.name}-package", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared checkpoint folder.

    Where the session names none, the folder lies below the warehouse, which every executor of a cluster reaches; a
    warehouse on a local disk is refused unless driver and executors share the machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        local = root.startswith(("/", "file:"))
        if local and not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share; {root} is local")
    return f"{root.rstrip('/')}/weftmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches need the same aggregate: the source tables are scanned once, and a lost
    executor costs a read of a small table rather than a recomputation from the start.
    """
    path = workspace(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
