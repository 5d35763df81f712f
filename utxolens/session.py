"""Session helpers: the settings every plan assumes, and the package's code on the executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPING = threading.Lock()

#: Settings the engine relies on; AQE is on by default.
SETTINGS = {"spark.sql.session.timeZone": "UTC"}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark context."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    with _SHIPPING:
        if getattr(sc, "_utxolens_shipped", False):
            return
        sc._utxolens_shipped = True
    path = Path(tempfile.mkdtemp(prefix="utxolens-")) / "utxolens_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the package shipped and UTC timestamps."""
    ship_package(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kept-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def keep(df, tag: str):
    """Write df once in the shared folder and read it back: plans stay short and lost executors are survived."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(*kept) -> None:
    """Delete kept tables that no later plan reads."""
    for df in kept:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: named in repartition() it is not merged down by bytes, where cost is not bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
