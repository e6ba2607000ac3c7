"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings every job relies on; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Functions of the package are pickled by name, and a worker may be started
    anywhere; the archive goes through Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gatelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="gatelake-code-")
        archive = os.path.join(folder, "gatelake_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(archive)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._gatelake_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators depend on to an existing session."""
    ship_package(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gatelake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="gatelake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` that every executor sees.

    Where the setting is missing, a session of one process (master ``local``)
    gets a folder of its own, which is removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _own_folder()
    return os.path.join(base, purpose, uuid.uuid4().hex)


def cut_lineage(df, purpose: str):
    """Write ``df`` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
