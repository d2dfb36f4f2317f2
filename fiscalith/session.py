"""Session set-up and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings this engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fiscalith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which every executor must be able to read.

    ``spark.checkpoint.dir`` decides. Where it is unset, a local master gets a
    temporary folder; a cluster gets an error, because a folder of one machine
    would not outlive that machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        folder = tempfile.mkdtemp(prefix="fiscalith-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there ever after."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bound_holds(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must to tell."""
    return df.limit(most + 1).count() <= most


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that they need not have it installed.

    The archive is read from the driver by Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fiscalith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="fiscalith-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "fiscalith-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._fiscalith_shipped = True
