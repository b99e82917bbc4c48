"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "pricewell") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def use_local_folder(spark: SparkSession) -> None:
    """For tests and checks in local mode: set a temporary checkpoint folder where none is set."""
    sc = spark.sparkContext
    unset = spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None
    if unset and sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pricewell-"))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_pricewell_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="pricewell-"))) / "pricewell.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._pricewell_shipped = True


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder; the result survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
