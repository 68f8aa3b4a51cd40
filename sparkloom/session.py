"""The SparkSession that queries, tests and the bench share."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "sparkloom") -> SparkSession:
    """A local session with the settings that the queries are written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it is not installed."""
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    archive = shutil.make_archive(str(folder / "sparkloom"), "zip", Path(__file__).parents[1], "sparkloom")
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
