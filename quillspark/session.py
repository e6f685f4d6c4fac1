"""Session set-up and the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    base = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or on one machine a folder below the warehouse where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark").rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its scan has fewer parts than there are cores: a small file of one row group is read by one task.

    A scan of many files is left as it is, so large inputs are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
