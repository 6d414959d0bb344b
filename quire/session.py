"""Session settings, stage folders and lineage cuts shared by jobs, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "quire", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter sets these."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's stages, below the one that ``spark.checkpoint.dir`` names.
    Where that is unset, stages go below the warehouse, which all executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quire-stages/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lost executors cost no
    recomputation of what lies before it, what reads it twice computes it once, readers take only
    the columns they need, and Spark knows its size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Deletes the stages of this application; call it once their readers have run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a stage of its own: see ``staged``."""
    return staged(df, "settled")
