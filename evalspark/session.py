"""Session helpers. Library code never builds a session; tests, bench and scripts do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and measurements."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("evalspark")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the cluster's shared checkpoint directory.

    Anything that must outlive an executor goes there; a machine-local folder would not do,
    so an unset directory is an error rather than a silent fall-back.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        raise ValueError(f"{CHECKPOINT_SETTING} is not set; pass an explicit shared path")
    return f"{root.rstrip('/')}/{name}"


def materialized(df: DataFrame) -> DataFrame:
    """Write a DataFrame that is used several times to the checkpoint folder, if there is one.

    The copy is on shared storage, so it survives lost executors. Without a checkpoint folder
    the DataFrame is returned as it is, and is computed once per use.
    """
    spark = df.sparkSession
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        return df
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
