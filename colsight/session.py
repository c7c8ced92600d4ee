"""Session helper for local runs; on a cluster pass your own session instead."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app_name: str = "colsight", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the bench. Adaptive execution stays on: it coalesces
    small shuffles, splits skewed join partitions and picks broadcast joins from
    measured sizes."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """A new folder for an intermediate table of this application, below the shared folder
    that ``spark.checkpoint.dir`` names. Only a local session without that setting gets a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
        root = tempfile.mkdtemp(prefix="colsight-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/colsight-{spark.conf.get('spark.app.id')}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a DataFrame that several jobs will read, and cut its lineage.

    The table is Parquet, so later scans read only the columns they need, and it outlives a
    lost executor. ``release`` deletes it, ``release_all`` all of the application.
    """
    path = work_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned; it can't be read afterwards."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" not in folder:
            raise ValueError(f"Not an intermediate table: {folder}")
        _delete(spark, folder)


def release_all(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored."""
    _delete(spark, work_folder(spark).rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
