"""Sessions for local use, and what every session needs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def scratch_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/siltstone/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in scratch_folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df in parts of about so many rows, dealt by the columns: a small file is one task's, whatever is then made of its rows."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder by whatever file system its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames made by saved() that no later plan reads."""
    for df in frames:
        if getattr(df, "_scratch", None):
            delete(df.sparkSession, df._scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application saved, when the results that read it are written. Other applications' stays."""
    delete(spark, scratch_folder(spark))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed or on their path."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def local(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks share."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siltstone")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)
