"""Pieces that the text operators share: scratch tables, tables, words."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, dropped, saved, scratch_path

__all__ = ["SPACE_CLASS", "WORD", "crc_mod", "delete", "dropped", "finished", "free", "hashed_columns", "lower_az", "packed", "partitions", "saved", "scratch_path", "table", "unpacked"]

#: Words are runs of anything but these bytes; ``bytes.split()`` splits on the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def finished(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of steps that are over: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo mod; null ids have 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


def lower_az(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def packed(df: DataFrame) -> DataFrame:
    """df's rows as one column, row, so that columns made beside it clash with none of its own."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def hashed_columns(df: DataFrame, but: str) -> Column:
    """A hash of all columns of packed rows that Spark can hash, without one: an order for rows that agree otherwise."""
    plain = [f.name for f in df.schema.fields if f.name != but and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*(F.col("row").getField(c) for c in plain))
