"""Runs of a validation: findings recorded under a run's id, and what each run found that the one before it had not.

A run is written to partitions of its own, so that a run that is repeated after a failure replaces what it had written and counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def location(spark: SparkSession, name: str, project: str | None = None) -> str:
    """Where a table lies: that of a project, or the one that all share.

    spark.siltstone.dir.project (in which {project} stands for its name) and spark.siltstone.dir.shared say where; unset, both are in the shared folder.
    """
    if project is None:
        return f"{spark.conf.get('spark.siltstone.dir.shared', f'{shared_folder(spark)}/tables/shared')}/{name}"
    if not project or any(c in project for c in "/\\") or project in (".", ".."):
        raise ValueError(f"{project!r} is no name of a project")
    home = spark.conf.get("spark.siltstone.dir.project", f"{shared_folder(spark)}/tables/projects/{{project}}")
    return f"{home.replace('{project}', project)}/{name}"


def record(found: DataFrame, path: str, project: str, run_id: str, started_at: Column) -> None:
    """Findings of a run, with project, run_id and started_at, and the run itself, which may have found nothing."""
    spark = found.sparkSession
    facts = {"started_at": started_at, "project": F.lit(project), "run_id": F.lit(run_id)}
    for rows, name in ((found, "findings"), (spark.range(1).drop("id"), "runs")):  # the run last: one without it was not finished
        rows.withColumns(facts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "run_id").parquet(f"{path}/{name}")


def recorded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) that were recorded; findings of runs that did not finish are left out."""
    ids = "started_at timestamp, project string, run_id string"
    runs = spark.read.schema(ids).parquet(f"{path}/runs")
    # ids such as 007 are texts, whatever the names of the folders look like
    kinds = spark.read.option("mergeSchema", True).parquet(f"{path}/findings").schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("project", "run_id") else f for f in kinds])
    found = spark.read.schema(texts).parquet(f"{path}/findings")
    return runs.select("project", "run_id", "started_at"), found.join(runs.select("project", "run_id"), ["project", "run_id"], "left_semi")


def history(runs: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """(project, run_id, nth, found, new, fixed): different findings of each run, those that the project's run before it had not, and those that it had more.

    runs: (project, run_id, started_at), in the order of started_at, then run_id; found: (project, run_id, *key), nulls in the key are equal to each other.
    Findings of a run that is not in runs are ignored; a run's repeated rows count once. The first run's findings are all new.
    """
    order = runs.groupBy("project", "run_id").agg(F.min("started_at").alias("started_at"))
    order = order.withColumn("nth", F.row_number().over(W.partitionBy("project").orderBy("started_at", "run_id")))
    order = order.withColumn("more", F.lead("nth").over(W.partitionBy("project").orderBy("nth")).isNotNull()).drop("started_at")
    packed = F.struct(*(F.col(k) for k in key)).alias("key")
    rows = found.select("project", "run_id", packed).distinct().join(order, ["project", "run_id"]).select("project", "key", "nth", "more")
    of = W.partitionBy("project", "key").orderBy("nth")
    rows = rows.withColumn("was", F.lag("nth").over(of)).withColumn("next", F.lead("nth").over(of))
    here = F.struct(F.col("nth"), F.lit(1).alias("found"), (~F.col("was").eqNullSafe(F.col("nth") - 1)).cast("int").alias("new"), F.lit(0).alias("fixed"))
    gone = F.struct((F.col("nth") + 1).alias("nth"), F.lit(0).alias("found"), F.lit(0).alias("new"), F.lit(1).alias("fixed"))
    each = rows.select("project", F.explode(F.array(here, F.when(F.col("more") & ~F.col("next").eqNullSafe(F.col("nth") + 1), gone))).alias("e")).filter("e IS NOT NULL").select("project", "e.*")
    sums = each.groupBy("project", "nth").agg(*(F.sum(c).alias(c) for c in ("found", "new", "fixed")))
    return order.join(sums, ["project", "nth"], "left").na.fill(0, ["found", "new", "fixed"]).select("project", "run_id", "nth", "found", "new", "fixed")
