"""One numeric column in several layouts, and what a range touches in each.

Layouts: in order of arrival, sorted, by magnitude bucket, by magnitude with
the dense bucket 0 refined, by equi-depth bucket. Row groups have ``GROUP_ROWS``
rows; what is touched is told by the statistics in the files' footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplane.functions import routing
from skiplane.operators import analysis

GROUP_ROWS = 100_000
KINDS = ("arrival", "sorted", "magnitude", "refined", "equi_depth")


def write(df: DataFrame, value: str, path: str, kind: str, buckets: int = 16) -> None:
    """The column ``v`` of ``df`` as Parquet; bucketed layouts have a folder ``seg=…`` for each bucket."""
    rows = df.select(F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL")
    if kind == "sorted":
        rows = rows.repartitionByRange("v").sortWithinPartitions("v")
    elif kind == "equi_depth":
        rows = analysis.equi_depth(rows, "v", buckets).withColumnRenamed("depth", "seg")
    elif kind in ("magnitude", "refined"):
        rows = rows.withColumn("seg", routing.refined_label(F.col("v"), buckets) if kind == "refined" else routing.magnitude_bucket(F.col("v"), buckets))
    elif kind != "arrival":
        raise ValueError(f"no layout {kind!r}")
    out = rows.hint("rebalance", "seg").write.partitionBy("seg") if "seg" in rows.columns else rows.write
    out.options(**{"parquet.block.row.count.limit": str(GROUP_ROWS)}).mode("overwrite").parquet(path)


def touched(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """segments, groups and bytes of the column, all and touched by a range, and the rows that match. Unbucketed layouts are one segment a file."""
    groups = analysis.row_groups(spark.read.parquet(path), "v").withColumn("segment", F.coalesce(F.nullif(F.regexp_extract("path", r"/seg=([^/]+)/", 1), F.lit("")), F.col("path")))
    hit = F.lit(True)
    if low is not None:
        hit = hit & (F.col("most").isNull() | (F.col("most") >= low))
    if high is not None:
        hit = hit & (F.col("least").isNull() | (F.col("least") <= high))
    each = groups.withColumn("hit", hit).groupBy("segment").agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes"), F.count_if("hit").alias("groups_touched"), F.sum(F.when(F.col("hit"), F.col("bytes")).otherwise(0)).alias("bytes_touched"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = each.agg(F.count("*").alias("segments"), F.count_if(F.col("groups_touched") > 0).alias("segments_touched"), *[total(c) for c in ("groups", "groups_touched", "bytes", "bytes_touched")])
    matching = spark.read.parquet(path)
    for condition in ([] if low is None else [F.col("v") >= low]) + ([] if high is None else [F.col("v") <= high]):
        matching = matching.where(condition)
    return out.join(F.broadcast(matching.agg(F.count("*").alias("rows"))))  # one row each


def compared(spark: SparkSession, df: DataFrame, value: str, folder: str, low: float | None, high: float | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``touched`` of each layout, with its name; layouts are written into ``folder``."""
    out = None
    for kind in kinds:
        write(df, value, f"{folder}/{kind}", kind)
        one = touched(spark, f"{folder}/{kind}", low, high).select(F.lit(kind).alias("layout"), "*")
        out = one if out is None else out.union(one)
    return out
