"""CSV, JSON-line and typed ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiplane.functions import routing


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """A CSV, all text, with a header or with the names in ``columns``; a row with another number of fields is an error, whatever is selected later."""
    names = columns or (spark.read.option("header", True).csv(path).columns if header else None)
    if names is None:
        raise ValueError("a CSV without a header needs names of columns")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.option("columnPruning", False).csv(path, schema=schema, header=header, mode="FAILFAST")


def read_log(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON objects of text values, one a line; blank lines are skipped, a broken one is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(*sorted(df.columns)).write.mode(mode).csv(path, header=True)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to declared types; what is missing or can't be read is null."""

    def one(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        return (routing.boolean(c) if isinstance(f.dataType, T.BooleanType) else c.try_cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])
