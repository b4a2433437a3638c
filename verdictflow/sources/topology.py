"""Fleet topology: a JSON array of {id, address}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_topology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, address string").json(path, multiLine=True)
