"""Allow and deny lists: one entry a line, carriage returns stripped, empty lines dropped."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError


def list_frame(spark: SparkSession, path: str) -> DataFrame:
    """A list of any size as a DataFrame with the column `value`."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r+$", "").alias("value")).filter(F.length("value") > 0).distinct()


def read_list(path: str) -> tuple[str, ...]:
    """A small list on the driver; an empty path is no list, a missing file an error."""
    if not path:
        return ()
    file = Path(path.removeprefix("file://"))
    if not file.exists():
        raise ConfigError("InvalidConfig", f"no list file {path}")
    return tuple(dict.fromkeys(x for x in (line.rstrip("\r") for line in file.read_text().split("\n")) if x))
