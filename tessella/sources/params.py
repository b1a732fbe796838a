"""Model parameters as JSON, one document per state, in any store that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_params(spark: SparkSession, params: dict | list, path: str) -> None:
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> dict | list:
    """The first non-empty line under ``path``."""
    row = spark.read.text(path).where(F.trim("value") != "").first()
    if row is None:
        raise ValueError(f"no parameters under {path}")
    return json.loads(row["value"])


def iteration_path(base: str, step: int) -> str:
    return f"{base}_{step}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, sep: str = ",") -> None:
    """All columns of a row joined by ``sep``."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)
