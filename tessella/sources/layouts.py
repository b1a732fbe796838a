"""Positional layouts of delimited text, read into typed columns; bad rows stop the job."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Names by position: any of ``idx``, ``y`` or ``label``, and features ``f1`` to ``fd``. An index is text; ``trailing`` allows further fields, which are not read."""

    fields: tuple[str, ...]
    text_label: bool = False
    trailing: bool = False

    @property
    def features(self) -> list[str]:
        return [f for f in self.fields if f[0] == "f" and f[1:].isdigit()]

    @property
    def schema(self) -> T.StructType:
        def kind(name: str) -> T.DataType:
            return T.StringType() if name == "idx" or name in ("y", "label") and self.text_label else T.DoubleType()

        return T.StructType([T.StructField(f, kind(f), False) for f in self.fields])


def _features(d: int) -> tuple[str, ...]:
    return tuple(f"f{i + 1}" for i in range(d))


def neighbours_layout(d: int) -> Layout:
    return Layout(("idx", *_features(d), "y"), text_label=True)


def points_layout(d: int) -> Layout:
    return Layout(_features(d))


def regression_layout(d: int) -> Layout:
    return Layout(("y", *_features(d)))


def ridge_layout(d: int) -> Layout:
    return Layout(("idx", *_features(d), "y"))


def discriminant_layout(d: int) -> Layout:
    return Layout(("idx", "label", *_features(d)), text_label=True)


def mixture_layout(d: int) -> Layout:
    return Layout(("idx", *_features(d)))


def statistics_layout(d: int) -> Layout:
    return Layout(("idx", *_features(d)), trailing=True)


def read_delimited(spark: SparkSession, path, layout: Layout, sep: str = ",") -> DataFrame:
    """Typed columns of lines without quoting; blank lines are skipped.

    A line with a field too few, or too many where the layout has no ``trailing`` ones, an empty field, and a field that is
    no number where one is wanted stop the job with the line in the message.
    """
    parts, n = F.col("parts"), len(layout.fields)

    def field(i: int, f: T.StructField) -> Column:
        text = F.trim(parts[i])
        found = F.nullif(text, F.lit("")) if isinstance(f.dataType, T.StringType) else text.try_cast("double")
        return F.coalesce(found, F.raise_error(F.concat(F.lit(f"field {f.name} is empty or no number: "), F.col("value"))).cast(f.dataType)).alias(f.name)

    enough = F.size(parts) >= n if layout.trailing else F.size(parts) == n
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("parts", F.split("value", re.escape(sep)))
    checked = lines.withColumn("parts", F.when(enough, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.col("value")))))
    return checked.select(*[field(i, f) for i, f in enumerate(layout.schema.fields)])


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Opaque lines in the column ``value``."""
    return spark.read.text(path)


def read_numbers(spark: SparkSession, path) -> list[float]:
    """All numbers of a small side file such as a list of penalties, in the order of its fields."""
    return [float(v) for r in spark.read.text(path).collect() for v in r["value"].split(",") if v.strip()]
