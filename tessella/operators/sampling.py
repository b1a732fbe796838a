"""Simple random samples of an exact size, without replacement."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for a while, unless the caller has done so; then it is left as it is."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()


def priority(key: str, seed: int) -> Column:
    """A pseudo-random order that depends on seed and key alone, at any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """min(n, rows) rows, each equally likely. Each task keeps its n best, so only those reach one place.

    With ``key`` the sample can be repeated at any partitioning; without, it can for the same partitions.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    return df.orderBy(priority(key, seed), key).limit(n)


def sample_bound(df: DataFrame, n: int, seed: int, key: str) -> str | None:
    """The last priority of the keyed sample: ``priority(key, seed) <= bound`` picks its rows without a join."""
    if n < 1:
        return None
    p = priority(key, seed).alias("p")
    return df.select(p).orderBy("p").limit(n).agg(F.max("p")).first()[0]
