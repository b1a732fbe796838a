"""Moments of a stream: each micro-batch is reduced to one ``Gram`` and merged into the running one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.gram import Gram, gram, merge
from ..sources.params import load_params, save_params


class RunningGram:
    """Holds d x d numbers, whatever has passed. A batch that is delivered twice counts once.

    With ``store``, a folder that outlives the driver, the value is written after every batch, under the batch's number and
    before the stream notes the batch as done. ``start`` uses a folder within the stream's checkpoint and goes on from the last
    value there, so a stream that starts again after a failure has lost nothing and counts nothing twice.
    """

    def __init__(self, x: Sequence[str], y: str | None = None, store: str | None = None):
        self.x, self.y, self.store, self.value, self.last = list(x), y, store, None, -1

    def add(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        new: Gram | None = gram(batch, self.x, self.y).get(None)
        if new is not None:
            self.value = new if self.value is None else merge(self.value, new)
        if self.store:
            self._save(batch.sparkSession, batch_id)
        self.last = batch_id

    def _save(self, spark: SparkSession, batch_id: int) -> None:
        g = self.value
        state = None if g is None else {"n": g.n, "mean": g.mean.tolist(), "centred": g.centred.tolist(), "low": g.low.tolist(), "high": g.high.tolist()}
        save_params(spark, {"features": self.x, "y": self.y, "moments": state}, f"{self.store}/{batch_id}")
        # The value before the last stays until the next batch, in case this one is not noted as done.
        for old in self._batches(spark)[:-2]:
            self._folder(spark)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{old}"), True)

    def _folder(self, spark: SparkSession) -> tuple:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.store)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose value was written whole."""
        fs, path = self._folder(spark)
        if not fs.exists(path):
            return []
        done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}/_SUCCESS"))
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit() and done(f.getPath().getName()))

    def restore(self, spark: SparkSession) -> None:
        """Takes up the last value in ``store``, if there is one."""
        if found := self._batches(spark):
            state = load_params(spark, f"{self.store}/{found[-1]}")
            if (state["features"], state["y"]) != (self.x, self.y):
                raise ValueError(f"{self.store} holds moments of other columns")
            m = state["moments"]
            self.last = found[-1]
            self.value = None if m is None else Gram(m["n"], *(np.array(m[name]) for name in ("mean", "centred", "low", "high")))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        self.store = self.store or f"{checkpoint.rstrip('/')}/moments"
        self.restore(stream.sparkSession)
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
