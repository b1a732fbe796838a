"""What the corpus operators share: a shared working folder, Arrow mapping, text normalisation, sampling.

Every Python stage here runs through ``mapInArrow`` in slices of ``SLICE`` rows, so a task
holds one Arrow batch from the JVM and one slice of results at a time, whatever the partition holds.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 512
WORD = re.compile(r"\w+")
LOCAL = re.compile(r"local(\[|$)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves
    a local master (tests), which is one machine; on a cluster that is an error, as executors would not see the files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not LOCAL.match(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes what ``stash`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def map_slices(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], rows: int = SLICE) -> DataFrame:
    """``make()`` runs once in each task; what it returns gets slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from handle(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run in here gets Arrow batches of at most ``rows`` rows; for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_struct(df: DataFrame, text_col: str, fields: list[T.StructField], into: str, make: Callable[[], Callable[[list], list[pa.Array]]], rows: int = SLICE) -> DataFrame:
    """Adds the struct column ``into``: ``make()`` gives a function from a list of texts (with None) to an Arrow array per field."""
    if into.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {into} exists already; use fresh()")
    names = [f.name for f in fields]

    def build():
        score = make()

        def handle(batch: pa.RecordBatch):
            arrays = score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            packed = pa.StructArray.from_arrays(arrays, names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, into])

        return handle

    return map_slices(df, T.StructType([*df.schema.fields, T.StructField(into, T.StructType(fields))]), build, rows)


def sample_texts(labelled: DataFrame, docs: DataFrame, id_col: str, label_col: str, text_col: str, per_label: int, max_chars: int) -> list[tuple[str, object]]:
    """A bounded training sample: at most ``per_label`` rows of each label, in the order of a hash of the id.

    ``labelled`` holds ids and labels, ``docs`` ids and texts. The ids are chosen first, from two narrow columns:
    labels are counted, ids whose hash is too large to be among the first are left where they are, and the few others
    are ranked. Only chosen texts travel to the driver, and of these none longer than ``max_chars``. The chosen
    ids, at most ``per_label`` for each label, are broadcast. Rows without id, label or text take no part. An id with
    several labels has the least of them, one with several texts the least of these. The sample does not depend on
    partitioning.
    """
    key = F.xxhash64(F.col("i").cast("string"), F.lit(17))
    usable = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y")).withColumn("h", key)
    # Hashes are uniform, so this share of a label holds more than enough of its first ids.
    share = (F.lit(2.0 * per_label + 200) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    few = usable.join(F.broadcast(usable.groupBy("y").agg(F.count(F.lit(1)).alias("n"))), "y").where(F.col("h").cast("double") <= share)
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "i"))).where(F.col("r") <= per_label).select("i", "y")
    texts = docs.where(F.length(text_col) <= max_chars).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: r["i"])]


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
