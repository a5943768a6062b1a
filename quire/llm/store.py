"""Tables and work folders shared by driver and executors."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: texts are long, and a batch stands in the JVM and in Python at once.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def give_back() -> None:
    """Returns memory that was freed to the system; a worker process outlives its task, idle beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


#: What a worker process keeps for its next tasks of the same kind, by kind.
HELD: dict[str, dict] = {}


def arrow_map(df: DataFrame, run: Callable, schema, holds: str = "") -> DataFrame:
    """``mapInArrow`` whose tasks end by giving freed memory back; only objects of the kind ``holds`` outlive other work."""

    def task(batches):
        for kind in [k for k in HELD if k != holds]:
            del HELD[kind]
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only with a local master and no setting."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Parts:
    """A table that grows by parts in the shared folder: whatever their number, ``rows`` is one scan, so plans do not grow with it."""

    def __init__(self, spark: SparkSession, label: str, schema):
        _small_batches(spark)
        self.spark, self.schema, self.path, self.n = spark, schema, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{self.n}")
        self.n += 1

    def rows(self, *parts: int) -> DataFrame:
        """The rows of these parts, of all without any."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{k}" for k in parts or range(self.n)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
