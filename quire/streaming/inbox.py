"""A watched folder: new files become notes and attachments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.options import Options
from ..operators.readers import pattern, read_files
from ..plans.notes import attachments, compose, linked, placed


def watch(spark: SparkSession, root: str) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return stream.option("pathGlobFilter", pattern()).load(root)


def convert(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``files`` (path, content, with a time of change if there is one) as notes with their paths, links and images."""
    notes = linked(read_files(files.select("path", "content"), options))
    return placed(compose(notes, options, F.current_timestamp()), options)


def convert_stream(spark: SparkSession, root: str, out: str, checkpoint: str, options: Options = Options()):
    """Notes and attachments as Parquet, each batch written once for its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        notes = convert(batch, options)
        notes.write.mode("overwrite").parquet(f"{out}/notes/batch={n}")
        done = batch.sparkSession.read.parquet(f"{out}/notes/batch={n}")
        attachments(done).write.mode("overwrite").parquet(f"{out}/attachments/batch={n}")

    return watch(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
