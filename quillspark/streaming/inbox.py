"""A drop folder worked off as a stream: each file once, whatever happens between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.sources.files import BINARY, name_of


def files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New images and PDFs of a folder as a stream: name, content."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch).load(folder)
    rows = stream.select(name_of(F.col("path")).alias("name"), "content")
    return rows.filter(cf.is_image(F.col("name")) | F.lower("name").endswith(".pdf"))


def work_off(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Runs step on all that is new and appends its rows to the table at out; ends when nothing is left.

    A batch that is run again after a failure replaces its own part of the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
