"""Writers: result tables, one file for each document, JSON, audio. All go through Spark's writers or one provider call a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.providers import SilentVoice, Voice, retried
from quillspark.tables import children, removed

#: A WAV header alone is no sound.
HEADER_BYTES = 44


def table(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def changed(pages: DataFrame) -> DataFrame:
    """Restored pages worth writing."""
    return pages.filter("patched is not null and not (patched <=> text)")


def wellformed(rendered: DataFrame) -> DataFrame:
    """Malformed markup is never written; contents end in a line break."""
    return rendered.filter("xml_error is null").withColumn("content", F.concat("content", F.lit("\n")))


def text_files(rows: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """A folder for each name with the text as a file. Other names' files stay; a name's own are replaced. For small sets of documents; else use table()."""
    one = rows.select(F.col(name_col).alias("name"), F.col(text_col).alias("value")).repartition("name")
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").option("lineSep", "\n").text(path)


def restored_files(pages: DataFrame, path: str, name_col: str) -> int:
    """Files of the restored pages that differ from their text. A page's file of an earlier run that has no cause any more is deleted, other pages' files stay; how many were deleted."""
    spark = pages.sparkSession
    there = [(unquote(x.split("=", 1)[1]), x) for x in children(spark, path) if x.startswith("name=")]
    if there:
        # the folder's own listing, so its size is bounded by the files that are there
        files = spark.createDataFrame(there, "name string, folder string")
        idle = pages.filter("patched is null or patched <=> text").select(F.col(name_col).cast("string").alias("name")).distinct()
        gone = [r["folder"] for r in files.join(idle, "name").collect()]
    else:
        gone = []
    for folder in gone:
        removed(spark, f"{path.rstrip('/')}/{folder}")
    text_files(changed(pages), path, name_col, "patched")
    return len(gone)


def append_once(rows: DataFrame, path: str, key: str, batch: int) -> DataFrame:
    """Appends the rows whose key the table hasn't, each key once, as a numbered batch; the table as it is then.

    A batch that is written again replaces itself, so whatever broke off, the table has each key once. Of rows with one key the least is taken.
    """
    spark = rows.sparkSession
    others = [x for x in children(spark, path) if x.startswith("batch=") and x != f"batch={batch}"]
    more = [c for c in rows.columns if c != key]
    fresh = rows.groupBy(key).agg(F.min(F.struct(*more)).alias("_row")).select(key, "_row.*").select(rows.columns) if more else rows.distinct()
    if others:
        known = spark.read.parquet(*(f"{path}/{x}" for x in others)).select(F.col(key).alias("_known")).distinct()
        fresh = fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return spark.read.schema(T.StructType([*rows.schema, T.StructField("batch", T.LongType())])).parquet(path)


def counted(rows: DataFrame, path: str, counters: dict[str, Column], mode: str = "overwrite") -> dict[str, object]:
    """Writes a table and returns its counters, which the tasks that write it take: the rows are computed once."""
    seen = Observation()
    rows.observe(seen, *(c.alias(n) for n, c in counters.items())).write.mode(mode).parquet(path)
    return seen.get


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def audio(texts: DataFrame, name_col: str, text_col: str, ssml: bool = False, voice: Callable[[], Voice] = SilentVoice) -> DataFrame:
    """name, file, audio, ok, detail: one call a row, tried twice; ok if more than a header came back."""
    kind = "ssml" if ssml else "plain"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = voice()
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                try:
                    sound = retried(lambda t=text: own.synthesize(t, ssml), attempts=2)
                    rows.append((name, f"{name}-full-{kind}.wav", sound, len(sound) > HEADER_BYTES, f"{len(sound)} bytes"))
                except Exception as x:
                    rows.append((name, f"{name}-full-{kind}.wav", None, False, str(x)))
            yield pd.DataFrame(rows, columns=["name", "file", "audio", "ok", "detail"])

    return texts.select(F.col(name_col).cast("string").alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "name string, file string, audio binary, ok boolean, detail string")


def failed(results: DataFrame) -> DataFrame:
    """How many calls failed, and the exit code that this means."""
    return results.agg(F.count_if(~F.col("ok")).alias("failures")).withColumn("exit_code", F.when(F.col("failures") > 0, 1).otherwise(0))
