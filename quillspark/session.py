"""Sessions with the settings that the queries assume."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: Bytes of an Arrow batch, about: whole texts are long, so a batch of Spark's usual number of rows could take gigabytes.
BATCH_BYTES = 4 << 20


def shipped(spark: SparkSession) -> SparkSession:
    """Sends the package to all workers, wherever they were started and whatever is installed there."""
    at = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("quillspark", os.path.relpath(path, PACKAGE)))
    spark.sparkContext.addPyFile(at)
    return spark


def session(master: str | None = None, app: str = "quillspark", **settings: object) -> SparkSession:
    """A session with adaptive execution, UTC times and bounded Arrow batches, whose workers have the package; settings use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    } | {k.replace("__", "."): str(v) for k, v in settings.items()}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return shipped(builder.getOrCreate())
