"""Runs that can be broken off at any point: results of stages in batches, and a manifest that says which inputs have one.

A stage writes its rows to a folder of its own for each batch, then, when they are complete, a manifest with the batch's
inputs. What has no manifest doesn't exist: a batch that was broken off is written anew under the same number, and
inputs are worked off if no manifest names them. An input that is worked off again, on demand, has its results in the
latest batch alone. Streams bring their own batch numbers, which a restarted stream repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.tables import children, exists, removed, saved, shared_dir

Step = Callable[[DataFrame], DataFrame]
#: Inputs in a task of a step, at least and at most: texts of a few bytes can take long, so a task's bytes don't tell its work.
LEAST, MOST = 500, 10_000


def dealt(rows: DataFrame, key: str, inputs: int) -> DataFrame:
    """rows of a known number of inputs, dealt over as many tasks as the inputs make, however few bytes they have."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by another value than the key, or what joined by the key would be kept as it is dealt
    return rows.repartition(max(min(-(-inputs // LEAST), usual), -(-inputs // MOST), 1), F.xxhash64(key))


class Stage:
    """One stage's table and manifest below a run's folder; key names an input."""

    def __init__(self, spark: SparkSession, folder: str, name: str, key: str) -> None:
        self.spark, self.key, self.at, self.manifest = spark, key, f"{folder.rstrip('/')}/{name}", f"{folder.rstrip('/')}/{name}.done"

    def batches(self) -> list[int]:
        """Numbers of complete batches."""
        found = [int(x.split("=")[1]) for x in children(self.spark, self.manifest) if x.startswith("batch=")]
        return sorted(k for k in found if exists(self.spark, f"{self.manifest}/batch={k}/_SUCCESS"))

    def done(self) -> DataFrame | None:
        """key, batch of inputs with a result: the latest batch of each. None before the first."""
        paths = [f"{self.manifest}/batch={k}" for k in self.batches()]
        if not paths:
            return None
        return self.spark.read.option("basePath", self.manifest).parquet(*paths).groupBy(self.key).agg(F.max("batch").cast("long").alias("batch"))

    def open(self, inputs: DataFrame, force: bool = False) -> DataFrame:
        """Inputs without a result, or all when forced."""
        done = self.done()
        return inputs if force or done is None else inputs.join(done.select(self.key), self.key, "left_anti")

    def commit(self, keys: DataFrame, rows: DataFrame, batch: int | None = None) -> int:
        """Writes the rows of a batch of inputs, then its manifest; the batch's number, by default the one after the last complete one."""
        known = self.batches()
        number = (known[-1] + 1 if known else 0) if batch is None else batch
        rows.write.mode("overwrite").parquet(f"{self.at}/batch={number}")
        keys.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.manifest}/batch={number}")
        return number

    def rows(self) -> DataFrame:
        """The table: of each input the rows of its latest complete batch."""
        done = self.done()
        if done is None:
            raise LookupError(f"no batch of {self.at} is complete")
        data = self.spark.read.option("basePath", self.at).parquet(*(f"{self.at}/batch={k}" for k in self.batches()))
        return data.withColumn("batch", F.col("batch").cast("long")).join(done, [self.key, "batch"])


def work_off(spark: SparkSession, folder: str, inputs: DataFrame, key: str, steps: list[tuple[str, Step]], force: str | None = None, batch: int | None = None, keys: DataFrame | None = None) -> dict[str, Stage]:
    """Takes inputs through named steps, each from the table of the one before; a step sees only inputs that it has no result for.

    Every row of a step's result has the key. force names a step from which on all inputs are worked off again. Inputs that gave
    no rows count as done. keys are the inputs' keys, where they are had for less than by reading the inputs. An input's batch number differs between stages if runs were broken off; its rows don't.
    """
    stages: dict[str, Stage] = {}
    before, forced, at = inputs, False, shared_dir(spark)
    # which inputs there are, and which of them a stage has yet to do, are tables: else each use of them would read the inputs anew
    keys = saved((inputs if keys is None else keys).select(key).distinct(), f"{at}/keys")
    for name, step in steps:
        stages[name] = stage = Stage(spark, folder, name, key)
        forced = forced or name == force
        todo = saved(stage.open(keys, forced), f"{at}/todo_{name}")
        if n := todo.count():
            stage.commit(todo, step(dealt(before.join(todo, key, "left_semi"), key, n)), batch)
        before = stage.rows().drop("batch") if stage.batches() else before.limit(0)
    removed(spark, at)
    return stages
