"""Scans over one order, however long a group's share of it is.

Rows are dealt to range partitions by group and order, sorted, and written with their place. A scan then works in three steps: within
each partition's part of a group; over one row for each such part, which gives what comes in from the parts before; and the two
joined. No task holds a group, and no window goes over one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.tables import saved, shared_dir


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `_pos`, their place in the order by group and order (nulls first), and `_part`, the range partition they are in."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_pos", F.monotonically_increasing_id())
    return saved(dealt, f"{shared_dir(rows.sparkSession)}/placed").withColumn("_part", F.shiftright("_pos", 33))


def _keyed(by: list[str]) -> Column:
    """One value for a group; nulls are a group as well."""
    return F.struct(*by, "_part") if by else F.struct("_part")


def come_in(rows: DataFrame, by: list[str], ends: dict[str, Column], come: dict[str, tuple]) -> DataFrame:
    """For each part of a group, what comes in from the parts before: ends are aggregates of a part, come (start, fold) by name."""
    parts = rows.groupBy(*by, "_part").agg(*(c.alias(n) for n, c in ends.items()))
    listed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", *ends))).alias("_parts"))
    kinds = {n: parts.schema[n].dataType for n in ends}
    # a fold over the parts, one row each, that keeps what it had before each of them
    start = F.struct(F.array().cast(f"array<struct<_part:bigint,{','.join(f'{n}:{kinds[n].simpleString()}' for n in ends)}>>").alias("out"), *(F.lit(come[n][0]).cast(kinds[n]).alias(n) for n in ends))

    def step(x: Column, p: Column) -> Column:
        return F.struct(F.array_append(x["out"], F.struct(p["_part"].alias("_part"), *(x[n].alias(n) for n in ends))).alias("out"), *(come[n][1](x[n], p[n]).alias(n) for n in ends))

    return listed.select(*by, F.explode(F.aggregate("_parts", start, step)["out"]).alias("_in"))


def with_come_in(rows: DataFrame, by: list[str], come: DataFrame) -> DataFrame:
    """rows with what comes into their part of their group, as `_in`."""
    right = come.select(F.struct(*by, "_in._part").alias("_key"), "_in") if by else come.select(F.struct("_in._part").alias("_key"), "_in")
    return rows.withColumn("_own", _keyed(by)).join(right, F.col("_own").eqNullSafe(F.col("_key"))).drop("_own", "_key")


def carried(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], before: bool = False) -> DataFrame:
    """rows with each value's last one that isn't null, up to the row or (before) up to the row before it."""
    told = placed(rows.withColumns({f"_v_{n}": c for n, c in values.items()}), by, order)
    names = {f"_v_{n}": n for n in values}
    ends = {n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_pos"))) for n in names}
    come = come_in(told, by, ends, {n: (None, lambda x, p: F.coalesce(p, x)) for n in names})
    w = Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = told.withColumns({f"{n}_": F.last(n, ignorenulls=True).over(w) for n in names})
    out = with_come_in(local, by, come)
    return out.withColumns({own: F.coalesce(f"{n}_", F.col("_in")[n]) for n, own in names.items()}).drop("_in", "_part", *names, *(f"{n}_" for n in names))


def summed(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with each value's sum over the rows before."""
    told = placed(rows.withColumns({f"_v_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in values.items()}), by, order)
    names = {f"_v_{n}": n for n in values}
    come = come_in(told, by, {n: F.sum(n) for n in names}, {n: (0, lambda x, p: x + p) for n in names})
    w = Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = told.withColumns({f"{n}_": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    out = with_come_in(local, by, come)
    return out.withColumns({own: F.col(f"{n}_") + F.col("_in")[n] for n, own in names.items()}).drop("_in", "_part", *names, *(f"{n}_" for n in names))


def pieces(rows: DataFrame, by: list[str], order: list[str], text: Column) -> DataFrame:
    """by, order, piece, offset: the group's texts in order, runs of spaces as one, trimmed of spaces, in a piece for each row.

    Put together by offset, the pieces are the text that `spans.stitch` makes in one row. A null text is empty.
    """
    one = rows.select(*by, *order, F.regexp_replace(F.coalesce(text, F.lit("")), " +", " ").alias("_t"))
    bare = F.col("_t").isin("", " ")
    # what stands before a row: whether anything but spaces, and whether a space since
    told = carried(one, by, order, {"_any": F.when(~bare, True), "_space": F.when(F.col("_t") != "", F.col("_t").endswith(" "))}, before=True)
    gap = F.col("_any").isNotNull() & (F.coalesce("_space", F.lit(False)) | F.col("_t").startswith(" "))
    piece = F.when(bare, "").otherwise(F.concat(F.when(gap, " ").otherwise(""), F.trim("_t")))
    cut = told.select(*by, *order, F.col("_pos").alias("_row"), piece.alias("piece"))
    return summed(cut, by, [*order, "_row"], {"offset": F.length("piece")}).select(*by, *order, "piece", "offset")


def digests(cut: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, n_chars, md5 of pieces put together: a group is streamed through its digest, never held."""
    kind = cut.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, state, done = None, 0, None, []
        for pdf in batches:
            for key, piece in zip(pdf[by], pdf["piece"], strict=True):
                key = None if pd.isna(key) else key
                if state is None or key != at:
                    if state is not None:
                        done.append((at, n, state.hexdigest()))
                    at, n, state = key, 0, hashlib.md5()
                n += len(piece)
                state.update(piece.encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=[by, "n_chars", "md5"])
                done = []
        if state is not None:
            yield pd.DataFrame([(at, n, state.hexdigest())], columns=[by, "n_chars", "md5"])

    return cut.repartition(by).sortWithinPartitions(by, *order, "offset").select(by, "piece").mapInPandas(run, f"{by} {kind}, n_chars long, md5 string")
