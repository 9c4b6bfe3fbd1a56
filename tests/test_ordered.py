"""Scans over one order against plain Python, with groups over many partitions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ordered, review, spans


@pytest.fixture(autouse=True)
def many_parts(spark):
    """A group of any size is cut: no partition is merged with another."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(rng, n):
    return [(rng.choice(["a", "b", "b", "b", None]), k, rng.choice([None, None, None, "x", "y", "z"]), rng.randint(0, 9)) for k in range(n)]


@pytest.mark.parametrize("by", [["g"], []])
def test_carried_and_summed(spark, by):
    rng = random.Random(len(by))
    rows = rows_of(rng, 900)
    frame = spark.createDataFrame(rows, "g string, n long, v string, w int").repartition(5)
    up_to, before, total = {}, {}, {}
    last, so_far = {}, {}
    for g, n, v, w in rows:
        key = g if by else 0
        before[n], total[n] = last.get(key), so_far.get(key, 0)
        last[key] = v if v is not None else last.get(key)
        so_far[key] = total[n] + w
        up_to[n] = last[key]
    assert {r.n: r.x for r in ordered.carried(frame, by, ["n"], {"x": F.col("v")}).collect()} == up_to
    assert {r.n: r.x for r in ordered.carried(frame, by, ["n"], {"x": F.col("v")}, before=True).collect()} == before
    assert {r.n: r.x for r in ordered.summed(frame, by, ["n"], {"x": F.col("w")}).collect()} == total


def test_no_window_over_a_group_or_over_all(spark):
    frame = spark.createDataFrame(rows_of(random.Random(1), 300), "g string, n long, v string, w int")
    for by in (["g"], []):
        out = ordered.carried(frame, by, ["n"], {"x": F.col("v")})
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert all("_part" in w for w in re.findall(r"Window \[.*", plan)) and "Window" in plan
        assert ordered.placed(frame, by, ["n"]).groupBy("_part").count().agg(F.max("count")).first()[0] < 150


def texts_of(rng, n):
    return [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice(["", " ", "  ", None, "a", " b", "c ", " d  e ", "f   g", "\n", "é "])) for k in range(n)]


def test_pieces_are_the_stitched_text(spark):
    rng = random.Random(5)
    rows = texts_of(rng, 700)
    frame = spark.createDataFrame(rows, "g long, n long, t string").repartition(4)
    cut = ordered.pieces(frame, ["g"], ["n"], F.col("t"))
    got: dict = {}
    for r in sorted(cut.collect(), key=lambda r: r.n):
        assert r.offset == len(got.get(r.g, ""))
        got[r.g] = got.get(r.g, "") + r.piece
    want = {g: re.sub(" +", " ", "".join(t or "" for k, _, t in rows if k == g)).strip(" ") for g in {r[0] for r in rows}}
    assert got == want
    whole = {r.g: r.stitched for r in spans.stitch(frame.withColumn("t", F.coalesce("t", F.lit(""))), "g", "n", F.col("t")).collect()}
    assert whole == want
    told = {r.g: (r.n_chars, r.md5) for r in ordered.digests(cut, "g", ["n"]).collect()}
    assert told == {g: (len(t), hashlib.md5(t.encode()).hexdigest()) for g, t in want.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g long, n long, t string")
    cut = ordered.pieces(none, ["g"], ["n"], F.col("t"))
    assert cut.count() == 0 == ordered.digests(cut, "g", ["n"]).count() == ordered.carried(none, [], ["n"], {"x": F.col("t")}).count()


def test_report_pieces_are_the_report(spark):
    rows = [(f"in{k % 3}", f"page{k:03d}", k) for k in range(60)]
    lint = F.when(F.col("k") % 4 == 0, F.array(F.struct(F.lit("d").alias("detector"), F.lit("error").alias("severity"), F.lit("...x...").alias("evidence")))).otherwise(F.array())
    pages = spark.createDataFrame(rows, "input string, page string, k int").select("input", "page", lint.alias("lint"), F.array().cast(f"array<{review.FINDING}>").alias("judge"), F.when(F.col("k") % 7 == 0, "late").alias("judge_error"))
    got: dict = {}
    for r in sorted(review.report_pieces(pages, "input", "page").collect(), key=lambda r: r.page):
        assert r.offset == len(got.get(r.input, ""))
        got[r.input] = got.get(r.input, "") + r.piece
    assert got == {r.input: r.report for r in review.report(pages, "input", "page").collect()}
