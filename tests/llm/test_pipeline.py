"""The pipeline's stages against plain restatements of their rules, and its behaviour on odd tables."""

import re
from collections import defaultdict

import corpus_pipeline as cp
import duckdb
import pytest
from pyspark.sql import functions as F
from test_dedup import linked

from quillspark.llm import registry


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == cp.COLUMNS for s in stages[:-1])


def test_quality_keeps_clean_documents(spark, sf, stages):
    kept = texts(stages[0])
    rows = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id in kept for r in rows if r.quality == 1]
    bad = [r.doc_id in kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_exact_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
    assert after == {i: before[i] for i in first.values()}


def test_near_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = linked(sorted(before.items()), 5, 80, 100)
    assert set(after) == {i for i in before if want[i] == i}


def test_benchmark_stage_leaves_no_window(spark, sf, stages):
    from quillspark.llm.decontaminate import matches

    before, after = texts(stages[2]), stages[3]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert matches(after, items).filter(F.size("spans") > 0).count() == 0
    hit = {r.doc_id for r in matches(stages[2], items).filter(F.size("spans") > 0).collect()}
    assert {i: t for i, t in texts(after).items() if i not in hit} == {i: t for i, t in before.items() if i not in hit}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing_stage(stages):
    pieces = defaultdict(int)
    for r in stages[4].collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(texts(stages[3]))


def test_odd_tables(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), "key", "sig", "score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert {1, 4, 7, 10, None} <= ids and not {2, 5, 11} & ids
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/e").collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, sf).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
