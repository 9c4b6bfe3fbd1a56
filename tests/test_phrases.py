"""Phrase search against brute force: automata, the inverted index, and both."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import phrases


@pytest.mark.parametrize("block_chars", [10**6, 400, 1])
def test_containing(spark, block_chars):
    rng = random.Random(block_chars)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", "x" * 50]
    hot = " ".join(word() for _ in range(9))
    texts += [t + hot + t for t in texts[:60]]
    cut = [t[(a := rng.randrange(len(t))) : a + rng.choice([1, 3, 10, 30, 80])] for t in rng.choices([t for t in texts if t], k=90)]
    table = [*cut, hot, hot, "never there", "", None, "q" * 40]
    docs = [(k // 2, t, 1) for k, t in enumerate(texts)] + [(3, None, 1), (None, hot, 1)]
    left = spark.createDataFrame(docs, "doc_id long, text string, phrase int")
    right = spark.createDataFrame([(f"p{k % 80}", p, 2) for k, p in enumerate(table)], "pid string, phrase string, text int")
    want = {(d, f"p{k % 80}") for d, t, _ in docs for k, p in enumerate(table) if d is not None and t and p and p in t}
    got = phrases.containing(left, "doc_id", "text", right, "pid", "phrase", block_chars)
    assert sorted((r.doc_id, r.pid) for r in got.collect()) == sorted(want) and len(want) > 300


def test_plans_have_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    few = docs.select(F.col("doc_id").alias("pid"), F.substring("text", 3, 28).alias("phrase"))
    for block in (10**6, 1):
        plan = phrases.containing(docs, "doc_id", "text", few, "pid", "phrase", block)
        assert plan.count() == 1
        assert not any(x in plan._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_long_texts_have_all_keys_of_their_parts():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdef ") for _ in range(3_000_000))
    whole = set(phrases.keys(data).tolist())
    for _ in range(50):
        at = rng.choice([rng.randrange(len(data)), (1 << 20) - rng.randrange(60)])
        assert set(phrases.keys(data[at : at + 40]).tolist()) <= whole
