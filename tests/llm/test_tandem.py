"""Periodic runs against all periods of all places, and the query against its contract in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.llm import registry, tandem


def brute(words, longest=None, least=0, times=2):
    """Maximal runs by comparing every word with the one a period later; of the periods of one stretch the smallest."""
    n, found = len(words), {}
    for q in range(1, (longest or n // times) + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and not any(s <= i and i + (j - i + q) <= s + length and q % p == 0 for (s, length), p in found.items()):
                found[i, j - i + q] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def test_all_runs_of_small_strings():
    rng = random.Random(3)
    for _ in range(600):
        n, kinds = rng.randint(1, 60), rng.choice([1, 2, 2, 3])
        s = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.4:
            s = s[: rng.randint(1, 9)] * rng.randint(2, 8) + s[:7] * 3
        got = tandem.runs(np.array(s), len(s))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == brute(s, len(s)), s


def test_fibonacci_and_thue_morse():
    a, b = "0", "01"
    for _ in range(9):
        a, b = b, b + a
    for s in (b, "".join(str(bin(k).count("1") % 2) for k in range(256))):
        got = tandem.runs(np.array([int(c) for c in s]), len(s))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == brute(s, len(s))


def test_batches_are_their_texts():
    rng = random.Random(4)
    texts = []
    for _ in range(120):
        words = [b"w%d" % rng.randrange(rng.choice([3, 50])) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            part = [b"w%d" % rng.randrange(9) for _ in range(rng.randint(1, 6))]
            words += (part * 9)[: rng.randint(3, 9 * len(part))]
        texts.append(words)
    got = tandem.batch_runs(texts)
    for words, found in zip(texts, got, strict=True):
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == brute(words, None, 6, 4)
    assert sum(len(f[0]) for f in got) > 60


def plain(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words, None, 6, 4)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def by_id(rows):
    return sorted((r if isinstance(r, dict) else r.asDict() for r in rows), key=str)


def test_query_against_plain(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {r.doc_id for r in docs if len((r.text or "").split()) < 1500}
    got = [r for r in registry.QUERIES["op11_runs"](spark, sf).collect() if r.doc_id in short]
    assert by_id(got) == by_id([plain(*r) for r in docs if r.doc_id in short])
    assert sum(r.n_runs > 0 for r in got) > 5


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, characters beyond ASCII that Unicode calls spaces."""
    more = spark.createDataFrame([(20, "a b " * 9 + "  x y  y z", "", 0, "", "", 0.0), (None, "é " * 7, "", 0, "", "", 0.0)], odd.schema)
    rows = odd.union(more).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    want = [r for r in rows.select("doc_id", "text").collect() if r.doc_id != 10]
    got = registry.QUERIES["op11_runs"](spark, f"file://{tmp_path}").collect()
    assert by_id([r for r in got if r.doc_id != 10]) == by_id([plain(*r) for r in want])
    assert len(got) == rows.count()
    out = tandem.periodic_runs(rows)
    assert out.columns == [*odd.columns, "runs", "collapsed"]
    assert tandem.periodic_runs(none).count() == 0


def test_long_text():
    """A million words of one period, and as many without any."""
    words = [b"w%d" % (k % 1000) for k in range(200_000)] + [b"v%d" % k for k in range(200_000)]
    (start, length, period), = tandem.batch_runs([words])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [1000])
    assert pd.Series(tandem.collapse(words, (start, length, period)).split()).nunique() == 201_000
