"""Substring dedup against a table of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import registry, suffixes


def brute(texts, least):
    """(n_removed, n_spans, kept) of each text of bytes."""
    count = Counter(hash(b[i : i + least]) for b in texts for i in range(len(b) - least + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - least + 1):
            if count[hash(b[i : i + least])] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        out.append((int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_multikey_quicksort():
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24))) for _ in range(500)] + [b"x" * 24] * 3
    order, common = suffixes.multikey(suffixes._words(rows, 24))
    got = [rows[i].ljust(24, b"\0") for i in order]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], common[1:], strict=False):
        assert n == next((k for k in range(24) if a[k] != b[k]), 24)


def test_equal_windows_have_equal_anchors(monkeypatch):
    """Each window lies in one context, and the anchor's distance follows from the window alone, in blocks too."""
    monkeypatch.setattr(suffixes, "BLOCK", 200)
    rng = random.Random(2)
    datas = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 5, 20, 21, 700, 1500)] + [b"a" * 300]
    seen, far = Counter(), {}
    for gram, _, k, start, size, before in suffixes.anchors_of(datas, 20, 6):
        for g, i, s, n, b in zip(gram, k, start, size, before, strict=True):
            for p in range(s, s + n):
                seen[i, p] += 1
                window = datas[i][p : p + 20]
                assert far.setdefault(window, (g, s + b - p)) == (g, s + b - p)
    assert seen == Counter((i, p) for i, d in enumerate(datas) for p in range(len(d) - 19))


def run(spark, texts, **how):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in suffixes.dedup_substrings(frame, **how).collect()}
    return [(sum(s["end"] - s["start"] for s in rows[k].spans), len(rows[k].spans), bytes(rows[k].kept)) for k in range(len(texts))]


def made(rng, n):
    """Texts of few letters with copies, near copies, passages in different surroundings and long repeats."""
    word = lambda k: "".join(rng.choice("abcde") for _ in range(k))
    parts = [word(rng.randint(10, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(parts)[rng.randint(0, 9) :] if rng.random() < 0.6 else word(rng.randint(0, 30)) for _ in range(rng.randint(0, 6)))
        texts.append(t)
        if rng.random() < 0.3 and t:
            k = rng.randrange(len(t))
            texts.append(t[:k] + "é" + t[k + 1 :])
        if rng.random() < 0.1:
            texts.append(t)
    return [*texts, "ab" * 90, "x" * 70, "", None]


def test_against_all_windows(spark):
    rng = random.Random(3)
    texts = made(rng, 150)
    want = brute([(t or "").encode() for t in texts], 24)
    assert run(spark, texts, least=24, gram=8) == want
    # many buckets: what repeats crosses their boundaries
    assert run(spark, texts, least=24, gram=8, bucket_bytes=1500) == want


def test_one_hot_passage_over_many_buckets(spark):
    """Texts share a passage shorter than what counts; some share more, on either side."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    hot, lefts, rights = word(20), [word(14) for _ in range(8)], [word(14) for _ in range(8)]
    texts = [word(9) + rng.choice(lefts)[rng.randint(0, 13) :] + hot + rng.choice(rights)[: rng.randint(0, 14)] + word(12) for _ in range(400)]
    want = brute([t.encode() for t in texts], 24)
    assert 0.2 < sum(n > 0 for n, _, _ in want) / len(want) < 1
    assert run(spark, texts, least=24, gram=8, bucket_bytes=1000) == want


def test_query_against_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.text or "").encode() for r in docs], 400)
    got = {r.doc_id: r for r in registry.QUERIES["op13_suffixes"](spark, sf).collect()}
    assert len(got) == len(docs) and sum(w[0] > 0 for w in want) > 5
    for r, (removed, spans, kept) in zip(docs, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len((r.text or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest())


def test_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    rows = odd.withColumn("kept", F.lit(1)).withColumn("row", F.lit(3)).withColumn("_id", F.lit(4))
    data = rows.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in data], brute([(r.text or "").encode() for r in data], 400), strict=True))
    out = suffixes.dedup_substrings(rows)
    assert out.columns == [*odd.columns, "row", "_id", "kept", "spans"]
    assert sorted((str(r.doc_id), (sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept))) for r in out.collect()) == want
    assert suffixes.dedup_substrings(none).count() == 0
