"""Exact and near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm.components import components
from quillspark.llm.exact_dedup import KEY_BITS, Directory, build_directory, exact_dedup
from quillspark.llm.near_join import Bands, near_join
from quillspark.llm.passages import compact_windows, repeated_passages, signatures

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, p, q):
    """Component of each id by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and q * len(x & y) >= p * len(x | y):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def varied(seed=1, families=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(500)]
    rows, i = [], 100
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 10, 20, 60, 200, 700]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 15 + 2))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)]
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80)])
def test_near_join_is_exact(spark, n, p):
    rows = varied(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join(df, n, p, 100).collect()}
    want = linked(rows, n, p, 100)
    assert got == {i: (len(shingles(t, n)), want[i]) for i, t in rows}


def test_near_join_odd_rows(spark, odd, none):
    got = near_join(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[11]] == [1, 1] and by[2][0].component_id == 1
    assert [by[k][0].n_shingles for k in (4, 5, 6, 7)] == [0, 0, 0, 1]
    assert [by[k][0].component_id for k in (4, 5, 6)] == [4, 5, 6]
    assert by[8][0].component_id == 7
    assert [r.component_id for r in by[None]] == [None, None]
    assert near_join(none).collect() == []


def test_hot_keys_take_the_other_way(spark, monkeypatch):
    from quillspark.llm import near_join as module

    monkeypatch.setattr(module, "SAMPLED", 1)
    monkeypatch.setattr(module, "HOT", 3)
    monkeypatch.setattr(module, "CHUNK", 4)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(module, "HELD", 500)
    rows = varied(9)
    got = {r.doc_id: r.component_id for r in near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 3, 90, 100)


@pytest.mark.parametrize(("p", "q"), [(90, 100), (80, 100)])
def test_linked_sizes_lie_in_neighbouring_bands(p, q):
    b = Bands(p, q)
    for n in range(1, 600):
        assert abs(b.of(n * q // p) - b.of(n)) <= 1


def test_sketches_never_differ_in_more_bits_than_sets_in_elements():
    rng, b = np.random.default_rng(0), Bands(90, 100)
    for n in (30, 200, 1500):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: -n // 25], rng.integers(0, 1 << 63, n // 30 + 1).astype(np.uint64)]))
        (i, kx, sx), (j, ky, sy) = b.sketches(x), b.sketches(y)
        low = min(i, j)
        u, v = (np.frombuffer(s[1] if k == low else s[0], np.uint64) for k, s in ((i, sx), (j, sy)))
        assert np.bitwise_count(u ^ v).sum() <= len(np.setxor1d(x, y))
        assert set(kx.tolist()) & set(ky.tolist())


def test_components(spark, tmp_path):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1064)]
    low = {x: x for e in links for x in e}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {x: find(x) for e in links for x in e if e[0] != e[1]}


def test_exact_dedup(spark):
    rows = [(k, f"t {k % 70}" + " \t" * (k % 3) + "x") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in exact_dedup(df, capacity=8, flush_bytes=500).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_odd_rows(spark, odd, none):
    got = exact_dedup(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.keep_id == 1]
    assert len(same) == 5 and {r.group_size for r in same} == {5}  # 1, 2, 11 twice, and a null id
    empty = [r for r in got if r.doc_id in (4, 5)] + [r for r in got if r.doc_id is None and r.keep_id == 4]
    assert {r.keep_id for r in empty} == {4} and len(empty) == 3
    assert exact_dedup(none).collect() == []


def test_directory_doubles_and_covers_all_keys(spark):
    keys = [k << (KEY_BITS - 9) for k in range(300)] + [5] * 50
    d = build_directory(spark.createDataFrame([(k,) for k in keys], "key long"), 16)
    slots, owners = d.owners(16)
    assert len(slots) == 1 << d.depth and slots == sorted(slots) and owners == slots[-1] + 1
    assert sum(d.buckets.values()) == len(keys)
    one = Directory()
    assert one.owners(10) == ([0], 1)


def naive_windows(x, t):
    out = set()
    for c, v in enumerate(x):
        if not v:
            continue
        a = b = c
        while a > 0 and x[a - 1] >= v:
            a -= 1
        while b + 1 < len(x) and x[b + 1] >= v:
            b += 1
        if b - a + 1 >= t:
            out.add((a, b, v))
    return out


def test_compact_windows_are_the_trees_nodes():
    rng = np.random.default_rng(5)
    for n, top in ((3, 50), (200, 10_000), (300, 12)):
        x = rng.integers(1, top, n).astype(np.uint64)
        x[[n // 3, 2 * n // 3]] = 0
        a, c, b = compact_windows(x, 7)
        assert {(i, j, int(x[k])) for i, k, j in zip(a.tolist(), c.tolist(), b.tolist(), strict=True)} == naive_windows(x.tolist(), 7)


def test_equal_passages_share_signatures():
    rng = np.random.default_rng(6)
    common = rng.integers(1, 1 << 40, 60).astype(np.uint64)
    x, y = (np.concatenate([rng.integers(1, 1 << 40, 200).astype(np.uint64), common, rng.integers(1, 1 << 40, 100).astype(np.uint64)]) for _ in range(2))
    # in every order: equal passages have the same smallest token
    for k in range(6):
        assert set(signatures(x, 46, range(k, k + 1))[0].tolist()) & set(signatures(y, 46, range(k, k + 1))[0].tolist())


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared = [text(rng.randrange(51, 140)) for _ in range(6)]
    rows = []
    for i in range(80):
        w = text(rng.randrange(10, 300))
        if i % 2:
            p = rng.choice(shared)
            at = rng.randrange(len(w))
            w[at:at] = p
        rows.append((i, " ".join(w)))
    seen, hit = defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                hit[i].update(range(k, k + 50))
    got = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert hit and set(got) == set(hit)
    assert all(hit[i] <= got[i] for i in hit)


def test_near_passages_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(4000)]
    rows = []
    for pair in range(40):
        p = [rng.choice(vocabulary) for _ in range(120)]
        edited = list(p)
        edited[60] = "other"  # five of 116 shingles
        for k, own in enumerate((p, edited)):
            rows.append((2 * pair + k, " ".join([rng.choice(vocabulary) for _ in range(80)] + own + [rng.choice(vocabulary) for _ in range(80)])))
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 0.95 * len(rows)


def test_passages_that_hold_a_common_block(spark):
    # the block is in many documents of smaller ids, which have nothing else of the passages
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(50_000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    block = text(45)
    rows = [(i, " ".join([*text(30), *block, *text(30)])) for i in range(100)]
    for i in range(100, 140, 2):
        passage = [*text(5), *block, *text(5)]
        rows += [(i + k, " ".join([*text(40), *passage, *text(40)])) for k in (0, 1)]
    found = {(r.doc_id, r.other_id) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i, i ^ 1) for i in range(100, 140)}


def test_units_of_a_group_meet(spark, monkeypatch):
    from quillspark.llm import passages as module

    rng = random.Random(12)
    block = [f"b{k}" for k in range(45)]
    rows = []
    for i in range(0, 40, 2):
        passage = [*(f"a{rng.random()}" for _ in range(6)), *block, *(f"c{rng.random()}" for _ in range(6))]
        rows += [(i + k, " ".join([*(f"d{rng.random()}" for _ in range(20)), *passage, *(f"e{rng.random()}" for _ in range(20))])) for k in (0, 1)]
    monkeypatch.setattr(module, "CHUNK", 3)
    found = {(r.doc_id, r.other_id) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i, i ^ 1) for i in range(40)}


def test_a_line_that_stands_elsewhere_too(spark):
    rng = random.Random(14)

    def text(n):
        return [f"w{rng.random()}" for _ in range(n)]

    rows = []
    for pair in range(60):
        line = text(40)
        passage = [*text(6), *line, *text(6)]
        once, twice = [*text(60), *passage, *text(60)], [*text(60), *line, *text(120), *passage, *text(60)]
        rows += [(2 * pair + k, " ".join(w)) for k, w in enumerate((once, twice) if pair % 2 else (twice, once))]
    got = {r.doc_id: (r.start_word, r.end_word) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        at = 220 if len(t.split()) > 300 else 60
        assert i in got and got[i][0] <= at and got[i][1] >= at + 52


def test_near_passages_at_the_limit_are_found(spark):
    # 51 words, one of them replaced: 42 of 52 shingles in common
    rng = random.Random(13)
    rows = []
    for pair in range(200):
        p = [f"p{rng.random()}" for _ in range(51)]
        edited = [*p[:25], "other", *p[26:]]
        rows += [(2 * pair + k, " ".join([*(f"a{rng.random()}" for _ in range(80)), *own, *(f"z{rng.random()}" for _ in range(80))])) for k, own in enumerate((p, edited))]
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 0.98 * len(rows)


def test_passages_odd_rows(spark, odd, none):
    got = repeated_passages(odd).collect()
    assert {1, 2, 3, 11} <= {r.doc_id for r in got} and not {None, 4, 5, 6, 7} & {r.doc_id for r in got}
    assert repeated_passages(none).collect() == []


def test_passages_around_a_common_quotation_are_found(spark):
    rng, rows, want = random.Random(8), [], {}
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for topic in range(10):
        quote = fresh(48)
        rows += [(topic * 100 + k, " ".join([*fresh(40), *quote, *fresh(40)])) for k in range(40)]
        around = [*fresh(6), *quote, *fresh(6)]
        for k in (40, 41):
            before = rng.randrange(20, 60)
            rows.append((topic * 100 + k, " ".join([*fresh(before), *around, *fresh(30)])))
            want[topic * 100 + k] = (before, before + 60)
    got = {r.doc_id: (r.start_word, r.end_word) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.fixture
def tables(monkeypatch):
    """Rows of the tables that passages are found by, by name."""
    from quillspark.llm import passages as module

    rows, before = {}, module.saved

    def saved(df, path):
        out = before(df, path)
        rows[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(module, "saved", saved)
    return rows


def test_texts_of_their_own_leave_few_rows(spark, tables):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.random()}" for _ in range(300))) for i in range(200)]
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
    assert sum(tables.values()) < len(rows)  # not a row for each window or token


def test_only_chunks_that_may_help_are_visited(spark, tables, monkeypatch):
    # every chunk has the block, one other at most what a stretch lacks a passage for
    from quillspark.llm import passages as module

    rng, rows = random.Random(31), []
    fresh = lambda n: [f"v{rng.random()}" for _ in range(n)]
    block = fresh(60)
    for i in range(0, 40, 2):
        passage = [*block, *fresh(30)]
        rows += [(i + k, " ".join([*fresh(20), *passage, *fresh(20)])) for k in (0, 1)]
    monkeypatch.setattr(module, "CHUNK", 3)
    got = {r.doc_id: (r.start_word, r.end_word, r.other_id) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: (20, 110) for i in range(40)}
    assert tables["visits"] <= 3 * len(rows)


def test_visits_beyond_the_rounds_are_made(spark, monkeypatch):
    # what a stretch lacks, other chunks have only in part, but for one
    from quillspark.llm import passages as module

    rng, rows = random.Random(32), []
    fresh = lambda n: [f"v{rng.random()}" for _ in range(n)]
    block = [fresh(45) for _ in range(3)]
    for i in range(0, 48, 2):
        passages = [[*fresh(6), *b, *fresh(6)] for b in block]
        rows.append((i, " ".join([*fresh(20), *passages[0], *fresh(20), *passages[1], *fresh(20)])))
        rows.append((i + 1, " ".join([*fresh(30), *passages[1], *fresh(20), *passages[2], *fresh(30), *passages[0]])))
    monkeypatch.setattr(module, "CHUNK", 2)
    monkeypatch.setattr(module, "VISIT_BYTES", 1)
    got = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add((r.start_word, r.end_word, r.other_id))
    want = {i: {(20, 77, i + 1), (97, 154, i + 1)} for i in range(0, 48, 2)}
    assert got == want | {i + 1: {(30, 87, i), (194, 251, i)} for i in range(0, 48, 2)}


def test_each_passage_has_one_of_its_rarest_tokens():
    from quillspark.llm.passages import rarest

    rng, t, p, q = np.random.default_rng(23), 46, 80, 100
    for n in (46, 60, 91, 91, 150, 300) * 40:
        common, known = rng.integers(1, 30, n), np.ones(n, bool)
        size = int(rng.integers(t, n + 1))
        at = int(rng.integers(0, n - size + 1)) + np.arange(size)
        # what the other stretch lacks are the rarest
        has = np.zeros(n, bool)
        has[at[np.argsort(common[at], kind="stable")[(q - p) * size // (p + q) :]]] = True
        assert has[rarest(common, known, t, p, q)].any()
