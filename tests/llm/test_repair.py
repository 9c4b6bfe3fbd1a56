"""Conversation repair against all edit sequences, and over pieces of any cut."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from quillspark.llm import registry, repair

PATTERN = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Least cost and its ASCII-least audit over all sequences of single edits, by a search over (row, roles so far)."""
    best = {}
    todo = [(0, "", 0, "")]
    limit = 4 * len(rows) + 1
    while todo:
        cost, audit, i, said = heapq.heappop(todo)
        if i == len(rows) and PATTERN.fullmatch(said):
            return cost, audit
        # what matters of the roles so far: whether anything was said, and the last turn
        key = (i, said[-2:] if len(said) > 1 else said)
        if best.get(key, (limit, "")) <= (cost, audit):
            continue
        best[key] = (cost, audit)
        if audit[-4:] != "IIII":
            todo_more = [(cost + 3, audit + "I", i, said + x) for x in "ua"]
        else:
            todo_more = []
        if i < len(rows):
            initial, fault = rows[i]
            todo_more.append((cost + 4, audit + "D", i + 1, said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                todo_more.append((cost + more, audit + "K", i + 1, said + initial))
                todo_more += [(cost + 3 + more, audit + "R", i + 1, said + x) for x in "ua"]
        for x in todo_more:
            if re.fullmatch(r"s?(ua)*u?", x[3]):
                heapq.heappush(todo, x)
    raise AssertionError


def audit_of(rows, cuts):
    layers = repair.Layers()
    edges = [0, *cuts, len(rows)]
    parts = [rows[a:b] for a, b in itertools.pairwise(edges)]
    cost, ways = repair.chain([repair.solve(p, layers) for p in parts])
    out = "".join("".join(repair.edits(p, *w, layers)) for p, w in zip(parts, ways, strict=True))
    return cost, out + repair.TAIL[ways[-1][1]]


def test_audit_is_the_least():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("uuuaaasst "), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 7))]
        want = brute(rows)
        assert audit_of(rows, []) == want, rows
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randint(0, len(rows) - 1))) if len(rows) > 1 else []
        assert audit_of(rows, cuts) == want, (rows, cuts)


def plain(rows):
    """One conversation's rows (turn, role, text), by the contract, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        kinds.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    cost, audit = brute(kinds) if rows else (0, "")
    said, lines, i = "", [], 0
    for e in audit:
        need = "a" if said.endswith("u") else "u"
        if e != "I":
            _, role, text = rows[i]
            i += 1
        if e == "D":
            continue
        line = {"I": (repair.ROLE[need], ""), "R": (repair.ROLE[need], text if e == "R" else ""), "K": (role, text) if e == "K" else None}[e]
        said += line[0][:1]
        lines.append(":".join(line))
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: sum(k == f for _, k in kinds) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(x + y not in ("su", "ua", "au") for (x, _), (y, _) in itertools.pairwise(kinds)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub(r"[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def held_to_plain(got, rows):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in rows]
    by: dict = {r[0]: [] for r in rows}
    for conv, *rest in harmed(rows):
        by[conv].append(tuple(rest))
    assert len(got) == len(by)
    for row in got:
        d = row.asDict()
        conv = d.pop("conv_id")
        assert d == plain(by[conv]), conv


def test_query_against_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held_to_plain(registry.QUERIES["op12_repair"](spark, sf).collect(), rows)


@pytest.fixture(scope="module")
def odd_turns(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["", " ", "Yes.", "No!", "half a", "\n\t", "Why? ", None, "é."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(words)) for c in [*range(40), None] for t in [*range(rng.randint(0, 5)), rng.randint(2, 9), None][: rng.randint(1, 7)]]
    rows += [(99, 3, "user", "Same.")] * 5 + [(98, t, "user" if t % 2 else "assistant", f"Turn {t % 90}.") for t in range(700)]
    at = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece int, pos int")
    frame.write.parquet(f"file://{at}/conversations.parquet")
    return f"file://{at}", rows


def test_odd_rows(spark, odd_turns):
    """Nulls in any column, blank and repeated rows, clashing columns, a long conversation over many pieces."""
    at, rows = odd_turns
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        held_to_plain(registry.QUERIES["op12_repair"](spark, at).collect(), rows)
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edited, counts = repair.repair(none)
    assert edited.count() == counts.count() == repair.digests(edited).count() == 0
