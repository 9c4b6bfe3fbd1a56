"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?.

Each row takes one macro edit: a run of inserts, then Keep, Rerole or Delete of the row itself. Macro
edits form a prefix-free code, so two edit sequences of the same rows compare, as strings, like their
sequences of macro edits. A layer of the dynamic program therefore needs no strings: for each state of the role automaton it has a
cost, a rank among the layer's strings, and the parent state and macro edit. The strings come
back from the parent pointers. Layers differ by few cost differences and ranks, so a
step is looked up once it was computed.

A conversation of any length is cut into pieces by a range partitioning over its order. A piece is solved for every state
that it may be entered in, which gives a four by four table of costs and ranks; the tables of a conversation are chained, and each
piece is then rebuilt from the state that it is entered in to the one that it is left in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, shared_dir, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. For each, the state after one more turn of a role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = [{"u": USER, "s": SYSTEM}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The only turn that may be inserted, or that a row may become, in a state.
NEXT = ["u", "u", "a", "u"]
ROLE = {"u": "user", "a": "assistant"}
#: Inserts that end a conversation in each state.
TAIL = ["", "II", "I", ""]
LEGAL = {"su", "ua", "au"}
FAULTS = ("", "blank", "duplicate", "truncated")


def _macros(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, edits) of one row, the best for each pair of states. Longer runs of inserts come back to a state at a cost."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if fault == "truncated" else 0
    for source in range(4):
        state = source
        for n in range(3):
            ends = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                ends.append((AFTER[state][NEXT[state]], REROLE + more, "R"))
                if not initial or initial in AFTER[state]:
                    ends.append((AFTER[state][initial] if initial else state, KEEP + more, "K"))
            for to, cost, edit in ends:
                found = (cost + n * INSERT, "I" * n + edit)
                best[source, to] = min(best.get((source, to), found), found)
            state = AFTER[state][NEXT[state]]
    return [(source, to, *found) for (source, to), found in best.items()]


class Layers:
    """Steps of the dynamic program. A layer has a (cost, rank) for each state, or None; costs are differences to the layer's least."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.macros: dict[tuple[str, str], list] = {}

    def step(self, layer: tuple, initial: str, fault: str) -> tuple[tuple, int, tuple]:
        """The next layer, what its least cost adds, and each state's parent (state, edits)."""
        key = (layer, initial, fault)
        if key not in self.known:
            kind = (initial if initial in ("u", "a", "s", "") else "?", fault)
            if kind not in self.macros:
                self.macros[kind] = _macros(*kind)
            best: list = [None] * 4
            for source, to, cost, edits in self.macros[kind]:
                if layer[source] is not None:
                    found = (layer[source][0] + cost, layer[source][1], edits, source)
                    best[to] = found if best[to] is None else min(best[to], found)
            self.known[key] = _ranked(best)
        return self.known[key]


def _ranked(best: list) -> tuple[tuple, int, tuple]:
    """From (cost, parent's rank, order, parent) of each state to a layer, its least cost and the parents."""
    there = [x for x in best if x is not None]
    least = min(x[0] for x in there)
    order = {x[1:3]: k for k, x in enumerate(sorted(there, key=lambda x: x[1:3]))}
    return tuple(x and (x[0] - least, order[x[1:3]]) for x in best), least, tuple(x and (x[3], x[2]) for x in best)


def _entered(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def solve(rows: list[tuple[str, str]], layers: Layers) -> list[list[tuple[int, int] | None]]:
    """A piece's rows (initial, fault) -> for each state it is entered in, (cost, rank) for each it is left in."""
    table = []
    for entry in range(4):
        layer, total = _entered(entry), 0
        for initial, fault in rows:
            layer, more, _ = layers.step(layer, initial, fault)
            total += more
        table.append([x and (x[0] + total, x[1]) for x in layer])
    return table


def chain(tables: list[list[list[tuple[int, int] | None]]]) -> tuple[int, list[tuple[int, int]]]:
    """Tables of a conversation's pieces -> the least cost, and the states in which each piece is entered and left."""
    layer: list = [(0, 0), None, None, None]
    parents = []
    for table in tables:
        best: list = [None] * 4
        for entry in range(4):
            for leave in range(4):
                if layer[entry] is not None and table[entry][leave] is not None:
                    found = (layer[entry][0] + table[entry][leave][0], layer[entry][1], table[entry][leave][1], entry)
                    best[leave] = found if best[leave] is None else min(best[leave], found)
        ranked, least, back = _ranked(best)
        layer = [x and (x[0] + least, x[1]) for x in ranked]
        parents.append(back)
    cost, _, state = min((x[0] + INSERT * len(TAIL[s]), x[1], s) for s, x in enumerate(layer) if x is not None)
    ways = []
    for back in reversed(parents):
        ways.append((back[state][0], state))
        state = back[state][0]
    return cost, ways[::-1]


def edits(rows: list[tuple[str, str]], entry: int, leave: int, layers: Layers) -> list[str]:
    """The macro edit of each row of a piece."""
    layer, parents = _entered(entry), []
    for initial, fault in rows:
        layer, _, back = layers.step(layer, initial, fault)
        parents.append(back)
    out, state = [], leave
    for back in reversed(parents):
        state, edit = back[state]
        out.append(edit)
    return out[::-1]


# --- the jobs ------------------------------------------------------------------------------

def _ordered(turns: DataFrame, at: str) -> DataFrame:
    """Rows with their place `pos` in one order of all conversations, their piece's number, and their fault."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text")
    rows = rows.withColumn("said", F.unhex(F.sha2(name, 256)))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    again = rows.groupBy("said").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(again, "said", "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    # equal rows of one turn stand together, since their range keys are equal
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", "said", "later", F.monotonically_increasing_id().alias("pos"))
    dealt = saved(dealt, f"{at}/ordered")
    seen = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    return dealt.withColumns({"piece": F.shiftright("pos", 33), "blank": F.trim(seen) == "", "cut": ~F.rtrim(seen).rlike(r"[.!?]\z")})


def _null(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _faulty(pdf: pd.DataFrame, before: list) -> Iterator[tuple]:
    """Rows of sorted batches with their fault; before: what the last row was, for equal rows of one turn."""
    for row in pdf.itertuples(index=False):
        conv, turn = _null(row.conv_id), _null(row.turn)
        now = (conv, row.piece, turn, row.said)
        fault = "blank" if row.blank else "duplicate" if row.later or now == before[0] else "truncated" if row.cut else ""
        before[0] = now
        yield conv, turn, fault, row


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    layers, before, at, rows, counts = Layers(), [None], None, [], {}
    done: list[tuple] = []

    def end() -> None:
        if at is not None:
            table = solve(rows, layers)
            pairs = sum(x + y not in LEGAL for (x, _), (y, _) in zip(rows, rows[1:], strict=False))
            flat = [v for entry in table for x in entry for v in (x or (-1, -1))]
            done.append((*at, flat, *(sum(f == x for _, f in rows) for x in FAULTS[1:]), pairs, rows[0][0], rows[-1][0], counts["low"], counts["high"], counts["turns"]))

    for pdf in batches:
        for conv, turn, fault, row in _faulty(pdf, before):
            if at != (conv, row.piece):
                end()
                at, rows, counts = (conv, row.piece), [], {"low": None, "high": None, "turns": 0}
            rows.append((row.role[:1], fault))
            if turn is not None and turn != counts["high"]:
                counts |= {"low": turn if counts["low"] is None else counts["low"], "high": turn, "turns": counts["turns"] + 1}
        if done:
            yield _frame(done, PIECES)
    end()
    if done:
        yield _frame(done, PIECES)


PIECES = "conv_id long, piece long, steps array<long>, blank long, duplicate long, truncated long, illegal long, head string, foot string, low long, high long, turns long"
WAYS = "conv_id long, piece long, entry int, leave int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
REPAIRED = "conv_id long, pos long, k int, edit string, fault string, role string, text string"


def _frame(done: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split() for x in schema.split(", ")]
    out = pd.DataFrame(done, columns=[n for n, _ in names])
    done.clear()
    return out.astype({n: {"long": "Int64", "int": "Int32"}[t] for n, t in names if t in ("long", "int")})


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by conversation -> how each is passed, and on the first of a conversation its counts, else nulls."""
    at: object = batches
    pieces: list = []
    done: list[tuple] = []

    def end() -> None:
        if not pieces:
            return
        cost, ways = chain([[[None if steps[(8 * e + 2 * x)] < 0 else (int(steps[8 * e + 2 * x]), int(steps[8 * e + 2 * x + 1])) for x in range(4)] for e in range(4)] for steps in (p.steps for p in pieces)])
        known = [p for p in pieces if _null(p.low) is not None]
        turns = sum(p.turns for p in known) - sum(p.high == q.low for p, q in zip(known, known[1:], strict=False))
        gaps = known[-1].high - known[0].low + 1 - turns if known else 0
        illegal = sum(p.illegal for p in pieces) + sum(p.foot + q.head not in LEGAL for p, q in zip(pieces, pieces[1:], strict=False))
        total = (gaps, *(sum(getattr(p, f) for p in pieces) for f in FAULTS[1:]), illegal, cost)
        for k, (p, way) in enumerate(zip(pieces, ways, strict=True)):
            done.append((at, p.piece, *way, k == len(pieces) - 1, *(total if k == 0 else [None] * 6)))

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if _null(row.conv_id) != at:
                end()
                at, pieces = _null(row.conv_id), []
            pieces.append(row)
        if done:
            yield _frame(done, WAYS)
    end()
    if done:
        yield _frame(done, WAYS)


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    layers, before, at, rows, way = Layers(), [None], None, [], None
    done: list[tuple] = []

    def end() -> None:
        if at is None:
            return
        state = way[0]
        for edit, (initial, fault, pos, role, text) in zip(edits([r[:2] for r in rows], way[0], way[1], layers), rows, strict=True):
            for k, e in enumerate(edit):
                if e in "IR":
                    done.append((at[0], pos, k, e, "" if e == "I" else fault, ROLE[NEXT[state]], "" if e == "I" else text))
                    state = AFTER[state][NEXT[state]]
                else:
                    done.append((at[0], pos, k, e, fault, role if e == "K" else None, text if e == "K" else None))
                    state = AFTER[state][initial] if e == "K" and initial else state
        for k, _ in enumerate(TAIL[state] if way[2] else ""):
            done.append((at[0], rows[-1][2], k + 3, "I", "", ROLE[NEXT[state]], ""))
            state = AFTER[state][NEXT[state]]

    for pdf in batches:
        for conv, _, fault, row in _faulty(pdf, before):
            if at != (conv, row.piece):
                end()
                at, rows, way = (conv, row.piece), [], (int(row.entry), int(row.leave), bool(row.last))
            rows.append((row.role[:1], fault, row.pos, row.role, row.text))
        if done:
            yield _frame(done, REPAIRED)
    end()
    if done:
        yield _frame(done, REPAIRED)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text) -> one row per edit, and one per conversation that has rows.

    Edits: conv_id, pos and k (their order), edit (I, K, R or D), fault of the row that it is for, role and text as
    repaired (null if deleted). Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    Rows are taken by turn, nulls first, then role and text, so the order of the table doesn't matter; repeated rows
    are duplicates but for one. A null role or text counts as one space, a null conv_id names a conversation, a role
    without characters may be kept anywhere. Other columns are ignored; an empty table gives no rows.
    A task holds a piece of a conversation (a range partition at most), not the whole of it.
    """
    spark = turns.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    rows = _ordered(turns, at)
    slim = rows.select("conv_id", "piece", "pos", "turn", F.left("role", F.lit(1)).alias("role"), "said", "later", "blank", "cut")
    pieces = slim.repartition("piece").sortWithinPartitions("pos").mapInPandas(_pieces, PIECES)
    ways = saved(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInPandas(_chained, WAYS), f"{at}/ways")
    passed = ways.select(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), "entry", "leave", "last")
    told = rows.join(passed, rows["conv_id"].eqNullSafe(passed["_conv"]) & (rows["piece"] == passed["_piece"])).drop("_conv", "_piece")
    rebuilt = told.repartition("piece").sortWithinPartitions("pos").mapInPandas(_rebuilt, REPAIRED)
    return rebuilt, ways.filter("cost is not null").drop("piece", "entry", "leave", "last")


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at: object = batches
    audit: list[str] = []
    done: list[tuple] = []
    digest, lines = hashlib.sha256(), 0

    def end() -> None:
        if audit:
            done.append((at, "".join(audit), digest.hexdigest()))

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if _null(row.conv_id) != at:
                end()
                at, audit, digest, lines = _null(row.conv_id), [], hashlib.sha256(), 0
            audit.append(row.edit)
            if row.edit != "D":
                digest.update(("\n" * bool(lines) + row.role + ":" + row.text).encode("utf-8", "surrogatepass"))
                lines += 1
        if done:
            yield _frame(done, "conv_id long, audit string, repaired_sha256 string")
    end()
    if done:
        yield _frame(done, "conv_id long, audit string, repaired_sha256 string")


def digests(edited: DataFrame) -> DataFrame:
    """Edits -> conv_id, audit (the edits in order), repaired_sha256 (`role:text` lines). A conversation's text is streamed, never held."""
    dealt = edited.select("conv_id", "pos", "k", "edit", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k")
    return dealt.mapInPandas(_digested, "conv_id long, audit string, repaired_sha256 string")
