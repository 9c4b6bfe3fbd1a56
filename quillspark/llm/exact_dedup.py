"""Exact dedup by an extendible-hash index on shared files.

1. Map tasks normalise each text, combine equal ones that they meet (so a hot text leaves a task
   once per flush, however many rows have it), and write entries to the shared folder.
2. A directory over hash prefixes starts with one bucket; while a bucket holds more entries than
   its capacity it is split, and the directory doubles when the bucket is as deep as itself.
   Only counts of prefixes are gathered, level by level and for overfull buckets alone.
3. Owner tasks each take a contiguous key range of whole buckets. They walk its entries in key
   order, chain different texts under one key, and decide equality by comparing bytes.
4. Entries are joined with the index on their text's digest, then unfolded to rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import remove, saved, shared_dir, small_batches, utf8

SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Key bits that one counting pass looks at; so many prefixes of an overfull bucket come to the driver.
STEP_BITS = 8
KEY_BITS = 60
#: A bucket this deep isn't split on: its owner streams through it, however full it is. Bounds the directory's slots.
MAX_DEPTH = 20


def _entries(flush_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pd.DataFrame:
            rows = [(xxhash.xxh64_intdigest(t) >> (64 - KEY_BITS), hashlib.sha256(t).digest(), t, ids) for t, ids in held.items()]
            return pd.DataFrame(rows, columns=["key", "sha", "body", "ids"])

        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                body = utf8(SPACES.sub(" ", text)) if text else b""
                i = None if pd.isna(i) else int(i)
                if body in held:
                    held[body].append(i)
                    size += 40
                else:
                    held[body] = [i]
                    size += len(body) + 200
            if size >= flush_bytes:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return run


class Directory:
    """The extendible directory: 2**depth slots, each naming a bucket; a bucket of local depth d has 2**(depth-d) slots."""

    def __init__(self) -> None:
        self.depth = 0
        self.buckets: dict[tuple[int, int], int] = {(0, 0): 0}  # (local depth, prefix) -> entries

    def split(self, depth: int, prefix: int, left: int, right: int) -> None:
        del self.buckets[depth, prefix]
        self.depth = max(self.depth, depth + 1)  # doubling
        self.buckets[depth + 1, 2 * prefix] = left
        self.buckets[depth + 1, 2 * prefix + 1] = right

    def owners(self, capacity: int) -> tuple[list[int], int]:
        """The owner of each slot, and their number: owners take buckets in key order up to about the capacity."""
        slots: list[int] = []
        owner = filled = 0
        for start, depth, n in sorted((p << (KEY_BITS - d), d, n) for (d, p), n in self.buckets.items()):
            if filled and filled + n > capacity:
                owner, filled = owner + 1, 0
            slots += [owner] * (1 << (self.depth - depth))
            filled += n
        return slots, owner + 1


def build_directory(keys: DataFrame, capacity: int) -> Directory:
    """Splits overfull buckets until none is left. `keys`: column key, one row per entry.

    At 2**STEP_BITS counts per overfull bucket and pass, and total / capacity buckets, the
    driver's share is bounded by the capacity, not by the rows.
    """
    directory = Directory()
    total = keys.count()
    directory.buckets[0, 0] = total
    over, base = [(0, 0)] if total > capacity else [], 0
    while over and base < MAX_DEPTH:
        bits = min(STEP_BITS, MAX_DEPTH - base)
        shift = KEY_BITS - base - bits
        found = keys.withColumn("prefix", F.shiftright("key", shift))
        if base:
            found = found.filter(F.shiftright("key", shift + bits).isin([p for _, p in over]))
        # distinct keys, since entries of one key can't be parted by splitting
        counts = {r[0]: (r[1], r[2]) for r in found.groupBy("prefix", "key").count().groupBy("prefix").agg(F.sum("count"), F.count("*")).collect()}
        level = over
        for d in range(bits):
            after = []
            for depth, prefix in level:
                rest = bits - d - 1
                halves = []
                for half in (2 * prefix, 2 * prefix + 1):
                    own = [counts.get((half << rest) + k, (0, 0)) for k in range(1 << rest)]
                    halves.append((sum(n for n, _ in own), sum(k for _, k in own)))
                directory.split(depth, prefix, halves[0][0], halves[1][0])
                after += [(depth + 1, half) for half, (n, k) in zip((2 * prefix, 2 * prefix + 1), halves, strict=True) if n > capacity and k > 1]
            level = after
        over, base = level, base + bits
    return directory


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries in key order -> one index row per text. Holds the chain of one key only: its different texts."""
    key: int | None = None
    chain: list[list] = []

    def out() -> pd.DataFrame:
        return pd.DataFrame({"key": key, "chain": range(len(chain)), "sha": [x[1] for x in chain], "keep_id": pd.array([x[2] for x in chain], "Int64"), "group_size": [x[3] for x in chain]})

    done: list[pd.DataFrame] = []
    for pdf in batches:
        for k, sha, body, low, n in zip(pdf["key"], pdf["sha"], pdf["body"], pdf["low"], pdf["n"], strict=True):
            low = None if pd.isna(low) else int(low)
            if k != key:
                if chain:
                    done.append(out())
                key, chain = k, []
            for link in chain:
                if link[0] == body:  # the bytes themselves
                    link[2] = low if link[2] is None else link[2] if low is None else min(link[2], low)
                    link[3] += n
                    break
            else:
                chain.append([body, sha, low, n])
        if done:
            yield pd.concat(done).astype({"keep_id": "Int64"})
            done = []
    if chain:
        yield out().astype({"keep_id": "Int64"})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12, flush_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same bytes remain after each run of ASCII white space became one space.
    A null text counts as empty. The smallest id of a group stays; null ids come last, and a group of
    null ids alone keeps them. Rows that repeat an id with an equal text are one document: they count
    in group_size and share its decision. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    entries = saved(slim.mapInPandas(_entries(flush_bytes), "key long, sha binary, body binary, ids array<long>"), f"{at}/entries")
    # so many slots at most, whatever the input
    capacity = max(capacity, entries.count() >> 17)
    directory = build_directory(entries.select("key"), capacity)
    slots, owners = directory.owners(capacity)
    # the directory's slots as one folded literal: looking up a key is one array access
    own = F.element_at(F.from_json(F.lit(str(slots)), "array<int>"), (F.shiftright("key", KEY_BITS - directory.depth) + 1).cast("int"))
    dealt = entries.select("key", "sha", "body", F.array_min("ids").alias("low"), F.size("ids").cast("long").alias("n"), own.alias("owner"))
    index = (
        dealt.repartition(owners, "owner")
        .sortWithinPartitions("key")
        .drop("owner")
        .mapInPandas(_chains, "key long, chain int, sha binary, keep_id long, group_size long")
    )
    index = saved(index, f"{at}/index").select("sha", "keep_id", "group_size")
    # texts are needed no more
    rows = saved(entries.select("sha", "ids"), f"{at}/rows")
    remove(spark, f"{at}/entries")
    rows = rows.join(index, "sha").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "sha")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))



def normalised_digest(text_col: str = "text"):
    """The digest by which exact_dedup tells texts apart, as a column."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
