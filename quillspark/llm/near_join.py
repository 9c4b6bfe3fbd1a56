"""N-gram Jaccard join by parity sketches.

A document's set of shingle hashes is XOR-ed, one bit per shingle, into a sketch of B blocks of
2^64 bits, of which few are set; a block is held as the XOR of a random number for each set bit, so blocks that differ are hardly ever
equal by chance, however many documents there are. Flipping one bit per element, two sketches differ in at most as many bits as the sets
differ in elements. Shorter whole sketches, which are compared bit by bit, are held beside the blocks. Sets of sizes x and y with Jaccard similarity at least p / q differ in
D <= (x + y)(q - p) / (q + p) elements, so with B = D + 1 + s blocks at least s + 1 blocks are
equal (pigeonhole). Documents of a size band and the next are joined on equal blocks.

Each document leaves out its s commonest blocks, in one order for all: first by how common the block's rarest
shingle is in a sample of documents, then by how few shingles it has. Of s + 1 equal blocks, the last in that order
has s before it in either document, so both keep it. The sample changes which blocks are compared, never what is found.

Sets with the same 128-bit signature are one class, and only its smallest id takes part. In each group of equal
blocks every member is first compared with the group's smallest id alone, and links join components. Groups
that still hold several components then tell which components may be linked further: a forest over
components, never pairs. Of components so joined, each document outside of the largest one visits all others in chunks;
whole texts decide, and a link is given on only where it joins what wasn't joined. So no step's rows
grow with the square of a group, and no link that would join components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import mix64, remove, saved, shared_dir, shingle_hashes, small_batches, utf8, word_hashes
from quillspark.llm.components import components

#: Members of a group that one unit holds; others visit it one by one.
CHUNK = 1024
#: Shingles of a group of components that one unit holds, about.
HELD = 1 << 19
_SEED = np.uint64(0x5851F42D4C957F2D)


class Bands:
    """Sizes by band: sets that can be linked lie in one band or in neighbouring ones."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.first = [1, 2]

    def bound(self, k: int) -> int:
        while len(self.first) <= k:
            top = self.first[-1] - 1  # largest of the band before
            self.first.append(max(self.first[-1] + 1, top * self.q // self.p + 1))
        return self.first[k]

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            self.bound(len(self.first))
        return int(np.searchsorted(self.first, n, side="right")) - 1

    def differ(self, total: int) -> int:
        """The most elements that linked sets of so many elements together can differ in."""
        return total * (self.q - self.p) // (self.q + self.p)

    def sketches(self, members: np.ndarray, common: np.ndarray | None = None) -> tuple[int, np.ndarray, list[bytes]]:
        """The band of a set, its block keys, and its whole sketches: with the band before, and with the next.

        members ascend. common: for each the number of sampled documents that have it. The last bit of a key is that
        of the lower band, so it tells which of the two sketches it is of.
        """
        own, keys, whole = self.of(len(members)), [np.zeros(0, np.uint64)], []
        high, bit = members >> np.uint64(32), mix64(members ^ _SEED)
        for low in (own - 1, own):
            d = self.differ(self.bound(low + 1) - 1 + self.bound(low + 2) - 1) if low >= 0 else 0
            if not d:
                whole.append(b"")
                continue  # only equal sets are linked, and these are one class
            bits = 1 << max(8, self.bound(low + 2).bit_length())
            odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            whole.append(np.packbits(odd.astype(np.uint8)).tobytes())
            spare = max(1, d // 4)
            blocks = d + 1 + spare
            block = ((high * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)  # ascending, as the members are
            at = np.flatnonzero(np.diff(block, prepend=-1))
            value = np.zeros(blocks, np.uint64)
            value[block[at]] = np.bitwise_xor.reduceat(bit, at)
            # blocks by how common they are: what decides the order is the same for equal blocks
            rare = np.full(blocks, -(1 << 40))
            rare[block[at]] = np.bincount(block, minlength=blocks)[block[at]]
            if common is not None:
                rare[block[at]] -= np.minimum.reduceat(common, at) << 20
            with np.errstate(over="ignore"):
                name = mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(low) * np.uint64(0x100000001B3) + np.uint64(1 << 40))
                name = mix64(value + name)
            keep = np.lexsort((name, rare))[spare:]
            keys.append((name[keep] & ~np.uint64(1)) | np.uint64(low & 1))
        return own, np.concatenate(keys).view(np.int64), whole


class Common:
    """How many of the sampled documents have a shingle, for the commonest ones."""

    def __init__(self, shingles: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles, self.count = np.append(shingles[order], np.uint64((1 << 64) - 1)), np.append(count[order], 0)

    def of(self, members: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shingles, members)
        return np.where(self.shingles[at] == members, self.count[at], 0)


def sample_common(slim: DataFrame, n: int) -> Common:
    """Counts shingles in about SAMPLE documents, picked by a hash of their id; those in several of them, COMMON at most."""
    rate = max(1, slim.count() // SAMPLE)
    picked = slim.filter(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, at = word_hashes([utf8(t) for t in pdf["text"]])
            every = [np.unique(shingle_hashes(words[at[k] : at[k + 1]], n)) for k in range(len(pdf))]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *every]).view(np.int64)})

    rows = picked.mapInPandas(members, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return Common(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64))


def _sets(n: int, p: int, q: int, flush_bytes: int, common):
    """Texts -> their sets' signatures and block keys, equal sets of a task combined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(p, q)
        held: dict[tuple, list] = {}
        loose: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            rows = [(*k, ids, min(ids), *rest) for k, (ids, *rest) in held.items()] + loose
            return pd.DataFrame(rows, columns=["sig", "n", "ids", "low", "band", "keys", "before", "next"]).astype({"low": "Int64"})

        for pdf in batches:
            words, at = word_hashes([utf8(t) for t in pdf["text"]])
            for k, i in enumerate(pdf["id"]):
                members = np.unique(shingle_hashes(words[at[k] : at[k + 1]], n))
                if pd.isna(i) or not len(members):
                    loose.append((None, len(members), [None if pd.isna(i) else int(i)], None, 0, np.zeros(0, np.int64), b"", b""))
                    size += 200
                    continue
                with np.errstate(over="ignore"):
                    sig = np.array([members.sum(), mix64(members).sum()], np.uint64).tobytes()
                if (sig, len(members)) in held:
                    held[sig, len(members)][0].append(int(i))
                    size += 40
                else:
                    band, keys, whole = bands.sketches(members, common.value.of(members))
                    held[sig, len(members)] = [[int(i)], band, keys, *whole]
                    size += keys.nbytes + sum(map(len, whole)) + 300
            if size >= flush_bytes:
                yield out()
                held, loose, size = {}, [], 0
        if held or loose:
            yield out()

    return run


def _near(p: int, q: int):
    """Pairs with sizes and the sketches for their bands -> pairs that the sketches don't tell apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for n, m, x, y in zip(pdf["n_a"], pdf["n_b"], pdf["sketch_a"], pdf["sketch_b"], strict=True):
                differ = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                keep.append(differ * (q + p) <= (n + m) * (q - p))
            yield pdf.loc[keep, ["a", "b"]]

    return run


class Joined:
    """Labels joined so far in a unit."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.low.get(top, top)) != top:
            top = up
        while x != top:
            self.low[x], x = top, self.low.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.low[max(x, y)] = min(x, y)


def units(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
    """Rows in the order of their unit (the first `width` columns), as (the unit changed, the rest of the row)."""
    at = None
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
            yield row[:width] != at, row[width:]
            at = row[:width]


class Residents:
    """A unit's residents: ids, labels, sizes and sketches, of which a visitor is told those that may be linked with it."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.rows: list[tuple[int, int, bytes]] = []  # label, size, sketch
        self.tables: tuple | None = None

    def add(self, label: int, n: int, sketch: bytes) -> None:
        self.rows.append((label, n, sketch))

    def close_to(self, label: int, n: int, sketch: bytes) -> list[int]:
        if self.tables is None:
            words = len(self.rows[0][2]) // 8
            self.tables = np.array([r[0] for r in self.rows]), np.array([r[1] for r in self.rows]), np.frombuffer(b"".join(r[2] for r in self.rows), np.uint64).reshape(-1, words)
        labels, sizes, bits = self.tables
        at = np.flatnonzero((labels != label) & (np.abs(sizes - n) * (self.q + self.p) <= (sizes + n) * (self.q - self.p)))
        differ = np.bitwise_count(bits[at] ^ np.frombuffer(sketch, np.uint64)).sum(axis=1, dtype=np.int64)
        return at[differ * (self.q + self.p) <= (sizes[at] + n) * (self.q - self.p)].tolist()


def _forest(p: int, q: int):
    """Units (key, chunk) of residents, then visitors: (visits, label, n, sketch) -> labels that may be linked, one row for each that joins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[int, int]] = set()
        there, joined = Residents(p, q), Joined()
        for new, (visits, label, n, sketch) in units(batches, 2):
            if new:
                there, joined = Residents(p, q), Joined()
            if not visits:
                there.add(label, n, sketch)
            elif there.rows:
                for k in there.close_to(label, n, sketch):
                    other = there.rows[k][0]
                    if joined.find(label) != joined.find(other):
                        joined.join(label, other)
                        found.add((min(label, other), max(label, other)))
            if len(found) > 10_000:
                yield pd.DataFrame(sorted(found), columns=["a", "b"])
                found = set()
        yield pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return run


def _alike(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    common = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
    return q * common >= p * (len(x) + len(y) - common)


def _verify(n: int, p: int, q: int):
    """Units (hub, chunk) of the hub's texts, then its members': (visits, id, label, text) -> links (a: hub, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub: list[np.ndarray] = []
        at = None
        for pdf in batches:
            words, starts = word_hashes([utf8(t) for t in pdf["text"]])
            out = []
            for k, (a, chunk, visits, i) in enumerate(zip(pdf["key"], pdf["chunk"], pdf["visits"], pdf["id"], strict=True)):
                own = np.unique(shingle_hashes(words[starts[k] : starts[k + 1]], n))
                if (a, chunk) != at:
                    at, hub = (a, chunk), []
                if not visits:
                    hub.append(own)
                elif any(_alike(x, own, p, q) for x in hub):
                    out.append((a, i))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


#: Bits of the sketches that tell most texts of a unit apart.
UNIT_BITS = 1 << 10


def _settle(n: int, p: int, q: int):
    """Units of joined components, residents first, then visitors: (visits, id, label, text) -> links that join labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, joined, sets, at = Residents(p, q), Joined(), [], None
        for pdf in batches:
            words, starts = word_hashes([utf8(t) for t in pdf["text"]])
            out = []
            for k, (key, chunk, visits, i, label) in enumerate(zip(pdf["key"], pdf["chunk"], pdf["visits"], pdf["id"], pdf["label"], strict=True)):
                own = np.unique(shingle_hashes(words[starts[k] : starts[k + 1]], n))
                if (key, chunk) != at:
                    at, there, joined, sets = (key, chunk), Residents(p, q), Joined(), []
                sketch = np.packbits((np.bincount((own % np.uint64(UNIT_BITS)).astype(np.int64), minlength=UNIT_BITS) & 1).astype(np.uint8)).tobytes()
                if not visits:
                    there.add(label, len(own), sketch)
                    sets.append((i, own))
                elif sets:
                    for r in there.close_to(label, len(own), sketch):
                        other = there.rows[r][0]
                        if joined.find(label) != joined.find(other) and _alike(own, sets[r][1], p, q):
                            joined.join(label, other)
                            out.append((sets[r][0], i))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


#: Of how many documents one is in the sample that finds hot keys, and how many rows there make a key hot.
SAMPLED, HOT = 32, 16
#: Documents, about, whose shingles are counted to order blocks, and commonest shingles that are told of. Results don't depend on them.
SAMPLE, COMMON = 1 << 12, 1 << 16
#: Rows of a few numbers, at most, to be broadcast; more are joined.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_hubs(blocks: DataFrame, path: str) -> DataFrame:
    """(key, rep, n, hub): block rows whose key several reps have, with the smallest of these."""
    sample = blocks.filter(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0)
    hot = _small(saved(sample.groupBy("key").count().filter(F.col("count") >= HOT).select("key"), f"{path}/keys"))
    often = blocks.join(hot, "key")
    low = F.min(F.struct("rep", "n"))
    hubs = _small(saved(often.groupBy("key").agg(low.alias("hub"), F.max("rep").alias("top")), f"{path}/hubs"))
    by_key = Window.partitionBy("key")
    seldom = blocks.join(hot, "key", "left_anti").withColumns({"hub": low.over(by_key), "top": F.max("rep").over(by_key)})
    return often.join(hubs, "key").unionByName(seldom).filter("hub.rep < top").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("n_hub"))


def near_join(docs: DataFrame, words: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text", flush_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links of similarity p / q).

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle. A
    null or wordless text has no shingles and its own id as component. Rows that repeat an id are one
    document of several texts: links of either count. A null id is linked with nothing (component null).
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        common = spark.sparkContext.broadcast(sample_common(slim, words))
        sets = saved(slim.mapInPandas(_sets(words, p, q, flush_bytes, common), "sig binary, n long, ids array<long>, low long, band int, keys array<long>, before binary, next binary"), f"{at}/sets")
        # a task's class of equal sets goes by its smallest id; those of other tasks are linked by the signature
        known = sets.filter("sig is not null")
        equal = known.groupBy("sig", "n").agg(F.min("low").alias("a"), F.max("low").alias("top")).filter("a < top").drop("top")
        equal = saved(known.select("sig", "n", F.col("low").alias("b")).join(equal, ["sig", "n"]).filter("a < b").select("a", "b"), f"{at}/equal")
        blocks = known.select(F.col("low").alias("rep"), F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
        shared = saved(_with_hubs(blocks, f"{at}/hot"), f"{at}/shared")
        # a sketch goes by the lower one of the two bands that it is for
        sketches = known.select(F.col("low").alias("rep"), F.explode(F.array(F.struct((F.col("band") - 1).alias("at"), F.col("before").alias("sketch")), F.struct(F.col("band").alias("at"), F.col("next").alias("sketch")))).alias("s"))
        sketches = saved(sketches.select("rep", F.expr("s.at & 1").alias("odd"), "s.sketch").filter("length(sketch) > 0").distinct(), f"{at}/sketches")
        rows = saved(sets.select("low", "n", "ids"), f"{at}/rows")
        texts = slim.filter("id is not null")

        def with_texts(members: DataFrame, run, name: str) -> DataFrame:
            """Members of units (key, chunk, visits, id, label) with their texts, residents first -> links (a, b)."""
            both = _small(members).join(texts, "id").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "visits")
            return saved(both.select("key", "chunk", "visits", "id", "label", "text").mapInPandas(run, "a long, b long"), f"{at}/{name}")

        within = F.abs(F.col("n") - F.col("n_hub")) * (q + p) <= (F.col("n") + F.col("n_hub")) * (q - p)
        stars = shared.filter(F.col("rep") != F.col("hub")).filter(within).select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.expr("key & 1").alias("odd"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b")).distinct()
        for side in "ab":
            stars = stars.join(sketches.select(F.col("rep").alias(side), "odd", F.col("sketch").alias(f"sketch_{side}")), [side, "odd"])
        stars = saved(stars.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInPandas(_near(p, q), "a long, b long").distinct(), f"{at}/near")
        chunks = stars.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        members = stars.join(chunks, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("visits"), F.col("b").alias("id"))
        hubs = chunks.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("visits"), F.col("a").alias("id"))
        links = with_texts(saved(members.union(hubs).withColumn("label", F.lit(0).cast("long")), f"{at}/pairs"), _verify(words, p, q), "stars").union(equal)
        first = saved(components(links, f"{at}/cc1"), f"{at}/labels1")

        # groups of equal blocks that hold several components besides the smallest id, which all were compared with; of groups with the same members, one
        named = shared.filter("rep <> hub").join(first, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
        members_of = F.sum(F.xxhash64("rep").cast("decimal(38,0)"))
        split = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size"), members_of.alias("s")).filter("l < h")
        split = saved(split.groupBy("size", "s", F.expr("key & 1")).agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), f"{at}/split")
        rest = saved(named.join(_small(split), "key"), f"{at}/rest")
        remove(spark, f"{at}/shared")
        # the largest component of a group stays at home: of two components, one visits the other at least
        largest = rest.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
        part = rest.join(largest, "key").withColumn("odd", F.expr("key & 1")).join(sketches, ["rep", "odd"])
        home = F.array(F.struct(F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("visits")))
        away = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("visits")))
        told = part.select("key", "label", "n", "sketch", F.explode(F.when(F.col("label") == F.col("largest"), home).otherwise(F.concat(home, away))).alias("u"))
        told = told.select("key", "u.chunk", "u.visits", "label", "n", "sketch").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "visits")
        forest = saved(told.mapInPandas(_forest(p, q), "a long, b long"), f"{at}/forest")
        labels = first
        if forest.take(1):
            areas = saved(components(forest, f"{at}/cc2"), f"{at}/areas").select(F.col("node").alias("label"), F.col("label").alias("key"))
            own = rest.select("rep", "n").distinct().join(first, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("label", "rep").alias("label"))
            own = saved(own.join(areas, "label"), f"{at}/own")
            sized = own.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.greatest(F.ceil(F.sum("s") / HELD), F.ceil(F.sum("c") / CHUNK)).cast("int").alias("chunks"))
            members = own.join(sized, "key").select("key", "label", F.col("rep").alias("id"), F.explode(F.when(F.col("label") == F.col("largest"), home).otherwise(F.concat(home, away))).alias("u"))
            more = with_texts(saved(members.select("key", "u.chunk", "u.visits", "id", "label"), f"{at}/members"), _settle(words, p, q), "more")
            labels = saved(components(links.union(more), f"{at}/cc3"), f"{at}/labels2") if more.take(1) else first
    for name in ("sets", "sketches", "hot", "near", "pairs", "stars", "equal", "split", "rest", "forest", "areas", "own", "members", "more", "cc1", "cc2", "cc3"):
        remove(spark, f"{at}/{name}")
    rows = rows.join(labels, F.col("low") == F.col("node"), "left").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "low").alias("c"))
    return rows.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
