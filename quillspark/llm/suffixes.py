"""Substring dedup over sorted suffixes: bytes covered by a string of `least` bytes that stands elsewhere too are removed.

Which suffixes are sorted: of the grams (GRAM bytes) in each window of `least` bytes, the one with the smallest hash is
the window's anchor. Equal windows have it at the same place, so windows with one anchor, which follow each other, are
looked at together, as the anchor's context; a suffix begins at each anchor, about one in 140 bytes. Suffixes whose gram stands nowhere else are done, and contexts that are equal as a
whole are one, however often they stand. What is left, contexts that share a gram and differ somewhere, are sorted:

    sampled splitters range-partition the suffixes by their leading bytes, a bucket sorts its own by multikey quicksort
    over eight bytes at a time, and another such sort of what stands before the anchors, read backwards, gives
    common prefixes to both sides. A window that begins d bytes before its anchor is repeated if another suffix has the next
    `least` - d bytes in common and the d bytes before. Windows whose suffix shares these bytes with
    one of the bucket's two splitters may have their like in other buckets: those, a row per different window, are counted together.

A hot gram, or a group of copies, is therefore cut by the splitters like anything else, and never paired.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import _powers, mix64, remove, saved, shared_dir, shuffles_freed, small_batches

LEAST = 400
#: Bytes of a gram. Longer ones are rarer by chance, shorter ones make fewer anchors.
GRAM = 128
#: Bytes of documents that are hashed at once, and bits of a place there.
BLOCK, BITS = 1 << 19, 20
#: Bytes of sorted suffixes in a bucket, about, and sampled suffixes for each splitter.
BUCKET_BYTES, SAMPLED = 24 << 20, 40
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

ANCHORS = "gram long, a long, b long, id long, row long, start int, size int, before int"
SUFFIXES = "key binary, size int, before int, n long, id long, row long, start int"
SPANS = "id long, row long, start int, end int"


# --- anchors -------------------------------------------------------------------------------


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    n = len(v)
    rows = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = v
    rows = rows.reshape(-1, w)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(up[: n - w + 1], down[w - 1 : n])


def _contexts(block: list[tuple[int, int, bytes]], least: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Pieces (number, place, bytes) of documents, of `least` bytes at least each -> arrays gram, context (its digest as two numbers), piece, start, size, before."""
    buf = b"".join(p[2] for p in block)
    sizes = np.array([len(p[2]) for p in block])
    begin = np.cumsum(sizes) - sizes
    a = np.frombuffer(buf, np.uint8)
    up, down = _powers(len(a) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_VALUE[a] * up[: len(a)], out=run[1:])
        h = mix64((run[gram:] - run[:-gram]) * down[: len(a) - gram + 1])
    # of equal hashes the leftmost counts
    places = np.uint64((1 << BITS) - 1)
    anchor = (_smallest((h & ~places) | np.arange(len(h), dtype=np.uint64), least - gram + 1) & places).astype(np.int64)
    inside = np.zeros(len(a) + 1, np.int64)
    inside[begin] += 1
    np.add.at(inside, begin + sizes - least + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    cut = np.flatnonzero((np.diff(anchor[at]) != 0) | (np.diff(at) != 1))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    piece = np.searchsorted(begin, first, "right") - 1
    names = b"".join(hashlib.blake2b(buf[x : y + least], digest_size=16).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True))
    return h[anchor[first]].view(np.int64), np.frombuffer(names, np.int64).reshape(-1, 2), piece, first - begin[piece], last - first + 1, anchor[first] - first


def _pieces(k: int, data: bytes, least: int) -> Iterator[tuple[int, int, bytes]]:
    """A document in overlapping pieces, so that each window lies in one."""
    at = 0
    while len(data) - at >= least:
        yield k, at, data[at : at + BLOCK]
        at += BLOCK - least + 1


def anchors_of(datas: list[bytes], least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram, context, document's number, start, size, before) of all contexts: windows start .. start + size - 1, the anchor `before` bytes after start."""
    block: list[tuple[int, int, bytes]] = []

    def out() -> Iterator[tuple[np.ndarray, ...]]:
        found = _contexts(block, least, gram)
        number, place = (np.array([p[k] for p in block]) for k in (0, 1))
        block.clear()
        yield found[0], found[1], number[found[2]], place[found[2]] + found[3], found[4], found[5]

    size = 0
    for k, data in enumerate(datas):
        for piece in _pieces(k, data, least):
            if block and size + len(piece[2]) > 1 << BITS:
                yield from out()
                size = 0
            block.append(piece)
            size += len(piece[2])
    if block:
        yield from out()


def _anchored(least: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = pdf["id"].to_numpy(), pdf["row"].to_numpy()
            for g, context, k, start, size, before in anchors_of(pdf["data"].tolist(), least, gram):
                yield pd.DataFrame({"gram": g, "a": context[:, 0], "b": context[:, 1], "id": ids[k], "row": rows[k], "start": start, "size": size, "before": before})

    return run


# --- sorting -------------------------------------------------------------------------------


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of numbers of eight bytes."""
    return sum((x < np.uint64(1 << (8 * (8 - j)))).astype(np.int64) for j in range(1, 8)) + (x == 0)


def multikey(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long strings (rows of big-endian numbers of eight bytes): their order, and
    how many bytes each has in common with the one before it.

    Strings are sorted by one number; those that are equal so far go on with the next.
    """
    n, width = strings.shape
    order, common, group = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for d in range(width):
        if not len(active):
            break
        word, g = strings[order[active], d], group[active]
        sort = np.argsort(word, kind="quicksort")
        sort = sort[np.argsort(g[sort], kind="stable")]
        order[active], word = order[active][sort], word[sort]
        same = g[1:] == g[:-1]
        differ = word[1:] != word[:-1]
        at = np.flatnonzero(same & differ)
        common[active[at + 1]] = 8 * d + _common_bytes(word[at] ^ word[at + 1])
        head = np.concatenate(([True], ~same | differ))
        group[active] = active[head][np.cumsum(head) - 1]
        alone = head & np.append(head[1:], True)
        active = active[~alone]
    if len(active):
        common[active[1:][group[active][1:] == group[active][:-1]]] = 8 * width
    return order, common


def _words(rows: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), ">u8").astype(np.uint64).reshape(len(rows), width // 8)


def _shared(rows: np.ndarray, other: bytes) -> np.ndarray:
    """How many leading bytes each string has in common with another one."""
    x = rows ^ _words([other], rows.shape[1] * 8)
    first = np.argmax(x != 0, axis=1)
    at = x[np.arange(len(x)), first]
    return np.where(at == 0, rows.shape[1] * 8, 8 * first + _common_bytes(at))


def sorted_bucket(pdf: pd.DataFrame, low: bytes | None, high: bytes | None, least: int) -> pd.DataFrame:
    """A bucket's suffixes -> spans (id, row, start, end) of what is repeated within it, and windows (id, row, start, name, n) that may stand in other buckets.

    A key is the `least` bytes from the anchor on (zeros after the context's end), then what stands before it, backwards.
    """
    keys = pdf["key"].tolist()
    before, size, n = (pdf[c].to_numpy(np.int64) for c in ("before", "size", "n"))
    least_d = before - size + 1
    right, left = _words([k[:least] for k in keys], least), _words([k[least:] for k in keys], int(before.max()) or 1)
    by_right, common_right = multikey(right)
    by_left, common_left = multikey(left)
    place_right, place_left = np.argsort(by_right), np.argsort(by_left)
    beyond = np.zeros(len(keys), np.int64)
    for splitter in (low, high):
        if splitter is not None:
            beyond = np.maximum(beyond, _shared(right, splitter[:least]))
    nearest, farthest = np.full(len(keys), -1), np.full(len(keys), -1)
    open_windows: list[tuple] = []
    id_, row, start = (pdf[c].tolist() for c in ("id", "row", "start"))
    for d in range(int(before.max()) + 1):
        at = np.flatnonzero((least_d <= d) & (d <= before))
        if not len(at):
            continue
        r, x = np.cumsum(common_right < least - d)[place_right[at]], np.cumsum(common_left < d)[place_left[at]]
        _, one, kind = np.unique(r * (len(keys) + 1) + x, return_index=True, return_inverse=True)
        total = np.bincount(kind, n[at]).astype(np.int64)
        twice = at[total[kind] > 1]
        farthest[twice] = d
        nearest[twice] = np.where(nearest[twice] < 0, d, nearest[twice])
        for k in np.flatnonzero(beyond[at[one]] >= least - d).tolist():
            i = int(at[one[k]])
            window = keys[i][least : least + d][::-1] + keys[i][: least - d]
            open_windows.append((id_[i], row[i], start[i] + int(before[i]) - d, None, hashlib.blake2b(window, digest_size=16, salt=d.to_bytes(4, "big")).digest(), min(int(total[k]), 2)))
    # windows of one context overlap, so what they cover is one span
    hit = (farthest >= 0) & (n == 1)
    anchor = pdf["start"].to_numpy(np.int64) + before
    columns = (pdf["id"].to_numpy(), pdf["row"].to_numpy(), anchor - farthest, anchor - nearest + least)
    spans = [(*x, None, None) for x in zip(*(c[hit].tolist() for c in columns), strict=True)]
    out = pd.DataFrame(spans + open_windows, columns=["id", "row", "start", "end", "name", "n"])
    return out.astype({"end": "Int64", "n": "Int64"})


# --- the jobs ------------------------------------------------------------------------------


def _cut_out(least: int):
    """Documents with their wanted contexts -> a key for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, wanted, i, row in zip(pdf["data"], pdf["wanted"], pdf["id"], pdf["row"], strict=True):
                for w in wanted:
                    start, size, before = w["start"], w["size"], w["before"]
                    text = data[start : start + size - 1 + least]
                    out.append((text[before:][:least].ljust(least, b"\0") + text[:before][::-1], size, before, w["n"], i, row, start))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUFFIXES.split(", ")])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SUFFIXES.split(", ")])

    return run


def _name() -> tuple[Column, Column]:
    """What tells rows apart, id and row. Rows with equal ids and texts are alike in all that follows."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(F.col("text"), F.col("doc_id").isNull())


def _data() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary")


def repeated_spans(docs: DataFrame, at: str, least: int = LEAST, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Spans (id, row, start, end) of bytes that repeated strings cover; they may overlap. id and row are those of `_name`."""
    spark, (id_, row) = docs.sparkSession, _name()
    long = docs.select(id_.alias("id"), row.alias("row"), _data().alias("data")).filter(F.octet_length("data") >= least)
    anchors = saved(long.mapInPandas(_anchored(least, gram), ANCHORS), f"{at}/anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "ab" for f in (F.min, F.max))).filter("n > 1")
    # a table, so that both sides of the join are dealt for it alone and Spark may split a common gram
    grams = saved(grams.selectExpr("gram", "min_a = max_a and min_b = max_b as equal"), f"{at}/grams")
    shared = saved(anchors.join(grams, "gram").drop("gram"), f"{at}/shared")
    remove(spark, f"{at}/anchors")
    end = F.col("start") + F.col("size") - 1 + least
    names = [c.split()[0] for c in SPANS.split(", ")]
    whole = shared.filter("equal").withColumn("end", end).select(names)

    # contexts that share a gram with different ones, each once
    mixed = shared.filter("not equal")
    kinds = mixed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start", "size", "before")).alias("one"))
    kinds = saved(kinds.select("a", "b", "n", "one.*"), f"{at}/kinds")
    copies = mixed.join(kinds.filter("n > 1").select("a", "b"), ["a", "b"]).withColumn("end", end).select(names)
    wanted = kinds.groupBy("id", "row").agg(F.collect_list(F.struct("start", "size", "before", "n")).alias("wanted"))
    # equal rows give a context repeatedly, but it is one of several then anyway
    texts = long.join(wanted, ["id", "row"])
    suffixes = saved(texts.mapInPandas(_cut_out(least), SUFFIXES), f"{at}/suffixes")

    rows, size = suffixes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    parts = max(1, -(-size // bucket_bytes))
    splitters: list[bytes] = []
    if parts > 1:
        few = suffixes.select("key").sample(min(1.0, SAMPLED * parts / rows), seed=7)
        found = sorted(bytes(r["key"]) for r in few.collect())
        splitters = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    edges = spark.sparkContext.broadcast(splitters)
    bucket = F.pandas_udf(lambda s: pd.Series([bisect_right(edges.value, bytes(k)) for k in s], dtype="int32"), "int")

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        k, known = int(pdf["bucket"].iloc[0]), edges.value
        return sorted_bucket(pdf, known[k - 1] if k else None, known[k] if k < len(known) else None, least)

    dealt = suffixes.withColumn("bucket", bucket("key") if splitters else F.lit(0))
    local = saved(dealt.groupBy("bucket").applyInPandas(sort, f"{SPANS}, name binary, n int"), f"{at}/local")
    # across boundaries: windows of different buckets, counted by their names
    windows = local.filter("name is not null")
    twice = windows.groupBy("name").agg(F.sum("n").alias("total")).filter("total > 1").select("name")
    crossing = windows.filter("n = 1").join(twice, "name").withColumn("end", F.col("start") + least).select(names)
    return whole.unionByName(copies).unionByName(local.filter("name is null").select(names)).unionByName(crossing)


def _cut(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for b, s in zip(data, spans, strict=True):
        if s is None or not len(s):
            out.append((b, [], []))
            continue
        # a span is packed into one number
        s = np.sort(np.asarray(s, np.int64))
        start, end = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
        new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        low, high = start[new].tolist(), end[np.append(new[1:] - 1, len(s) - 1)].tolist()
        out.append((b"".join(b[x:y] for x, y in zip([0, *high], [*low, len(b)], strict=True)), low, high))
    return pd.DataFrame(out, columns=["kept", "starts", "ends"])


def dedup_substrings(docs: DataFrame, least: int = LEAST, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs and `kept`, the text's UTF-8 bytes without those in repeated strings, and `spans`, an array of
    (start, end) of what was removed, in bytes, neither overlapping nor touching.

    A string of `least` bytes is repeated if it begins at another place too, of the same text or another one; places
    are judged on the texts as they are given. Rows are texts like others if they repeat a doc_id, or all of a row, and if the doc_id is null.
    A null text is empty. Texts of any length are hashed in blocks. Columns of docs named kept or spans are replaced.
    kept may begin or end within a character. An empty table gives no rows.
    Windows that differ count as equal if their 128-bit digests are (equal contexts, and windows of different buckets).
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    with shuffles_freed(spark):
        spans = repeated_spans(docs, at, least, gram, bucket_bytes)
        packed = spans.select("id", "row", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long")).alias("span"))
        by_row = saved(packed.groupBy("id", "row").agg(F.collect_set("span").alias("_spans")), f"{at}/spans")
    kept = [c for c in docs.columns if c not in ("kept", "spans")]
    id_, row = _name()
    # longer than any column's name
    own = "_" * (1 + max(map(len, kept)))
    told = docs.select(*kept, F.struct(id_.alias("id"), row.alias("row")).alias(own))
    told = told.join(by_row.select(F.struct("id", "row").alias(own), F.col("_spans").alias(own + "s")), own, "left")
    cut = F.pandas_udf(_cut, "kept binary, starts array<long>, ends array<long>")
    told = told.select(*kept, cut(_data(), own + "s").alias(own))
    return told.select(*kept, F.col(f"{own}.kept").alias("kept"), F.zip_with(f"{own}.starts", f"{own}.ends", lambda x, y: F.struct(x.alias("start"), y.alias("end"))).alias("spans"))
