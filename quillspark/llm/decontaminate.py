"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items (one symbol per word) is built on the driver from a table of checked
size and broadcast. A larger table is cut into blocks: tasks build a block's automaton, and only documents that share a
window's key with the block, the smallest hash of a word in it, are searched by it; what blocks find is merged once. A document's words run through the
automaton, which gives at each word the longest suffix that occurs in some item. Where that is
at least the window length, the last `window` words occur in an item; the state that holds just
those words knows which items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import mix64, saved, shared_dir, small_batches, utf8, word_hashes

#: Bytes that no word has: ASCII but for digits and lower-case letters, after lower-casing A-Z.
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Automaton:
    """A generalised suffix automaton over word hashes, with the items of each window."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int) -> None:
        self.window = window
        words = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w for _, w in items]]))
        self.vocabulary = words
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, np.searchsorted(words, w).tolist()) for i, w in items if len(w)]
        for _, w in coded:
            last = 0
            for c in w:
                last = self._extend(last, c)
        #: state -> {length: items}; a length within the state's own range of suffix lengths
        self.items: dict[int, dict[int, set]] = {}
        self.shortest = window
        for i, w in coded:
            k = min(window, len(w))
            self.shortest = min(self.shortest, k)
            state = 0
            for at, c in enumerate(w):
                state = self.next[state][c]
                if at + 1 >= k:
                    found = state
                    while self.length[self.link[found]] >= k:
                        found = self.link[found]
                    self.items.setdefault(found, {}).setdefault(k, set()).add(i)
        # nearest state on the way of suffix links, itself included, that holds a window
        self.holder = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.holder[s] = s if s in self.items else self.holder[self.link[s]] if s else -1

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return state

    def scan(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans inside occurring windows, and the items that these windows are of."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if not len(self.vocabulary) or not len(words):
            return spans, items
        code = np.searchsorted(self.vocabulary, words)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == words
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin < self.shortest:
                continue  # no window fits between two unknown words
            state = length = 0
            for at, c in enumerate(code[begin:end].tolist(), begin):
                while c not in self.next[state] and state:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    length += 1
                if length < self.shortest:
                    continue
                holder, longest = self.holder[state], 0
                while holder > 0:
                    for k, own in self.items[holder].items():
                        if k <= length:
                            items |= own
                            longest = max(longest, k)
                    holder = self.holder[self.link[holder]]
                if longest:
                    start = at + 1 - longest
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, items


def _slim(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")


def _automaton(rows: list[tuple[int | None, str]], window: int) -> Automaton:
    return Automaton([(i, word_hashes([utf8(t)], NO_WORD)[0]) for i, t in rows], window)


def _keys(words: np.ndarray, k: int) -> np.ndarray:
    """The smallest word hash of each k words in a row, each once; it tells windows of other lengths apart."""
    if len(words) < k or not k:
        return np.zeros(0, np.int64)
    own = mix64(words ^ np.uint64(k))
    return np.unique(np.lib.stride_tricks.sliding_window_view(own, k).min(axis=1)).view(np.int64)


def _keyed(lengths: list[int] | None, window: int):
    """Texts -> the keys of all their windows of some lengths; without any, of the one window length that an item has."""

    def keys(texts: pd.Series) -> pd.Series:
        words, at = word_hashes([utf8(t) for t in texts], NO_WORD)
        each = [words[at[k] : at[k + 1]] for k in range(len(texts))]
        return pd.Series([np.concatenate([_keys(w, k) for k in (lengths or [min(window, len(w))])]) for w in each])

    return F.pandas_udf(keys, T.ArrayType(T.LongType()))


@F.pandas_udf(T.LongType())
def _count(texts: pd.Series) -> pd.Series:
    return pd.Series(np.diff(word_hashes([utf8(t) for t in texts], NO_WORD)[1]))


FOUND = "row long, id long, spans array<struct<start:int,end:int>>, items array<bigint>"
#: Characters of documents that one task searches by one block's automaton, about.
SEARCHED = 8 << 20


def _name(id_col: str | None, text_col: str) -> tuple[Column, Column]:
    """What tells texts apart: a document's id, if it has one, and its text. Equal rows have equal spans."""
    return F.coalesce(F.col(id_col).cast("long") if id_col else F.lit(0).cast("long"), F.lit(0).cast("long")), F.xxhash64(F.col(text_col))


def _by_blocks(texts: DataFrame, items: DataFrame, window: int, n: int) -> DataFrame:
    """(row, id, spans, items) of texts (row, id, text) with a window of some item: spans merged, items ascending."""
    at = shared_dir(texts.sparkSession)
    parts = saved(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).withColumn("keys", _keyed(None, window)("text")), f"{at}/items")
    size = F.least(F.lit(window), _count("text").cast("int"))
    lengths = sorted(r[0] for r in parts.select(size.alias("k")).distinct().collect() if r[0])
    wanted = saved(parts.select("block", F.explode("keys").alias("key")).distinct(), f"{at}/keys")
    texts = texts.filter("text is not null")
    has = texts.select("row", "id", F.explode(_keyed(lengths or [window], window)("text")).alias("key"))
    pairs = saved(has.join(wanted, "key").select("row", "id", "block").distinct(), f"{at}/pairs")
    told = texts.dropDuplicates(["row", "id"]).join(pairs, ["row", "id"])
    chunks = told.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / SEARCHED).cast("int").alias("chunks"))
    chunks = saved(chunks.withColumn("chunks", F.greatest("chunks", F.lit(1))), f"{at}/chunks")
    left = told.join(chunks, "block").withColumn("chunk", F.pmod(F.col("row"), F.col("chunks")).cast("int")).select("block", "chunk", "row", "id", "text")
    right = parts.select("block", F.col("id").alias("item"), F.col("text").alias("item_text")).join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "item", "item_text")

    def search(docs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs):
            automaton = _automaton([(None if pd.isna(i) else int(i), t) for i, t in zip(own["item"], own["item_text"], strict=True)], window)
            for row, i, text in zip(docs["row"], docs["id"], docs["text"], strict=True):
                found, ids = automaton.scan(word_hashes([utf8(text)], NO_WORD)[0])
                if found:
                    out.append((row, i, [{"start": a, "end": b} for a, b in found], sorted(x for x in ids if x is not None)))
        return pd.DataFrame(out, columns=["row", "id", "spans", "items"])

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(search, FOUND)
    merged = F.aggregate("all", F.array().cast("array<struct<start:int,end:int>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]),
        F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
    ).otherwise(F.array_append(out, s)))
    all_of = found.groupBy("row", "id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return saved(all_of.select("row", "id", merged.alias("spans"), "items"), f"{at}/found")


def _number_of_blocks(items: DataFrame, block_chars: int) -> int:
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return -(-total // block_chars) or 1


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, text, n_words, spans (array of word start and end, merged), items (ids, ascending).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    `window` consecutive words of an item, or a whole shorter item. Null and empty texts have no
    words and no hits, as have all documents when there are no items. Repeated rows are matched each;
    an item whose id is null marks words, but is not listed. Other columns of both tables are left out, whatever their names; an
    empty table of documents gives no rows. The size of the blocks doesn't change the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = _slim(items, item_col, item_text_col)
    n = _number_of_blocks(own, block_chars)
    if n > 1:
        id_, row = _name("doc_id", "text")
        named = slim.withColumns({"row": row, "id": id_})
        found = _by_blocks(named.select("row", "id", "text"), own, window, n)
        out = named.join(found, ["row", "id"], "left").withColumn("n_words", _count("text"))
        return out.select("doc_id", "text", "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("spans", "array<struct<start:int,end:int>>"), ("items", "array<bigint>"))))
    automaton = spark.sparkContext.broadcast(_automaton([(r["id"], r["text"]) for r in own.collect()], window))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = automaton.value
        for pdf in batches:
            words, at = word_hashes([utf8(t) for t in pdf["text"]], NO_WORD)
            found = [held.scan(words[at[k] : at[k + 1]]) for k in range(len(pdf))]
            yield pdf.assign(n_words=np.diff(at), spans=[[{"start": a, "end": b} for a, b in s] for s, _ in found], items=[sorted(x for x in ids if x is not None) for _, ids in found])

    return slim.mapInPandas(run, "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<bigint>")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """docs, its text without the spans of benchmark items, plus n_cut (words cut) and dropped (the cut share exceeds max_share).

    Spans of at least `window` words (or a whole shorter item) are cut from the start of their first word
    to the start of the word after; the rest is unchanged, as are all other columns. Null texts stay
    null. Columns of docs named n_cut and dropped are replaced. Spans of all blocks of items are found in the unchanged text
    and cut at once, so the size of the blocks doesn't change the result.
    """
    small_batches(docs.sparkSession)
    own = _slim(items, item_col, item_text_col)
    n = _number_of_blocks(own, block_chars)
    # longer than any column's name
    name = "_" * (1 + max(map(len, docs.columns)))
    if n > 1:
        id_, row = _name(None, text_col)
        named = docs.withColumn(name, F.struct(row.alias("row"), id_.alias("id")))
        found = _by_blocks(named.select(f"{name}.row", f"{name}.id", F.col(text_col).alias("text")), own, window, n)
        found = found.select(F.struct("row", "id").alias(name), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))).alias(name + "s"))
        done = named.join(found, name, "left").withColumn(name, _cutter(None, max_share)(text_col, F.coalesce(name + "s", F.array().cast("array<int>")))).drop(name + "s")
    else:
        automaton = docs.sparkSession.sparkContext.broadcast(_automaton([(r["id"], r["text"]) for r in own.collect()], window))
        done = docs.withColumn(name, _cutter(automaton, max_share)(text_col, F.array().cast("array<int>")))
    return done.withColumns({text_col: F.col(f"{name}.text"), "n_cut": F.col(f"{name}.n_cut"), "dropped": F.col(f"{name}.dropped")}).drop(name)


def _cutter(held, max_share: float):
    """Texts cut by the spans of an automaton, or by those that are told, starts and ends in turn."""

    @F.pandas_udf("text string, n_cut long, dropped boolean")
    def cut(text: pd.Series, told: pd.Series) -> pd.DataFrame:
        words, at = word_hashes([utf8(t) for t in text], NO_WORD)
        each = [held.value.scan(words[at[k] : at[k + 1]])[0] if held else [*zip(told[k][::2].tolist(), told[k][1::2].tolist(), strict=True)] for k in range(len(text))]
        rows = [_cut(t, s, int(at[k + 1] - at[k]), max_share) for k, (t, s) in enumerate(zip(text, each, strict=True))]
        return pd.DataFrame(rows, columns=["text", "n_cut", "dropped"])

    # else the optimizer runs it once for each of its fields
    return cut.asNondeterministic()


def _cut(text: str | None, spans: list[tuple[int, int]], n_words: int, max_share: float) -> tuple[str | None, int, bool]:
    if not spans:
        return text, 0, False
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    kept, at, gone = [], 0, 0
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = starts[b]
        gone += b - a
    return "".join([*kept, text[at:]]), gone, gone > max_share * n_words
