"""Which texts contain which phrases of a table, phrases of any length and number.

As long as a table of phrases fits a block of checked size, tasks search their texts for all of them at once by an
Aho-Corasick automaton. Longer tables are met by an inverted index: of the byte grams in each window of WINDOW
grams the one with the smallest hash is a key. A text that contains a phrase has all the phrase's windows,
and so all its keys; the rarest of them in the texts joins the two, and only such pairs are compared. Phrases
shorter than a window have no key and go through automata, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a gram, grams of a window; phrases of KEYED bytes have a window.
GRAM, WINDOW = 8, 17
KEYED = GRAM + WINDOW - 1
#: Characters of phrases in one automaton, which takes some 60 bytes for each.
BLOCK_CHARS = 1_000_000


def _hashed(data: bytes) -> np.ndarray:
    """A number for each gram: its bytes, well mixed."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(len(b) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            out = (out << np.uint64(8)) | b[k : len(out) + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)


def keys(data: bytes) -> np.ndarray:
    """The keys of a text's windows, each once; none for texts without a window."""
    if len(data) < KEYED:
        return np.zeros(0, np.int64)
    found, size = [], 1 << 20
    for at in range(0, len(data) - KEYED + 1, size - KEYED + 1):
        h = _hashed(data[at : at + size])
        if len(h) >= WINDOW:
            found.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)))
    return np.unique(np.concatenate(found)).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(data: pd.Series) -> pd.Series:
    return data.map(lambda b: keys(bytes(b)))


def _searched(docs: DataFrame, phrases: list[tuple[int, str]]) -> DataFrame:
    """(id, pid) by one automaton, which each task makes once."""
    told = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for pid, phrase in told.value:
            search.add_word(phrase, pid)
        search.make_automaton()
        for pdf in batches:
            hits = [sorted({pid for _, pid in search.iter(text)}) for text in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"].repeat([len(h) for h in hits]).array, "pid": [p for h in hits for p in h]})

    return docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, pid long")


def _joined(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, pid) by the rarest key of each phrase."""
    data = lambda c: F.encode(c, "UTF-8")
    wanted = phrases.select("pid", F.explode(_keys(data(F.col("phrase")))).alias("key"))
    has = docs.filter(F.octet_length("text") >= KEYED).select("id", F.explode(_keys(data(F.col("text")))).alias("key"))
    has = has.join(wanted.select("key").distinct(), "key", "left_semi")
    # a phrase with a key that no text has is in none
    rare = has.groupBy("key").agg(F.count("*").alias("n"))
    best = wanted.join(rare, "key", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
    pairs = best.filter("best.n > 0").select("pid", "best.key").join(has, "key").select("id", "pid").distinct()
    return pairs.join(phrases, "pid").join(docs, "id").filter(F.contains("text", F.col("phrase"))).select("id", "pid")


def containing(docs: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_id: str, phrase_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, phrase id), each pair once, of texts that contain a phrase anywhere, within words too.

    Ids may repeat: a pair is there if one of the id's texts contains one of the phrase id's phrases. Equal phrases are
    searched for once. Null and empty texts and phrases are in no pair, nor have null ids one. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text <> ''")
    named = phrases.select(F.col(phrase_id).alias("phrase_id"), F.col(phrase_col).alias("phrase")).filter("phrase_id is not null and phrase <> ''").distinct()
    # the number of a phrase is a digest of it, so it needs no order
    numbered = named.select(F.xxhash64("phrase").alias("pid"), "phrase").distinct()
    short = F.octet_length("phrase") < KEYED
    total, few = (x or 0 for x in numbered.agg(F.sum(F.length("phrase")), F.sum(F.when(short, F.length("phrase")))).first())
    by_automaton, chars = (numbered, total) if total <= block_chars else (numbered.filter(short), few)
    blocks = max(1, -(-chars // block_chars))
    found = None if total <= block_chars else _joined(texts, numbered.filter(~short))
    for k in range(blocks):
        rows = by_automaton.filter(F.pmod(F.col("pid"), F.lit(blocks)) == k).collect()
        if rows or found is None:
            part = _searched(texts, [(r["pid"], r["phrase"]) for r in rows])
            found = part if found is None else found.union(part)
    out = found.join(named.withColumn("pid", F.xxhash64("phrase")), "pid")
    return out.select(F.col("id").alias(id_col), F.col("phrase_id").alias(phrase_id)).distinct()
