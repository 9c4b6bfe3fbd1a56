"""What several corpus operators need: the shared work folder, saved tables, fast word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes per Arrow batch, about. Whole texts are long, so a batch of Spark's usual number of rows could take gigabytes.
BATCH_BYTES = 1 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class small_batches:  # noqa: N801
    """Bounds what a Python worker holds: from now on, Arrow batches have so many bytes at most, or one row.

    As a context manager it puts the former bound back. Frames that are returned before they run need the
    bound later, so their operators leave it set; a smaller bound that the session has stays.
    Workers also give freed memory back, which they would keep for their next task, and are told this
    package's folder, in case the cluster has no copy installed.
    """

    NAME = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession, size: int = BATCH_BYTES) -> None:
        told = spark.sparkContext.environment
        path = told.get("PYTHONPATH", "")
        if ROOT not in path.split(os.pathsep):
            told["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
        told |= {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_MMAP_THRESHOLD_": "250000"}
        self.spark, self.before = spark, spark.conf.get(self.NAME)
        if not self.before.isdigit() or int(self.before) > size:
            spark.conf.set(self.NAME, str(size))

    def __enter__(self) -> small_batches:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.NAME, self.before)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors can read and write. It goes when the driver's JVM ends.

    Only where that setting is missing and the master is local (tests on one machine) a local folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    path = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later steps don't depend on executors' memory or disks."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a saved table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised word hashing -------------------------------------------------------------

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A 64-bit value for each byte, upper-case ASCII as lower-case.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BYTE[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, _INVERSE, np.uint64)
            down[0] = 1
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


#: Bytes that are hashed at once. Temporary arrays take some fifty times as much, so it is the block that bounds memory.
BLOCK_BYTES = 1 << 20


def _block(texts: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    gap = space[buf]
    gap[ends - 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
        h = mix64((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.diff(np.searchsorted(begin, np.concatenate(([0], ends))))


def _pieces(text: bytes, space: np.ndarray) -> list[bytes]:
    """A text in parts of about a block, cut where no word is."""
    out, at = [], 0
    while len(text) - at > 2 * BLOCK_BYTES:
        end = at + BLOCK_BYTES
        while end < len(text):
            gaps = np.flatnonzero(space[np.frombuffer(text, np.uint8, min(BLOCK_BYTES, len(text) - end), end)])
            end += int(gaps[0]) if len(gaps) else min(BLOCK_BYTES, len(text) - end)
            if len(gaps):
                break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin.

    Words are the runs of bytes not marked in `space`; A-Z count as a-z. The hash of a word is a
    polynomial over per-byte random values, read off one running sum, so no Python code runs per word.
    """
    found, count = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
    block: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            h, n = _block(block, space)
            found.append(h)
            np.add.at(count, np.array(owner) + 1, n)
            block.clear()
            owner.clear()
            size = 0

    for k, text in enumerate(texts):
        for piece in _pieces(text, space) if len(text) > 2 * BLOCK_BYTES else (text,):
            block.append(piece)
            owner.append(k)
            size += len(piece) + 1
            if size >= BLOCK_BYTES:
                flush()
    flush()
    return np.concatenate(found), np.cumsum(count)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words of one text; with fewer words, of the whole as one; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix64(out + np.uint64(n))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
