"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's ids are cut into whole windows and a rest. The rest goes to the open window whose
fill level h gives the smallest sum over levels of (open windows at that level) squared, after
the move; opening a new window competes at the same price. An array of counts by level is all
the state that choosing needs. Each task packs its own partition, so nothing is shuffled and a
lost task is simply packed again.

What is still open at the end of a task, or when too many windows are open, is closed exactly:
the fullest windows are filled up with ids cut from the emptiest ones. The last rest of a task
is cut into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches
from quillspark.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Levels 1..size-1 hold open windows; a window is a list of (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, max_open: int, first_id: int) -> None:
        self.size, self.max_open, self.next_id = size, max_open, first_id
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.out: list[tuple] = []

    def close(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.out.append((doc, start, len(ids), total, self.next_id, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.close([(doc, at, ids[at : at + self.size], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))

    def place(self, piece: tuple) -> None:
        r, n = len(piece[2]), self.count
        # change of the sum of squares when a window at level h (1..size-r) takes r ids; full windows count for nothing
        old = n[1 : self.size - r + 1]
        new = n[r + 1 : self.size + 1]
        change = np.where(old > 0, 2 * (new - old) + 2, np.iinfo(np.int64).max)
        if len(change) and old[-1] > 0:
            change[-1] = 1 - 2 * old[-1]
        best = int(change.argmin()) if len(change) else 0
        if not len(change) or change[best] >= 2 * n[r] + 1:
            level, window = 0, []
        else:
            level = best + 1
            window = self.open[level].pop()
            n[level] -= 1
        window.append(piece)
        if level + r == self.size:
            self.close(window)
        else:
            self.open[level + r].append(window)
            n[level + r] += 1
            if n.sum() > self.max_open:
                self.flush(last=False)

    def flush(self, last: bool) -> None:
        """Closes all open windows but one at most; with last, that one too."""
        windows = [w for level in reversed(self.open) for w in level]  # fullest first
        self.open = [[] for _ in range(self.size)]
        self.count[:] = 0
        k, spare = 0, len(windows) - 1
        while k <= spare:
            window = windows[k]
            room = self.size - sum(len(p[2]) for p in window)
            while room and spare > k:
                doc, start, ids, total = windows[spare].pop()
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], total))
                room -= take
                if take < len(ids):
                    windows[spare].append((doc, start + take, ids[take:], total))
                elif not windows[spare]:
                    spare -= 1
            if not room:
                self.close(window)
            elif last:
                self.halves(window)
            else:
                level = self.size - room
                self.open[level].append(window)
                self.count[level] += 1
            k += 1

    def halves(self, window: list) -> None:
        """The last rest, in windows of powers of two."""
        left = sum(len(p[2]) for p in window)
        while left:
            room = want = 1 << (left.bit_length() - 1)
            part = []
            while room:
                doc, start, ids, total = window.pop(0)
                take = min(room, len(ids))
                part.append((doc, start, ids[:take], total))
                room -= take
                if take < len(ids):
                    window.insert(0, (doc, start + take, ids[take:], total))
            self.close(part)
            left -= want

    def taken(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_open: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    Each document is its token ids and `end_id`; a null or empty text is `end_id` alone. Rows that
    repeat an id are packed each on its own; a null id is kept. Sequences have `size` ids, but for
    at most log2(size) per task, whose lengths are powers of two. sequence_id is unique: the
    task's number times 2**40, and its own count. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        packer = Packer(size, max_open, TaskContext.get().partitionId() << 40)
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                packer.add(None if pd.isna(i) else int(i), np.array([*(encode(text) if text else ()), end_id], np.uint32))
            if packer.out:
                yield packer.taken()
        packer.flush(last=True)
        if packer.out:
            yield packer.taken()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE)
