"""Quality scores by a linear-chain conditional random field over a document's lines.

Each line is good or bad. A line's own shape and that of the lines before and after it (binned,
one weight each) give its score, two-by-two transition weights tie neighbours together. A document's
quality is the length-weighted mean of its lines' forward-backward marginals, set to a
probability by a logistic curve.

Only documents carry labels. The field is first fitted with each line labelled as its document;
then lines of bad documents that it takes for good are relabelled, and it is fitted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix64, small_batches, utf8, word_hashes

#: Labelled documents that the field is fitted on, at most, each as a whole; padded lines that one array holds in the fit.
TRAIN_DOCS, BLOCK_LINES = 3000, 1 << 16

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "symbol": b"#$%&*@~^_=+<>{}[]\\/", "pipe": b"|",
    "bang": b"!?", "stop": b".,;:", "wide": range(0xC0, 0x100),
}
_LUT = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASSES.items()}
N_SHAPES = 12


def line_shapes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape per line, bytes per line, number of lines per text). A text has one line at least."""
    split = [utf8(t).split(b"\n") for t in texts]
    lines = [x for own in split for x in own]
    count = np.fromiter(map(len, split), np.int64, len(split))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if not lines:
        return np.zeros((0, N_SHAPES)), size, count
    buf = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    n = {k: np.add.reduceat(lut[buf], start, dtype=np.int32) for k, lut in _LUT.items()}
    h, at = word_hashes(lines)
    line = np.repeat(np.arange(len(lines)), np.diff(at))
    again = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(lines))
    with np.errstate(over="ignore"):
        _, first = np.unique(mix64(h + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(line[first], minlength=len(lines))
    words, letters, length = np.diff(at), n["upper"] + n["lower"] + n["wide"] + 1, size + 1
    last = buf[np.maximum(start + size - 1, 0)]
    shape = np.stack([
        np.log2(length), n["upper"] / letters, n["digit"] / length, n["symbol"] / length, n["pipe"] / length, n["bang"] / length,
        n["stop"] / length, words / length, again / np.maximum(words, 1), distinct / np.maximum(words, 1),
        np.where(size > 0, _LUT["stop"][last] + 2 * _LUT["bang"][last], 0), _LUT["lower"][buf[start]],
    ], axis=1)
    return shape.astype(np.float32), size, count


@dataclass
class Field:
    """edges: bin edges by shape; weights: (before, own, after) x shape x bin; chain: log weights of (bad, good) steps."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    chain: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def bins(self, shape: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, shape[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def odds(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log-odds of good of each line by itself; first, last: whether it begins or ends its document."""
        own = [self.weights[place, np.arange(N_SHAPES), bins].sum(axis=1) for place in range(3)]
        before, after = np.roll(own[0], 1), np.roll(own[2], -1)
        before[first], after[last] = 0, 0
        return self.bias + own[1] + before + after

    def marginals(self, odds: list[float]) -> list[float]:
        """Probability of good of each line of one document; messages are log-odds, one number each."""
        (bb, bg), (gb, gg) = self.chain.tolist()

        def step(x: float, to_good: float, from_good: float) -> float:
            # log of (exp(x) e^gg + e^to_good) / (exp(x) e^from_good + e^bb), without overflow
            top = max(x + gg, to_good)
            low = max(x + from_good, bb)
            return top + math.log1p(math.exp(-abs(x + gg - to_good))) - low - math.log1p(math.exp(-abs(x + from_good - bb)))

        ahead, m = [], 0.0
        for o in odds:
            ahead.append(m)
            m = step(m + o, bg, gb)
        out, m = [0.0] * len(odds), 0.0
        for k in range(len(odds) - 1, -1, -1):
            x = ahead[k] + odds[k] + m
            out[k] = 1 / (1 + math.exp(-x)) if x > -500 else 0.0
            m = step(m + odds[k], gb, bg)
        return out

    def quality(self, texts: list[str | None]) -> list[float]:
        shape, size, count = line_shapes(texts)
        end = np.cumsum(count)
        first, last = np.zeros(len(size), bool), np.zeros(len(size), bool)
        first[(end - count).astype(int)], last[end - 1] = True, True
        odds = self.odds(self.bins(shape), first, last).tolist()
        weight, out, at = np.maximum(size, 1), [], 0
        for n in count.tolist():
            w = weight[at : at + n]
            out.append(float(np.dot(w, self.marginals(odds[at : at + n])) / w.sum()))
            at += n
        return out

    def score(self, quality: float) -> float:
        x = self.slope * quality + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _posterior(odds: np.ndarray, mask: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good (docs x lines) and expected counts of steps (2 x 2), for padded documents."""
    n, length = odds.shape
    node = np.stack([np.zeros_like(odds), odds], axis=2)
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = node[:, 0]
    for t in range(1, length):
        forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + chain[0], forward[:, t - 1, 1:] + chain[1]) + node[:, t]
        forward[:, t] -= forward[:, t].max(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = node[:, t + 1] + backward[:, t + 1]
        b = np.logaddexp(chain[:, 0] + x[:, :1], chain[:, 1] + x[:, 1:])
        b -= b.max(axis=1, keepdims=True)
        backward[:, t] = np.where(mask[:, t + 1, None], b, 0)
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -500, 500)))
    pair = forward[:, :-1, :, None] + chain + (node + backward)[:, 1:, None, :]
    pair = np.exp(pair - pair.max(axis=(2, 3), keepdims=True))
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return good, (pair * mask[:, 1:, None, None]).sum(axis=(0, 1))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 80, rounds: int = 2) -> Field | None:
    """docs: (shapes, bytes per line, label) each. None where not both labels occur."""
    labels = np.array([d[2] for d in docs])
    if len(set(labels.tolist())) < 2:
        return None
    docs = sorted(docs, key=lambda d: len(d[0]))
    labels = np.array([d[2] for d in docs])
    every = np.concatenate([d[0] for d in docs])
    edges = [np.unique(np.quantile(every[:, k], [0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.85, 0.93, 0.97, 0.99])) for k in range(N_SHAPES)]
    width = max(map(len, edges)) + 1
    field = Field(edges, np.zeros((3, N_SHAPES, width)), 0.0, np.zeros((2, 2)))
    n = N_SHAPES * width
    # a class weighs as much as the other
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    # documents of like length are padded to the longest of their block
    blocks, at = [], 0
    while at < len(docs):
        end = at + 1
        while end < len(docs) and (end + 1 - at) * len(docs[end][0]) <= BLOCK_LINES:
            end += 1
        mask = np.arange(len(docs[end - 1][0])) < np.array([len(d[0]) for d in docs[at:end]])[:, None]
        bins = np.zeros((*mask.shape, N_SHAPES), np.int64)
        bins[mask] = field.bins(np.concatenate([d[0] for d in docs[at:end]]))
        target = np.where(mask, labels[at:end, None], 0).astype(float)
        blocks.append({"mask": mask, "flat": np.arange(N_SHAPES) * width + bins, "target": target, "weight": share[at:end, None] * mask, "y": labels[at:end, None], "both": mask[:, 1:] & mask[:, :-1]})
        at = end
    theta, lines = np.zeros(3 * n + 5), sum(int(x["mask"].sum()) for x in blocks)

    def gradient(x: dict) -> np.ndarray:
        """Of one block; leaves its marginals in it."""
        mask, flat, target, both = x["mask"], x["flat"], x["target"], x["both"]
        w, chain = theta[: 3 * n].reshape(3, n), theta[3 * n + 1 :].reshape(2, 2)
        own = [w[p][flat].sum(axis=2) for p in range(3)]
        odds = own[1] + theta[3 * n]
        odds[:, 1:] += np.where(both, own[0][:, :-1], 0)
        odds[:, :-1] += np.where(both, own[2][:, 1:], 0)
        x["good"], expected = _posterior(odds * mask, mask, chain)
        error = (x["good"] - target) * x["weight"]
        out = np.zeros_like(theta)
        for p, e in ((0, np.pad(error[:, 1:], ((0, 0), (0, 1)))), (1, error), (2, np.pad(error[:, :-1], ((0, 0), (1, 0))))):
            e = np.where(mask, e, 0)
            out[p * n : (p + 1) * n] = np.bincount(flat.ravel(), np.repeat(e.ravel(), N_SHAPES), minlength=n)
        out[3 * n] = error.sum()
        before, after = target[:, :-1][both], target[:, 1:][both]
        pairs = np.array([[((1 - before) * (1 - after)).sum(), ((1 - before) * after).sum()], [(before * (1 - after)).sum(), (before * after).sum()]])
        out[3 * n + 1 :] = (expected - pairs).ravel()
        return out

    for _ in range(rounds):
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad = sum(gradient(x) for x in blocks) / lines + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # of a bad document, the lines taken for good are; but its worst line stays bad
        for x in blocks:
            worst = np.where(x["mask"], x["good"], 2).min(axis=1, keepdims=True)
            x["target"] = np.where(x["mask"] & ((x["y"] == 1) | ((x["good"] > 0.5) & (x["good"] > worst))), 1.0, 0.0)
    field.weights, field.bias, field.chain = theta[: 3 * n].reshape(3, N_SHAPES, width).copy(), float(theta[3 * n]), theta[3 * n + 1 :].reshape(2, 2).copy()
    _calibrate(field, docs, labels)
    return field


def _calibrate(field: Field, docs: list, labels: np.ndarray) -> None:
    q = []
    for shape, size, _ in docs:
        first, last = np.zeros(len(size), bool), np.zeros(len(size), bool)
        first[0] = last[-1] = True
        w = np.maximum(size, 1)
        q.append(np.dot(w, field.marginals(field.odds(field.bins(shape), first, last).tolist())) / w.sum())
    x, y, a, b = np.array(q), labels, 1.0, 0.0
    for _ in range(50):  # Newton's method on the two numbers, with a slight pull of the slope to 0
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    field.slope, field.shift = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> Field | None:
    """Fits a field on at most max_docs labelled documents that aren't held out, the first by a hash of their id.

    Rows of labels without an id or label are left out; an id with different labels counts with each.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id"))).distinct()
    # bounded by the limit, so it can be broadcast
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shape, size, count = line_shapes(list(pdf["text"]))
            end = np.cumsum(count)
            cut = [slice(e - c, e) for e, c in zip(end.tolist(), count.tolist(), strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "shape": [shape[s].ravel() for s in cut], "size": [size[s] for s in cut]})

    rows = texts.mapInPandas(shapes, "id long, y int, shape array<float>, size array<long>").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["y"], len(r["size"])))
    return fit([(np.array(r["shape"], np.float32).reshape(-1, N_SHAPES), np.array(r["size"]), r["y"]) for r in rows])


def held_out(i):
    return F.crc32(i.cast("string")) % 5 == 0


def score(docs: DataFrame, field: Field | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null or empty text is scored as one empty line; repeated rows are scored each. Other columns are ignored, whatever their names. Without a field
    (no labels, or of one kind alone) every score is 0.5. A null id is not held out. No rows give none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [0.5] * len(pdf) if field is None else [field.score(x) for x in field.quality(list(pdf["text"]))]
            yield pd.DataFrame({"doc_id": pdf["id"].astype("Int64"), "score": q})

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(field: Field | None):
    """A column function: text -> score, for a table whose other columns stay as they are."""

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([0.5] * len(text) if field is None else [field.score(x) for x in field.quality(list(text))], dtype="float64")

    # else the optimizer runs it again for a filter on its result
    return of.asNondeterministic()
