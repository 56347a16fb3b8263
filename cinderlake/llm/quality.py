"""Quality classifier: histogram gradient-boosted trees over statistics of a text, flattened into arrays for scoring.

The statistics take each whole text; labels, language, source and id are no input. Trees are grown level by level
from gradient histograms over at most ``BINS`` quantile bins of each statistic, under logistic loss. All nodes of all
trees lie in flat arrays, so a batch of texts descends every tree in a few vectorised steps.

Null texts are scored as empty ones. Without training rows of both classes the score is the share of label 1 (0.5
where there are none). Rows that repeat an id are scored each; labels that repeat an id are averaged.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import column, slices
from cinderlake.shipping import ship

#: Bound of the training sample, and the shape of the model.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 6000, 80, 4, 48, 0.15, 2.0, 1.0
SLICE_CHARS = 2_000_000

NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "symbols", "pipes", "blanks", "lines", "non_ascii", "exclaims", "brackets",
    "distinct_words", "top_word", "top_share", "distinct_lines", "log_line", "short_words", "long_words", "odd_ends", "distinct_pairs", "capitals",
)


def byte_class(chars: str) -> np.ndarray:
    held = np.zeros(256, np.float64)
    held[[ord(c) for c in chars]] = 1
    return held


CLASSES = np.stack([
    byte_class(string.ascii_uppercase), byte_class(string.digits), byte_class(".,;:?"), byte_class("#$%&*@^~=+<>/\\_"), byte_class("|"),
    byte_class(" \t"), byte_class("\n"), np.r_[np.zeros(128), np.ones(128)], byte_class("!"), byte_class("()[]{}\"'"),
])
LETTER_END = set(string.ascii_letters + string.digits + ".,;:?!")


def statistics(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    n = max(1, len(raw))
    shares = (CLASSES @ np.bincount(raw, minlength=256)) / n
    words = text.split()
    count = len(words)
    w = max(1, count)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    short = sum(c for x, c in seen.items() if len(x) <= 3)
    wide = sum(c for x, c in seen.items() if len(x) > 12)
    odd = sum(c for x, c in seen.items() if x[-1] not in LETTER_END and x[-1].isascii())
    capital = sum(c for x, c in seen.items() if x[0].isupper())
    top = seen.most_common(1)[0][1] if seen else 0
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)), np.log1p(count), sum(len(x) * c for x, c in seen.items()) / w, *shares[[0, 1, 2, 3, 4, 5, 6, 7, 8, 9]],
        len(seen) / w, np.log1p(top), top / w, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        short / w, wide / w, odd / w, pairs / max(1, count - 1), capital / w,
    ]


@dataclass
class Forest:
    """Trees as flat arrays: a node tests ``statistic <= cut`` and leads to ``below`` or ``above``; leaves lead to themselves."""

    statistic: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.statistic[at]] <= self.cut[at], self.below[at], self.above[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts ``TREES`` trees of ``DEPTH`` levels; constant where a class is missing."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if n == 0 or y.min() == y.max():
        return Forest(none, np.zeros(0), none, none, np.zeros(0), none, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []  # statistic, cut, below, above, value
    roots, margin = [], np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        first = len(nodes)
        roots.append(first)
        nodes.append([0, 0.0, first, first, 0.0])
        place = np.full(n, first)
        level = [first]
        for _ in range(DEPTH):
            index = np.full(len(nodes), -1)
            index[level] = np.arange(len(level))
            rank = index[place]
            on = rank >= 0
            best = [(0.0, -1, -1)] * len(level)
            for j, c in enumerate(cuts):
                width = len(c) + 1
                key = rank[on] * width + binned[on, j]
                g = np.bincount(key, grad[on], len(level) * width).reshape(-1, width).cumsum(axis=1)
                h = np.bincount(key, hess[on], len(level) * width).reshape(-1, width).cumsum(axis=1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain = np.where((hl >= LEAST_HESSIAN) & (ha - hl >= LEAST_HESSIAN), gain, 0)
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    best = [max(b, (float(gain[i, k[i]]), j, int(k[i])), key=lambda t: t[0]) for i, b in enumerate(best)]
            fresh = []
            for node, (gain, j, k) in zip(level, best, strict=True):
                if gain > 1e-6:
                    left = len(nodes)
                    nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]]
                    nodes[node][:4] = [j, float(cuts[j][k]), left, left + 1]
                    mine = place == node
                    place[mine] = np.where(binned[mine, j] <= k, left, left + 1)
                    fresh += [left, left + 1]
            if not (level := fresh):
                break
        g, h = np.bincount(place, grad, len(nodes)), np.bincount(place, hess, len(nodes))
        for node in np.unique(place):
            nodes[node][4] = RATE * g[node] / (h[node] + RIDGE)
        margin += np.array([x[4] for x in nodes])[place]
    column = lambda k, kind: np.array([x[k] for x in nodes], kind)
    return Forest(column(0, np.int64), column(1, np.float64), column(2, np.int64), column(3, np.int64), column(4, np.float64), np.array(roots), base)


def held_out(id_col):
    """True for the fifth of ids whose CRC-32 of the decimal text is a multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Trains on at most about ``rows`` labelled rows outside the held-out fifth, chosen by a hash of the id.

    The statistics of these rows are computed by the executors; the driver gets a few hundred bytes a row.
    """
    marked = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).alias("label"))
    known = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    marks = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("y"))
    total = marks.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = {r["id"]: r["y"] for r in marks.where(share < rows / max(1, total)).limit(2 * rows).collect()}
    if not chosen:
        return fit_forest(np.zeros((0, len(NAMES))), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "wanted long")
    sample = docs.join(F.broadcast(ids), column(docs, id_col) == ids["wanted"], "left_semi")
    got = sorted((r["id"], list(r["stats"])) for r in measure(sample, id_col, text_col).collect())
    return fit_forest(np.array([g[1] for g in got]).reshape(-1, len(NAMES)), np.array([chosen[g[0]] for g in got]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, stats array<double>)`` per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([[float(v) for v in statistics(t.as_py())] for t in batch.column(1)], pa.list_(pa.float64()))], names=["id", "stats"])

    two = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, stats array<double>")


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per row of ``docs``; only the id and the text are read. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            stats = [statistics(t) for lo, hi in slices(texts, SLICE_CHARS) for t in texts[lo:hi]]
            yield pa.record_batch([batch.column(0), pa.array(forest.score(np.array(stats).reshape(-1, len(NAMES))), pa.float64())], names=["id", "score"])

    two = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, score double")
