"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by vantage-point trees.

Fingerprints are equal for equal texts, so one row stands for all documents of a fingerprint from the first
aggregation on. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks
(pigeonhole); each block value is a cell. In a cell a vantage-point tree finds all pairs within the radius: subtrees
are skipped when the triangle inequality rules them out. A cell with more than ``shard_rows`` fingerprints is first
dealt out by distance to vantage points, and a fingerprint near a boundary is also sent, as a query, to the shard
beyond it, so no task holds a whole hot cell and no pair across a boundary is missed. Of the pairs in a shard only a
spanning forest leaves it; components are taken over these links, not over all pairs of a group.

Null texts and texts without words have fingerprint zero and link like any other. A null id keeps its fingerprint
and has no component; rows that repeat an id are one document with possibly several fingerprints, all linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Stored, column, components, fresh_name, let_go
from cinderlake.shipping import ship

#: Fingerprints of a leaf of the tree, compared one with all.
LEAF = 64
#: Fingerprints of a cell in one task; larger cells are dealt out.
SHARD_ROWS = 50_000
#: Most levels of that dealing.
LEVELS = 12

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of ``width`` words, repeats included; A-Z are lowered, words end at ASCII white space."""
    words = (text or "").encode("utf-8").translate(UPPER).split()  # bytes.split: 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``, one row per row of ``docs``; fp holds the 64 bits as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    ship(docs.sparkSession)
    two = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, fp long")


class VantageTree:
    """Exact search within a Hamming radius. Each inner node splits by distance to one of its own points."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        self.root = self.build(np.arange(len(fps)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = self.fps[rows[len(rows) // 2]]
        far = np.bitwise_count(self.fps[rows] ^ point)
        cut = int(np.median(far))
        near = far <= cut
        if near.all():  # more than half lie at the largest distance
            cut = int(far.max()) - 1
            near = far <= cut
            if not near.any():
                return rows
        inside, outside = rows[near], rows[~near]
        spans = (int(far[near].min()), int(far[near].max())), (int(far[~near].min()), int(far[~near].max()))
        return point, spans, self.build(inside), self.build(outside)

    def pairs(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries and of the tree within the radius of each other, leaf by leaf, for all queries at once."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if isinstance(node, np.ndarray):
                for at in range(0, len(asked), 4096):
                    part = asked[at : at + 4096]
                    for lo in range(0, len(node), 4096):
                        rows = node[lo : lo + 4096]
                        q, r = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.fps[rows][None, :]) <= radius)
                        if len(q):
                            yield part[q], rows[r]
                continue
            point, spans, *below = node
            far = np.bitwise_count(queries[asked] ^ point).astype(np.int64)
            for (low, high), child in zip(spans, below, strict=True):
                stack.append((child, asked[(far >= low - radius) & (far <= high + radius)]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item of its component under the pairs."""
    root = np.arange(n)

    def settle() -> None:
        while not np.array_equal(up := root[root], root):
            root[:] = up

    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            settle()
            a, b = a[apart], b[apart]
    return root


def deal_large(rows: DataFrame, large: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Cells of more than ``shard_rows`` rows in shards: by distance to vantage points of the cell, each cut at its median.

    A row stays in its own shard; to each shard beyond a boundary that lies within the radius it goes as a query.
    """
    names = ["block", "cell"]
    hot = rows.join(large.select(*names), names, "left_semi")
    points = hot.groupBy(*names).agg(F.array(*(F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(LEVELS))).alias("points"))
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.col("points")[i])) for i in range(LEVELS)]
    cuts = hot.join(points, names).groupBy(*names).agg(F.array(*(F.percentile_approx(x, 0.5) for x in far)).alias("cuts"))
    depth = F.ceil(F.log2(F.col("n") / shard_rows)).cast("int")
    plan = large.withColumn("depth", F.least(depth, F.lit(LEVELS))).join(points, names).join(cuts, names).drop("n")
    dealt = rows.join(plan, names, "left").withColumn("far", F.when(F.col("depth").isNotNull(), F.array(*far))).drop("points")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = b["depth"].notna().to_numpy()
            yield b.loc[~split, ["block", "cell", "node", "fp"]].assign(shard=0, asks=False)
            hot = b[split]
            for lo in range(0, len(hot), 512):
                h = hot.iloc[lo : lo + 512]
                deep = h["depth"].to_numpy(np.int64)
                far, cut = (np.stack(h[c].to_list()).astype(np.int64) for c in ("far", "cuts"))
                own, shard, at = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.arange(len(h))
                for i in range(LEVELS):
                    own = 2 * own + ((deep > i) & (far[:, i] > cut[:, i]))
                    d, c, splits = far[at, i], cut[at, i], deep[at] > i
                    inner, outer = ~splits | (d <= c + radius), splits & (d > c - radius)
                    shard = np.concatenate([2 * shard[inner], 2 * shard[outer] + 1])
                    at = np.concatenate([at[inner], at[outer]])
                yield h.iloc[at][["block", "cell", "node", "fp"]].assign(shard=shard, asks=shard != own[at])

    return dealt.mapInPandas(deal, "block int, cell long, node long, fp long, shard long, asks boolean")


def links(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)``: node ids whose fingerprints lie within ``radius`` bits, down to a spanning forest of each shard.

    ``fps`` is ``(node long, fp long)`` with distinct fingerprints.
    """
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    cell = F.array(*(
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("cell"))
        for i in range(blocks)
    ))
    rows = fps.select("node", "fp", F.explode(cell).alias("c")).select("node", "fp", "c.block", "c.cell")
    sizes = rows.groupBy("block", "cell").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > shard_rows)
    if large.limit(1).count():
        spread = deal_large(rows, large, radius, shard_rows)
    else:
        spread = rows.select("block", "cell", F.lit(0).cast("long").alias("shard"), "node", "fp", F.lit(False).alias("asks"))

    def search(keys: pd.DataFrame) -> pd.DataFrame:
        home = keys[~keys["asks"].to_numpy()]
        fp = home["fp"].to_numpy(np.int64).view(np.uint64)
        if not len(fp):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        guests = keys[keys["asks"].to_numpy()]
        n, tree = len(fp), VantageTree(fp)
        asked = np.concatenate([fp, guests["fp"].to_numpy(np.int64).view(np.uint64)])
        root = forest(len(asked), tree.pairs(asked, radius))
        nodes = np.concatenate([home["node"].to_numpy(), guests["node"].to_numpy()])
        tied = root != np.arange(len(root))
        return pd.DataFrame({"a": nodes[root[tied]], "b": nodes[tied]})

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells arrive sorted, so that a partition of many small cells is one Python call and holds one cell at a time."""
        held: list[pd.DataFrame] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            keys = b[["block", "cell", "shard"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[lo])
                if held and key != last:
                    out.append(search(held[0] if len(held) == 1 else pd.concat(held)))
                    held = []
                held.append(b.iloc[lo:hi])
                last = key
            out = [x for x in out if len(x)]
            if out:
                yield pd.concat(out)
        if held:
            yield search(held[0] if len(held) == 1 else pd.concat(held))

    alone = spread.join(sizes.where("n = 1").select("block", "cell"), ["block", "cell"], "left_anti")
    sorted_cells = alone.repartition("block", "cell", "shard").sortWithinPartitions("block", "cell", "shard")
    return sorted_cells.mapInPandas(per_partition, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``: fingerprint, and the smallest id reachable over links.

    The fingerprints are written once to the shared folder; everything after works on 16 bytes a document.
    """
    marks = Stored(fingerprints(docs, width, id_col, text_col), "fingerprints").df
    known = marks.where("id IS NOT NULL")
    classes = known.groupBy("fp").agg(F.min("id").alias("node"))
    again = known.join(classes, "fp").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    twice = known.groupBy("id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select(F.col("id").alias("b"))
    near = links(classes, radius, shard_rows).unionByName(again.join(twice, "b").select("a", "b"))
    reached = components(near)
    # An id with several fingerprints is itself a node; any other id takes its fingerprint's.
    groups = classes.join(reached, "node", "left")
    labelled = groups.select("fp", F.coalesce("component", "node").alias("component_id"))
    out = marks.join(labelled, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component, all columns; null ids stay."""
    id_col, name = options.get("id_col", "doc_id"), fresh_name(docs, "gone")
    drop = near_duplicates(docs, **options).where("component_id <> id").select(F.col("id").alias(name)).distinct()
    return docs.join(drop, column(docs, id_col).cast("long") == drop[name], "left_anti")
