"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to 8 dimensions by random directions, one draw for each table, and decoded to the nearest
point of the E8 lattice; a vector's cell in a table is that point, and it also looks into the cells of the next
nearest lattice points. Vectors that meet in a cell are compared by exact cosine in double precision. From a cell only
a spanning forest of its links leaves, so a group of near copies is never expanded into pairs. Links within the
components are then counted exactly, by block products inside each component, which also finds the links that no
cell held. Cells and components of more than ``BLOCK_ROWS`` vectors are compared block by block in separate tasks.

Equal vectors of a label are one row with a count from the start. Vectors that are null, zero or hold null or
non-finite components, vectors without a label and rows without an id link with nothing; vectors of different
lengths are not compared. Rows that repeat an id count as vectors of their own, under the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Stored, column, components
from cinderlake.llm.simhash import forest
from cinderlake.shipping import ship

LEAST, TABLES, PROBES, CELL_SCALE, BLOCK_ROWS, SEED = 0.98, 6, 6, 0.55, 2048, 11


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one in size, or halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        signs = np.array([-0.5 if m >> k & 1 else 0.5 for k in range(8)])
        if bin(m).count("1") % 2 == 0:
            out.append(signs)
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half in all coordinates."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = SEED) -> np.ndarray:
    """Cell ids (rows, tables, 1 + probes): the own cell first, then the cells of the next nearest lattice points."""
    n, size = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    ring = shortest()
    for t in range(tables):
        draw = np.random.default_rng((seed, t, size))
        x = unit @ draw.normal(size=(size, 8)) / (scale * np.sqrt(8.0)) + draw.uniform(-1, 1, 8)
        home = nearest_e8(x)
        rest = x - home
        # distance to home + v, less what all have in common
        far = (ring**2).sum(axis=1)[None, :] - 2 * rest @ ring.T
        order = np.argpartition(far, probes, axis=1)[:, :probes] if probes else np.zeros((n, 0), np.int64)
        points = np.concatenate([home[:, None, :], home[:, None, :] + ring[order]], axis=1)
        out[:, t] = np.ascontiguousarray(np.clip(2 * points, -127, 127).astype(np.int8)).view(np.int64)[:, :, 0]
    return out


def usable(embedding: str, label: str):
    total = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(embedding) > 0) & fine & (total > 0), F.lit(False))


def unit_rows(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def in_blocks(rows: DataFrame, key: list[str], block_rows: int, wanted=None) -> DataFrame:
    """Adds ``x``, ``y`` and ``mine``: keys of more than ``block_rows`` rows are dealt out to all pairs of their blocks.

    Keys of one row go, and those without a row that meets ``wanted``.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.bool_or(F.lit(True) if wanted is None else wanted).alias("_w")).where("_n > 1 AND _w").drop("_w")
    counted = rows.join(sizes, key).withColumn("_s", F.ceil(F.col("_n") / block_rows).cast("int"))
    placed = counted.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("_s")).cast("int"))
    spread = placed.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return spread.withColumn("x", F.least("mine", "_j")).withColumn("y", F.greatest("mine", "_j")).drop("_n", "_s", "_j")


def cell_edges(probe: np.ndarray, reps: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one cell (or one pair of its blocks): rows at home with each other and with those that look in."""
    home = np.flatnonzero(probe == 0)
    if not len(home) or len(reps) < 2:
        return reps[:0], reps[:0]
    if len(reps) * len(home) <= 4096:  # most cells: one product, and often no link at all
        a, b = np.nonzero(unit[home] @ unit.T >= least)
        if len(a) == len(home):
            return reps[:0], reps[:0]
        found = [(home[a], b)]
    else:
        found = ((part[a], b) for part in (home[at : at + 1024] for at in range(0, len(home), 1024)) for a, b in [np.nonzero(unit[part] @ unit.T >= least)])
    root = forest(len(reps), iter(found))
    tied = np.flatnonzero(root != np.arange(len(root)))
    return reps[root[tied]], reps[tied]


def cells_of_partition(least: float):
    """A function over a partition sorted by cell, which holds one cell at a time and makes one result per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = None

        def done() -> tuple[np.ndarray, np.ndarray]:
            probe, reps, unit = held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]
            return cell_edges(probe, reps, unit, least)

        for b in batches:
            if not len(b):
                continue
            key, probe, reps = b["cell_key"].to_numpy(), b["probe"].to_numpy(), b["rep"].to_numpy()
            sizes = b["embedding"].map(len).to_numpy()
            width = sizes.max()
            unit = np.zeros((len(b), width))  # vectors of a cell have one length; the rest is padding
            for n in np.unique(sizes):
                unit[sizes == n, :n] = unit_rows(b["embedding"][sizes == n])
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and key[lo] != last:
                    out.append(done())
                    held = []
                held.append((probe[lo:hi], reps[lo:hi], unit[lo:hi, : sizes[lo]]))
                last = key[lo]
            out = [o for o in out if len(o[0])]
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})
        if held:
            a, b = done()
            yield pd.DataFrame({"a": a, "b": b})

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, scale: float = CELL_SCALE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id)`` per row of ``vectors``."""
    ship(vectors.sparkSession)
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, embedding_col).alias("embedding"), column(vectors, label_col).alias("label"))
    rows = rows.withColumn("fine", usable("embedding", "label") & F.col("id").isNotNull())
    fine = rows.where("fine")
    distinct = Stored(fine.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors").df

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby(b["embedding"].map(len)):
                found = cells(unit_rows(same["embedding"]), tables, probes, scale)
                n, m = len(same), tables * (1 + probes)
                at = np.repeat(np.arange(n), m)
                yield pd.DataFrame({
                    "label": same["label"].to_numpy()[at], "size": same["embedding"].map(len).to_numpy()[at], "hashed": np.tile(np.repeat(np.arange(tables), 1 + probes), n),
                    "cell": found.ravel(), "probe": np.tile(np.arange(1 + probes), n * tables), "rep": same["rep"].to_numpy()[at],
                })

    kind = distinct.schema["label"].dataType.simpleString()
    hashed = distinct.select("label", "embedding", "rep").mapInPandas(hash_rows, f"label {kind}, size int, hashed int, cell long, probe int, rep long")
    met = in_blocks(hashed, ["label", "size", "hashed", "cell"], block_rows, F.col("probe") == 0)
    vectors_of = distinct.select("rep", "embedding")
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in ("label", "size", "hashed", "cell", "x", "y")))
    # A row that meets a cell by several probes counts once, by the nearest.
    once = met.groupBy(name.alias("cell_key"), "rep").agg(F.min("probe").alias("probe"))
    sorted_cells = once.join(vectors_of, "rep").repartition("cell_key").sortWithinPartitions("cell_key", "rep")
    edges = sorted_cells.mapInPandas(cells_of_partition(least), "a long, b long")
    reached = Stored(components(edges.distinct()), "components").df.withColumnRenamed("node", "rep")

    members = in_blocks(distinct.join(reached, "rep").select("component", "rep", "copies"), ["component"], block_rows)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, copies, mine = unit_rows(pdf["embedding"]), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        links = np.zeros(len(pdf), np.int64)
        for at in range(0, len(pdf), 1024):
            close = unit[at : at + 1024] @ unit.T >= least
            if x != y:
                close &= mine[at : at + 1024, None] != mine[None, :]
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
            links[at : at + 1024] = close @ copies
        return pd.DataFrame({"rep": pdf["rep"], "links": links})

    counted = members.join(vectors_of, "rep").groupBy("component", "x", "y").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = distinct.join(reached, "rep", "left").join(counted, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    some = fine.join(linked, ["label", "embedding"]).select("id", "n_links", "component_id")
    none = rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none)


#: The same result in DuckDB SQL: all pairs of a label.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM reach JOIN embeddings ON vec_id = reach.a LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON c.a = vec_id GROUP BY vec_id
"""
