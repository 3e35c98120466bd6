"""Vectors stored in cells of like direction, so that an exact search can leave most of them unread.

A cell is a folder of files with the direction of its centre and the least
cosine of its vectors to it. A vector that is ``a`` away from a query, as an
angle, is no nearer to any centre than ``a`` less its own distance from that:
no vector of a cell can beat the bound this gives, and cells whose bound is
below the ``k``-th best score found so far are skipped without any loss.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import vectors
from assetloom.operators import search
from assetloom.session import cut_lineage

# Bytes of the sample that centres are chosen from; they decide what is skipped, never what is found.
SAMPLE_BYTES = 32 << 20
ROUNDS = 8
# Rows of the cells that are read first for each hit wanted.
FIRST_ROWS = 4
# Cell of vectors that have no direction, or another length: no search reads it.
NO_CELL = -1

_PLACED = pa.struct([("cell", pa.int32()), ("cosine", pa.float64())])


class PrunedHits(NamedTuple):
    hits: DataFrame
    cells_read: list[int]
    cells: int


def choose_centres(embeddings: DataFrame, dimension: int, cells: int, seed: int = 7) -> np.ndarray:
    """Up to ``cells`` directions, by spherical k-means over a bounded sample."""
    rows = max(cells, SAMPLE_BYTES // (8 * dimension))
    total = embeddings.count()
    sample = embeddings.select("vector").sample(fraction=min(1.0, 2 * rows / max(1, total)), seed=seed).limit(rows)
    unit, _ = search._unit_rows(search._one_chunk(sample.toArrow().column("vector")), dimension)
    unit = np.unique(unit, axis=0)
    if len(unit) <= cells:
        return unit
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1)
        # A centre without vectors, or with opposite ones only, moves to one that is badly placed.
        lost = np.flatnonzero(length < 1e-9)
        far = np.argsort((unit * centres[nearest]).sum(1))[: len(lost)]
        sums[lost], length[lost] = unit[far], 1.0
        centres = sums / length[:, None]
    return centres


def write_cells(embeddings: DataFrame, folder: str, dimension: int, cells: int = 256) -> None:
    """Write ``embeddings`` as cells below ``folder``, with a small table of their bounds.

    All columns are kept. Adaptive execution splits a cell that holds a large
    share of all rows into several files.
    """
    spark = embeddings.sparkSession
    centres = choose_centres(embeddings, dimension, cells)
    shared = spark.sparkContext.broadcast(centres)

    def place(column: pa.Array) -> pa.Array:
        cell, cosine = np.full(len(column), NO_CELL, np.int32), np.zeros(len(column))
        unit, kept = search._unit_rows(column, dimension)
        if len(kept) and len(shared.value):
            near = unit @ shared.value.T
            cell[kept], cosine[kept] = near.argmax(1), near.max(1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(cosine)], fields=list(_PLACED))

    # Written once with its cell: what follows only deals whole rows to folders.
    located = embeddings.withColumn("_at", F.arrow_udf(place, "struct<cell:int,cosine:double>")(F.col("vector")))
    located = cut_lineage(located, "located")
    bounds = located.groupBy("_at.cell").agg(F.count(F.lit(1)).alias("rows"), F.min("_at.cosine").alias("least"))
    points = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    bounds.filter(F.col("cell") != NO_CELL).join(points, "cell").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")
    rows = located.select(*embeddings.columns, F.col("_at.cell").alias("cell")).hint("rebalance", "cell")
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    shared.destroy()


def cell_bounds(bounds: pa.Table, unit: np.ndarray) -> np.ndarray:
    """The best cosine that a vector of each cell can have to ``unit``."""
    centres = np.array(bounds.column("centre").to_pylist()).reshape(-1, len(unit))
    away = np.arccos(np.clip(centres @ unit, -1, 1)) - np.arccos(np.clip(bounds.column("least").to_numpy(), -1, 1))
    return np.cos(np.clip(away, 0, np.pi))


def pruned_topk(
    spark: SparkSession, folder: str, functions: DataFrame, query: list[float], k: int = search.SEARCH_LIMIT
) -> PrunedHits:
    """``cosine_topk`` over written cells: the same rows, from as few cells as can hold them.

    The cells that promise most are read until ``k`` assets are found; the
    ``k``-th score then tells which others have to be read.
    """
    bounds = spark.read.parquet(f"{folder}/bounds").toArrow()  # a row per cell
    stored = spark.read.parquet(f"{folder}/vectors")
    _, unit = search._one_query(query)
    none = PrunedHits(search.cosine_topk(stored.filter("false"), functions, query, k), [], bounds.num_rows)
    if not len(unit) or not bounds.num_rows:
        return none
    best = cell_bounds(bounds, unit[0])
    order = np.argsort(-best, kind="stable")
    cell, rows = bounds.column("cell").to_numpy()[order], bounds.column("rows").to_numpy()[order]
    best, read, wanted = best[order], 0, FIRST_ROWS * k
    hits, floor = None, -np.inf
    while read < len(cell) and best[read] >= floor:
        # Either the next cells in turn, or all that may still hold one of the best.
        upto = np.searchsorted(np.cumsum(rows), wanted) + 1 if np.isneginf(floor) else np.count_nonzero(best >= floor)
        upto = min(max(upto, read + 1), len(cell))
        new = search.cosine_topk(stored.filter(F.col("cell").isin(cell[read:upto].tolist())), functions, query, k)
        both = new if hits is None else hits.unionByName(new)
        hits = cut_lineage(both.orderBy(*search._order()).limit(k), "pruned-hits")
        n, worst = hits.agg(F.count(F.lit(1)), F.min("score")).first()
        floor = worst - 2 * 10**-vectors.SCORE_DIGITS if n == k else -np.inf
        read, wanted = upto, 4 * wanted
    return PrunedHits(hits, [int(c) for c in cell[:read]], len(cell))
