"""8-connected components of a keyed grid.

Cells are labelled within square tiles by a NumPy kernel; tile seams give edges between the
labels, and the (much smaller) label graph is resolved by alternating stars.  A component's root
is its smallest row * stride + column, so roots are stable whatever the tiling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from .graph import connected_components, staged

TILE = 512


def label_tile(r: np.ndarray, c: np.ndarray, key: np.ndarray, stride: int) -> np.ndarray:
    """Root (least r * stride + c) of each cell among cells of equal key that touch, corners included."""
    r0, c0 = r.min(), c.min()
    h, w = int(r.max() - r0) + 3, int(c.max() - c0) + 3
    grid = np.full((h, w), -1, np.int64)
    i, j = (r - r0 + 1).astype(int), (c - c0 + 1).astype(int)
    order = np.argsort(r * stride + c, kind="stable")
    grid[i[order], j[order]] = np.arange(len(r))
    u, v = [], []
    for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1)):
        a = grid[i[order], j[order]]
        b = grid[i[order] + di, j[order] + dj]
        same = (b >= 0) & (key[order[a]] == key[order[b]])
        u.append(a[same])
        v.append(b[same])
    u, v = np.concatenate(u), np.concatenate(v)
    root = np.arange(len(r))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    names = (r * stride + c)[order]
    out = np.empty(len(r), np.int64)
    out[order] = names[root]
    return out


def grid_components(cells: DataFrame, key: str, stride: int, tile: int = TILE) -> DataFrame:
    """(r, c, key, root) of cells (r, c, key) whose key isn't null."""
    spark = cells.sparkSession
    ensure_importable(spark)

    def kernel(table: pa.Table) -> pa.Table:
        r, c, k = (table.column(n).to_numpy() for n in ("r", "c", "key"))
        return pa.table({"r": r, "c": c, "key": k, "root": label_tile(r, c, k, stride)})

    keyed = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(key).cast("long").alias("key")).where("key is not null")
    at = [F.floor(F.col(x) / tile).alias(n) for x, n in (("r", "tr"), ("c", "tc"))]
    local = staged(keyed.select("*", *at).groupBy("tr", "tc").applyInArrow(kernel, "r long, c long, key long, root long"))
    # only cells in a tile's last row or column, or its first column, have neighbours in a later tile
    edge = local.where((F.col("r") % tile == tile - 1) | (F.col("c") % tile == tile - 1) | (F.col("c") % tile == 0))
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    out = edge.select(F.col("root").alias("a"), "key", "r", "c", F.explode(steps).alias("s")).select("a", "key", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    far = local.where((F.col("r") % tile == 0) | (F.col("c") % tile == 0) | (F.col("c") % tile == tile - 1)).select("r", "c", "key", F.col("root").alias("b"))
    roots = connected_components(out.join(far, ["r", "c", "key"]).where("a <> b").select("a", "b").distinct())
    named = roots.select(F.col("node").alias("root"), F.col("component"))
    return local.join(named, "root", "left").select("r", "c", "key", F.coalesce("component", "root").alias("root"))
