"""Exact squared Euclidean distances to the nearest seed cell, in integers.

Two separable passes: along rows a pair of window functions finds the nearest seed's offset; down
columns a kernel takes the lower envelope of the parabolas, one block of columns a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_importable


def envelope(rows: np.ndarray, g2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over i of (at - rows[i])**2 + g2[i], by the lower envelope; rows ascending."""
    v, z = np.empty(len(rows), np.int64), np.empty(len(rows) + 1)
    k = 0
    v[0], z[0], z[1] = 0, -np.inf, np.inf
    for q in range(1, len(rows)):
        while True:
            p = v[k]
            s = ((g2[q] + rows[q] ** 2) - (g2[p] + rows[p] ** 2)) / (2.0 * (rows[q] - rows[p]))
            if s > z[k] or k == 0 and s == -np.inf:
                break
            k -= 1
        k += 1
        v[k], z[k], z[k + 1] = q, s, np.inf
    # the parabola below each place, and its neighbours, so that rounding of a crossing can't matter
    i = np.clip(np.searchsorted(z[1 : k + 1], at), 0, k)
    near = [v[np.clip(i + d, 0, k)] for d in (-1, 0, 1)]
    return np.min([(at - rows[n]) ** 2 + g2[n] for n in near], axis=0)


def nearest_d2(cells: DataFrame, seed: str, group: str | None = None) -> DataFrame:
    """(r, c[, group], d2): d2 null where there is no seed (in the group) at all."""
    ensure_importable(cells.sparkSession)
    by = [group] if group else []
    base = cells.select("r", "c", *by, F.when(F.col(seed), F.col("c")).alias("s"))
    row = Window.partitionBy(*by, "r").orderBy("c")
    left = F.last("s", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("s", ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("c") - left, right - F.col("c"))

    def kernel(table: pa.Table) -> pa.Table:
        t = table.sort_by([("c", "ascending"), ("r", "ascending")])
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        has = t.column("g").is_valid().to_numpy()
        g2 = np.where(has, t.column("g").fill_null(0).to_numpy().astype(np.int64), 0) ** 2
        out, ok = np.zeros(len(r), np.int64), np.zeros(len(r), bool)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            h = has[a:b]
            if h.any():
                out[a:b], ok[a:b] = envelope(r[a:b][h], g2[a:b][h], r[a:b]), True
        t = t.drop_columns(["g", "block"]).append_column("d2", pa.array(out, mask=~ok))
        return t

    first = base.select("r", "c", *by, g.cast("long").alias("g"), F.floor(F.col("c") / 16).alias("block"))
    schema = "r long, c long, " + (f"{group} {dict(cells.dtypes)[group]}, " if group else "") + "d2 long"
    return first.groupBy(*by, "block").applyInArrow(kernel, schema)
