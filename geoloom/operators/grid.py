"""Operators on dense or sparse grids: neighbours, moving windows, morphology, slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells a side of the tiles that windows are computed in; a window partition is one row or column.
_ROW, _COL = ("r", "c"), ("c", "r")


def _along(axis: tuple[str, str]):
    return Window.partitionBy(axis[0]).orderBy(axis[1])


def neighbour_pairs(cells: DataFrame, value: str = "class_id") -> DataFrame:
    """(r, c, a, b) of each cell with its right and its lower neighbour, where both are valid.

    Two sorts of one shuffle each, no self join; a missing cell leaves no pair.
    """
    v = F.when(F.col("valid"), F.col(value))
    out = None
    for axis in (_ROW, _COL):
        w = _along(axis)
        there = F.lead(axis[1]).over(w) == F.col(axis[1]) + 1
        part = cells.select("r", "c", v.alias("a"), F.when(there, F.lead(v).over(w)).alias("b")).where("a is not null and b is not null")
        out = part if out is None else out.unionByName(part)
    return out


def gradient(cells: DataFrame, gsd: float, value: str = "elev") -> DataFrame:
    """cells with gy, gx: central differences, one-sided at the grid's edges, 0 where alone."""
    out = cells
    for name, axis in (("gy", _COL), ("gx", _ROW)):
        w = _along(axis)
        low, high, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        g = F.when(low.isNotNull() & high.isNotNull(), (high - low) / (2 * gsd)).when(high.isNotNull(), (high - own) / gsd).when(low.isNotNull(), (own - low) / gsd).otherwise(0.0)
        out = out.withColumn(name, g)
    return out


def slope_degrees() -> Column:
    return F.degrees(F.atan(F.hypot("gx", "gy")))


def box_sum(cells: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """k x k sums (k odd) with the edges replicated, by rows and then by columns."""
    assert k % 2 == 1, "an even window has no centre cell"
    h = k // 2
    out, v = cells, value
    for axis, made in ((_ROW, "_s"), (_COL, name)):
        i = F.col(axis[1])
        whole = Window.partitionBy(axis[0])
        near = whole.orderBy(axis[1]).rangeBetween(-h, h)
        lo, hi = F.min(axis[1]).over(whole), F.max(axis[1]).over(whole)
        first, last = F.min_by(v, axis[1]).over(whole), F.max_by(v, axis[1]).over(whole)
        padded = F.sum(v).over(near) + first * F.greatest(F.lit(0), h - (i - lo)) + last * F.greatest(F.lit(0), h - (hi - i))
        out, v = out.withColumn(made, padded), made
    return out.drop("_s")


def box_mean(cells: DataFrame, value: str, k: int, name: str) -> DataFrame:
    return box_sum(cells, value, k, name).withColumn(name, F.col(name) / float(k * k))


def local_std(cells: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """Standard deviation in k x k, from the means of the value and of its square."""
    out = box_mean(box_mean(cells.withColumn("_q", F.col(value) * F.col(value)), value, k, "_m"), "_q", k, "_mq")
    return out.withColumn(name, F.sqrt(F.greatest(F.lit(0.0), F.col("_mq") - F.col("_m") * F.col("_m")))).drop("_q", "_m", "_mq")


def _extreme(cells: DataFrame, mask: str, lo: int, hi: int, name: str, erode: bool) -> DataFrame:
    out, v = cells, F.col(mask).cast("int")
    for axis, made in ((_ROW, "_x"), (_COL, name)):
        near = Window.partitionBy(axis[0]).orderBy(axis[1]).rangeBetween(-lo, hi)
        # outside the grid is 0: an erosion fails there, a dilation doesn't notice
        e = F.when(F.count(F.lit(1)).over(near) == lo + hi + 1, F.min(v).over(near)).otherwise(0) if erode else F.max(v).over(near)
        out, v = out.withColumn(made, e), F.col(made)
    return out.withColumn(name, F.col(name) == 1).drop("_x")


def dilate(cells: DataFrame, mask: str, k: int, name: str) -> DataFrame:
    return _extreme(cells, mask, k - 1 - k // 2, k // 2, name, False)


def erode(cells: DataFrame, mask: str, k: int, name: str) -> DataFrame:
    return _extreme(cells, mask, k // 2, k - 1 - k // 2, name, True)


def opening(cells: DataFrame, mask: str, k: int, name: str) -> DataFrame:
    """Erosion, then dilation mirrored to it: idempotent, and never adds a cell."""
    return dilate(erode(cells, mask, k, "_e"), "_e", k, name).drop("_e")


def prefix_sum(cells: DataFrame, value: str, name: str) -> DataFrame:
    """Sum over all cells up and left of each, itself included."""
    upto = lambda axis: _along(axis).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_p", F.sum(value).over(upto(_ROW))).withColumn(name, F.sum("_p").over(upto(_COL))).drop("_p")


def densest_window(cells: DataFrame, value: str, size: int, step: int) -> DataFrame:
    """(r, c, total) of the size x size window with the highest sum among those step apart; ties to the first."""
    summed = prefix_sum(cells, value, "p").select("r", "c", "p")
    starts = lambda x: (F.col(x) >= size - 1) & ((F.col(x) - size + 1) % step == 0)
    corner = summed.where(starts("r") & starts("c"))
    at = lambda dr, dc, n: summed.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("p").alias(n))
    joined = corner.join(at(size, 0, "u"), ["r", "c"], "left").join(at(0, size, "l"), ["r", "c"], "left").join(at(size, size, "d"), ["r", "c"], "left")
    total = F.col("p") - F.coalesce("u", F.lit(0)) - F.coalesce("l", F.lit(0)) + F.coalesce("d", F.lit(0))
    return joined.select((F.col("r") - size + 1).alias("r"), (F.col("c") - size + 1).alias("c"), total.alias("total")).orderBy(F.desc("total"), "r", "c").limit(1)
