"""The traversability seam: named providers with one contract, scores in [0, 1] or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import products

PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """fn(index, vehicle=..., wet=...) -> (r, c, class_id, valid, score)."""
    PROVIDERS[name] = fn


def estimate(name: str, i, vehicle: str = "wheeled", wet: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Scores of a provider, checked at the seam: out of range and infinite values fail, unmeasured cells are null, masked ones 0."""
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    s = PROVIDERS[name](i, vehicle=vehicle, wet=wet).withColumn("score", F.when(F.col("valid"), F.nanvl("score", F.lit(None).cast("double"))))
    bad = F.col("score").isNotNull() & ~F.col("score").between(0.0, 1.0)
    s = s.withColumn("score", F.when(bad, F.raise_error(F.concat(F.lit(f"provider {name} gave "), F.col("score").cast("string"))).cast("double")).otherwise(F.col("score")))
    if mask is not None:
        s = s.join(mask.select("r", "c", F.lit(True).alias("_in")), ["r", "c"], "left").withColumn("score", F.when(F.col("_in"), F.col("score")).otherwise(0.0)).drop("_in")
    return s


def caveats(name: str, scores: DataFrame, has_terrain: bool, notes: tuple[str, ...] = ()) -> str:
    """What a reader must know with the scores: the provider, whether terrain counted, how much wasn't measured, and its notes as they are."""
    n, unknown = scores.agg(F.count("*"), F.count_if(F.col("score").isNull())).first()
    lines = [f"# traversability by {name}, {'with' if has_terrain else 'without'} terrain"]
    lines += [] if has_terrain else ["#   no elevation was used: a map of surfaces, not of going"]
    lines += [f"#   {unknown / n:.1%} wasn't measured: unknown, not impassable"] if n and unknown else []
    return "\n".join(lines + [f"#   {t}" for t in notes])


register("builtin", products.trafficability)
