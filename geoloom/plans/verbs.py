"""The verb query language: find, count, area, distance, describe, corridor.

The text is parsed on the driver; what it can't answer it refuses with a reason.  Each verb is one
lineage of DataFrame operations whose answer carries the ids it rests on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import distance, grid
from ..operators.components import grid_components
from ..operators.graph import staged
from . import products

#: A passage is ground this trafficable; pieces below the floor are left out unless all are.
CORRIDOR_MIN, CORRIDOR_FLOOR_M2 = 0.45, 500.0

# Words that are asked for but that no class stands for, and why.
OUT_OF_VOCABULARY = {
    "people": "people are not a mapped class",
    "person": "people are not a mapped class",
    "population": "population cannot be read off ground cover",
    "height": "heights of objects are not measured",
    "greenhouse": "no class stands for greenhouses",
    "fence": "no class stands for fences",
    "tent": "no class stands for tents",
    "pylon": "no class stands for pylons",
    "powerline": "no class stands for power lines",
    "name": "labels have no proper names; a vector layer may",
}


class Unanswerable(ValueError):
    """A well-formed question that the map cannot answer; the reason is the message."""


@dataclass
class Answer:
    kind: str
    rows: DataFrame
    note: str = ""
    evidence: DataFrame | None = None
    params: dict = field(default_factory=dict)


def need_class(token: str) -> int:
    low = token.lower()
    if low in OUT_OF_VOCABULARY:
        raise Unanswerable(f"{token}: {OUT_OF_VOCABULARY[low]}")
    names = {n.lower(): n for n in tx.by_name()}
    if low not in names:
        raise Unanswerable(f"{token!r} is not one of the {len(names)} classes")
    return tx.class_id(names[low])


def run(i, text: str) -> Answer:
    words = text.split()
    verbs = {"find": _find, "count": _find, "area": _find, "distance": _distance, "describe": _describe, "corridor": _corridor}
    if not words or words[0].lower() not in verbs:
        raise ValueError(f"unknown verb in {text!r}; there are {', '.join(sorted(verbs))}")
    return verbs[words[0].lower()](i, words[0].lower(), words[1:])


def _find(i, verb: str, args: list[str]) -> Answer:
    if not args:
        raise ValueError(f"{verb} needs a class")
    rows = i.regions.where(F.col("class_id") == need_class(args[0]))
    rest, k = args[1:], 0
    while k < len(rest):
        word = rest[k].lower()
        if word == "minarea":
            rows, k = rows.where(F.col("area_m2") >= float(rest[k + 1])), k + 2
        elif word == "slope":
            op = rest[k + 1]
            if op not in "<>":
                raise ValueError(f"slope needs < or >, not {op!r}")
            if getattr(i, "has_terrain", True) is False:
                raise Unanswerable("slope was not measured: there is no elevation")
            rows, k = rows.where(f"mean_slope {op} {float(rest[k + 2])}"), k + 3
        elif word == "near":
            rows, k = near(i, rows, need_class(rest[k + 1]), float(rest[k + 2])), k + 3
        else:
            raise ValueError(f"unknown filter {rest[k]!r}")
    ids = rows.select("region_id")
    if verb == "find":
        return Answer("find", rows.select("region_id", "class_id", "area_m2", "mean_slope", "r0", "c0", "r1", "c1").orderBy(F.desc("area_m2"), "region_id"), evidence=ids)
    total = F.coalesce(F.sum("area_m2"), F.lit(0)).cast("double").alias("area_m2")
    return Answer(verb, rows.agg(F.count("*").alias("n"), total) if verb == "count" else rows.agg(total), evidence=ids)


def near(i, rows: DataFrame, class_id: int, metres: float) -> DataFrame:
    """Regions whose centroid's cell lies within metres of the class: nearest distances, met by cell."""
    cells = i.cells.withColumn("seed", F.col("valid") & (F.col("class_id") == class_id))
    d2 = distance.nearest_d2(cells, "seed").where(F.col("d2") <= (metres / i.gsd) ** 2)
    at = rows.withColumn("_r", F.floor("cy")).withColumn("_c", F.floor("cx"))
    return at.join(d2.select(F.col("r").alias("_r"), F.col("c").alias("_c")), ["_r", "_c"], "left_semi").drop("_r", "_c")


def _distance(i, verb: str, args: list[str]) -> Answer:
    """Closest approach of two classes: the first one's distance field, looked up on the second's cells."""
    a, b = map(need_class, args[:2])
    field_ = distance.nearest_d2(i.cells.withColumn("seed", F.col("valid") & (F.col("class_id") == a)), "seed")
    there = i.valid.where(F.col("class_id") == b).select("r", "c").join(field_, ["r", "c"]).where("d2 is not null")
    best = there.orderBy("d2", "r", "c").limit(1).select(F.col("r").alias("br"), F.col("c").alias("bc"), "d2")
    mine = i.valid.where(F.col("class_id") == a).select(F.col("r").alias("ar"), F.col("c").alias("ac"))
    met = mine.join(F.broadcast(best), (F.col("ar") - F.col("br")) * (F.col("ar") - F.col("br")) + (F.col("ac") - F.col("bc")) * (F.col("ac") - F.col("bc")) == F.col("d2"))
    row = met.orderBy("ar", "ac").limit(1)
    return Answer("distance", row.select("ar", "ac", "br", "bc", "d2", (F.sqrt("d2") * i.gsd).alias("metres")))


def _describe(i, verb: str, args: list[str]) -> Answer:
    hist = i.valid.groupBy("class_id").agg(F.count("*").alias("px")).join(i.dim.select("class_id", "name", "superclass"), "class_id")
    return Answer("describe", hist.select("name", "superclass", "px", (F.col("px") * i.pixel_m2).alias("area_m2")), "pixels; regions are counted after the area cut")


def passable_pieces(i, vehicle: str, least: float, surface: float | None, width_px: int) -> DataFrame:
    """(r, c, root) of 8-connected pieces of ground at least this trafficable and wide."""
    score = products.trafficability(i, vehicle).where("valid")
    if surface is not None:
        score = score.join(i.dim.select("class_id", "traffic"), "class_id").where(F.col("traffic") >= surface)
    ok = i.cells.select("r", "c").join(score.where(F.col("score") >= least).select("r", "c", F.lit(True).alias("ok")), ["r", "c"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    wide = grid.opening(ok, "ok", width_px, "wide") if width_px > 1 else ok.withColumn("wide", F.col("ok"))
    return grid_components(wide.where("wide").withColumn("key", F.lit(1)), "key", i.stride).select("r", "c", "root")


def _corridor(i, verb: str, args: list[str]) -> Answer:
    seed = need_class(args[0])
    vehicle = args[2] if len(args) > 2 and args[1] == "vehicle" else "wheeled"
    if vehicle not in tx.VEHICLES:
        raise ValueError(f"unknown vehicle {vehicle!r}; there are {', '.join(sorted(tx.VEHICLES))}")
    pieces = staged(passable_pieces(i, vehicle, CORRIDOR_MIN, None, max(1, round(tx.VEHICLES[vehicle][3] / i.gsd))))
    touched = pieces.join(i.valid.where(F.col("class_id") == seed).select("r", "c"), ["r", "c"], "left_semi").select("root").distinct()
    sizes = pieces.join(touched, "root", "left_semi").groupBy("root").agg((F.count("*") * i.pixel_m2).alias("area_m2"))
    big = sizes.agg(F.coalesce(F.max(F.col("area_m2") >= CORRIDOR_FLOOR_M2), F.lit(False)).alias("some_big"))
    kept = sizes.join(F.broadcast(big)).where(~F.col("some_big") | (F.col("area_m2") >= CORRIDOR_FLOOR_M2))
    seen = i.valid.agg((F.count("*") * i.pixel_m2).alias("seen"))
    out = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("area_m2")).join(F.broadcast(seen))
    return Answer("corridor", out.select("n", "area_m2", F.round(F.col("area_m2") / F.col("seen"), 6).alias("share")), evidence=kept.select("root"))


# ---- tool calls: the same verbs behind named, typed arguments ------------------------------------

_CLASS = {"type": "string", "description": "a class name"}
TOOLS = [
    {"name": "find_regions", "verb": "find", "args": {"class_name": _CLASS, "min_area_m2": {"type": "number"}, "near_class": _CLASS, "near_m": {"type": "number"}}, "required": ["class_name"]},
    {"name": "count_regions", "verb": "count", "args": {"class_name": _CLASS, "min_area_m2": {"type": "number"}}, "required": ["class_name"]},
    {"name": "total_area", "verb": "area", "args": {"class_name": _CLASS}, "required": ["class_name"]},
    {"name": "closest_approach", "verb": "distance", "args": {"class_a": _CLASS, "class_b": _CLASS}, "required": ["class_a", "class_b"]},
    {"name": "describe_map", "verb": "describe", "args": {}, "required": []},
    {"name": "corridor", "verb": "corridor", "args": {"class_name": _CLASS, "vehicle": {"type": "string", "enum": sorted(tx.VEHICLES)}}, "required": ["class_name"]},
]


def tool_definitions() -> list[dict]:
    return [{"name": t["name"], "input_schema": {"type": "object", "properties": t["args"], "required": t["required"]}} for t in TOOLS]


def query_string(name: str, args: dict) -> str:
    """The verb query of a tool call; a malformed call is an error, not a guess."""
    tool = next((t for t in TOOLS if t["name"] == name), None)
    if tool is None:
        raise ValueError(f"unknown tool {name!r}")
    for key, value in args.items():
        if key not in tool["args"]:
            raise ValueError(f"{name} has no argument {key!r}")
        kind = tool["args"][key]["type"]
        if kind == "number" and (isinstance(value, bool) or not isinstance(value, (int, float))) or kind == "string" and not (isinstance(value, str) and re.fullmatch(r"\w+", value)):
            raise ValueError(f"{key} should be a {kind}")
    missing = [k for k in tool["required"] if k not in args]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    words = [tool["verb"], *(args[k] for k in ("class_name", "class_a", "class_b") if k in args)]
    if "min_area_m2" in args:
        words += ["minarea", str(args["min_area_m2"])]
    if "near_class" in args:
        words += ["near", args["near_class"], str(args.get("near_m", 50))]
    if "vehicle" in args:
        words += ["vehicle", args["vehicle"]]
    return " ".join(words)


def call(i, name: str, args: dict, most_rows: int = 40, most_ids: int = 25) -> dict:
    """{'status': ok | empty | unanswerable | error, ...}: rows and evidence ids are capped, their totals aren't."""
    try:
        answer = run(i, query_string(name, args))
    except Unanswerable as e:
        return {"status": "unanswerable", "reason": str(e)}
    except (ValueError, KeyError, IndexError) as e:
        return {"status": "error", "reason": str(e)}
    total = answer.rows.count()
    rows = [r.asDict() for r in answer.rows.limit(most_rows).collect()]
    n_ids = answer.evidence.count() if answer.evidence is not None else 0
    ids = [r[0] for r in answer.evidence.orderBy(answer.evidence.columns[0]).limit(most_ids).collect()] if n_ids else []
    zero = all(not any(v for v in r.values()) for r in rows)
    status = "empty" if not n_ids and (not rows or zero) and answer.kind != "describe" else "ok"
    return {"status": status, "query": query_string(name, args), "rows": rows, "rows_omitted": total - len(rows), "evidence": ids, "evidence_omitted": n_ids - len(ids), "note": answer.note}
