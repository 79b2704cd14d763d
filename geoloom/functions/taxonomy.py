"""The class dimension, the class-pair dimension and the sets and priors stated over them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Id, wire id, name, superclass, lithology, morphology, traffic, canopy, fabric, volatility.
CLASSES = """
0 0 Unclassified artifact - - 0.5 0 0 0.5
1 2 Clutter artifact - - 0.4 0 0.7 0.5
2 3 Shadow artifact - - 0.5 0 0 0.85
3 5 BrickWall built - - 0 0 0.9 0.05
4 10 House built - - 0 0 0.9 0.05
5 12 GreenGrassland vegetation - - 0.85 0 0.1 0.9
6 15 Car vehicle - - 0 0 0.6 0.8
7 18 Pavement built - - 1 0 0.6 0.05
8 20 PavedRoad road - - 1 0 0.6 0.03
9 30 DirtRoad road - - 0.9 0 0.5 0.15
10 35 DirtRoadB road - - 0.75 0 0.45 0.15
11 40 Water water - - 0 0 0 0.5
12 94 MaralBadlands rock Marl Badlands 0.1 0 0 0.05
13 104 MaralSmoothRockSlopes rock Marl SmoothRockSlopes 0.35 0 0 0.05
14 107 MaralTerrace rock Marl Terrace 0.7 0 0 0.05
15 108 TerraRosa soil - - 0.7 0 0 0.2
16 110 ClayeySoil soil - - 0.6 0 0 0.2
17 112 Rendzina soil - - 0.7 0 0 0.2
18 114 HydromorpicSoil soil - - 0.3 0 0 0.5
19 116 ClayeyDeepSoil soil - - 0.55 0 0 0.2
20 118 UnirrigatedOrchard agriculture - - 0.6 0.4 0.35 0.7
21 122 IrrigatedOrchard agriculture - - 0.55 0.6 0.35 0.7
22 124 IrrigatedField agriculture - - 0.7 0.1 0.35 0.7
23 126 Batha vegetation - - 0.7 0.2 0.1 0.35
24 128 Garigue vegetation - - 0.5 0.4 0.1 0.35
25 130 Maquis vegetation - - 0.2 0.8 0.1 0.35
26 132 DryGrassland vegetation - - 0.85 0 0.1 0.9
27 162 LimestoneRockyTerrain rock Limestone RockyTerrain 0.25 0 0 0.05
28 166 LimestoneBoulder rock Limestone Boulder 0.05 0 0 0.05
29 168 LimestoneStoneyTerrain rock Limestone StoneyTerrain 0.55 0 0 0.05
30 170 LimestoneHardRockLineament rock Limestone HardRockLineament 0.2 0 0 0.05
31 172 LimestoneBeddedRock rock Limestone BeddedRock 0.3 0 0 0.05
32 176 LimestoneRockDipSlope rock Limestone RockDipSlope 0.2 0 0 0.05
33 177 LimestoneTerrace rock Limestone Terrace 0.65 0 0 0.05
34 178 DolomiteRockyTerrain rock Dolomite RockyTerrain 0.25 0 0 0.05
35 182 DolomiteBoulder rock Dolomite Boulder 0.05 0 0 0.05
36 184 DolomiteStoneyTerrain rock Dolomite StoneyTerrain 0.55 0 0 0.05
37 193 DolomiteTerrace rock Dolomite Terrace 0.65 0 0 0.05
38 194 NariRockyTerrain rock Nari RockyTerrain 0.3 0 0 0.05
39 200 NariStoneyTerrain rock Nari StoneyTerrain 0.6 0 0 0.05
40 208 NariRockDipSlope rock Nari RockDipSlope 0.25 0 0 0.05
41 209 NariTerrace rock Nari Terrace 0.65 0 0 0.05
42 210 BasaltRockyTerrain rock Basalt RockyTerrain 0.2 0 0 0.05
43 214 BasaltBoulder rock Basalt Boulder 0.05 0 0 0.05
44 216 BasaltStoneyTerrain rock Basalt StoneyTerrain 0.5 0 0 0.05
45 238 ChalkSmoothRockSlopes rock Chalk SmoothRockSlopes 0.4 0 0 0.05
46 241 ChalkTerrace rock Chalk Terrace 0.6 0 0 0.05
"""
COLUMNS = "class_id INT, wire_id INT, name STRING, superclass STRING, lithology STRING, morphology STRING, traffic DOUBLE, canopy DOUBLE, fabric DOUBLE, volatility DOUBLE"

# Ordinal series, anchors, wet classes, seasonal pairs, sets of the change and triage rules.
SERIES = {"vegetation": ["DryGrassland", "Batha", "Garigue", "Maquis"], "road": ["DirtRoadB", "DirtRoad", "PavedRoad"]}
ANCHORS = ["PavedRoad", "DirtRoad", "House", "Pavement", "Water", "Maquis", "BrickWall"]
WET = ["HydromorpicSoil", "ClayeyDeepSoil", "ClayeySoil", "Water", "IrrigatedField", "IrrigatedOrchard"]
SEASONAL = [("GreenGrassland", "DryGrassland"), ("IrrigatedField", "DryGrassland")]
BUILT = ["House", "Pavement", "BrickWall", "PavedRoad"]
LINEAR = ["PavedRoad", "DirtRoad", "DirtRoadB", "BrickWall"]
AREA_BANDS = {"Car": (4.0, 30.0), "House": (25.0, 2000.0), "BrickWall": (2.0, 500.0)}
MORPHOLOGY_SLOPES = {
    "Terrace": (0.0, 6.0),
    "SmoothRockSlopes": (6.0, 30.0),
    "StoneyTerrain": (0.0, 20.0),
    "RockyTerrain": (10.0, 45.0),
    "BeddedRock": (8.0, 35.0),
    "RockDipSlope": (10.0, 40.0),
    "Boulder": (15.0, 60.0),
    "Badlands": (12.0, 50.0),
}
COHERENT = ["RockDipSlope", "Terrace"]
# Vehicle -> highest slope, least surface, loss when wet, width in metres.
VEHICLES = {"wheeled": (25.0, 0.45, 0.7, 2.5), "tracked": (35.0, 0.20, 0.4, 3.5), "foot": (45.0, 0.05, 0.15, 0.0)}
# Target -> footprint in square metres, height in metres.
TARGETS = {"person": (0.5, 1.7), "vehicle": (8.0, 2.0), "structure": (100.0, 5.0)}
# Subject, others that its boundary should have, slope band, cap of aspect variance.
PRIORS = [
    ("MaralBadlands", [], (8.0, 90.0), None),
    ("LimestoneRockDipSlope", [], None, 0.25),
    ("NariRockDipSlope", [], None, 0.25),
    ("HydromorpicSoil", ["Water", "ClayeyDeepSoil"], (0.0, 5.0), None),
    ("Car", ["Pavement", "PavedRoad", "DirtRoad", "House"], None, None),
    ("Maquis", ["Garigue", "Batha"], None, None),
]
CATEGORIES = ["phenology", "succession", "construction", "demolition", "infrastructure", "impossible", "real-change", "noise"]


@cache
def rows() -> list[tuple]:
    out = []
    for line in CLASSES.strip().splitlines():
        k, wire, name, sup, lith, morph, *nums = line.split()
        out.append((int(k), int(wire), name, sup, None if lith == "-" else lith, None if morph == "-" else morph, *map(float, nums)))
    return out


@cache
def by_name() -> dict[str, tuple]:
    return {r[2]: r for r in rows()}


def class_id(name: str) -> int:
    """Id of a class name; an unknown name is refused, never guessed."""
    if name not in by_name():
        raise KeyError(f"{name!r} is not one of the {len(rows())} classes")
    return by_name()[name][0]


def ids(names) -> list[int]:
    return [class_id(n) for n in names]


def class_distance(a: int, b: int) -> float:
    """Semantic distance in [0, 1]: series steps, then rock by lithology and morphology, then superclass."""
    if a == b:
        return 0.0
    x, y = rows()[a], rows()[b]
    for members in SERIES.values():
        if x[2] in members and y[2] in members:
            return 0.75 * abs(members.index(x[2]) - members.index(y[2])) / (len(members) - 1)
    if x[4] and y[4]:
        return 0.35 if x[4] == y[4] else 0.45 if x[5] == y[5] else 0.7
    return 0.4 if x[3] == y[3] else 1.0


def change_category(a: int, b: int) -> str:
    """What a change of class a into b means."""
    x, y = rows()[a], rows()[b]
    na, nb = x[2], y[2]
    seasonal = {frozenset(p) for p in SEASONAL}
    road, plants = SERIES["road"], SERIES["vegetation"]
    rules = [
        (lambda: a == b, "noise"),
        (lambda: frozenset((na, nb)) in seasonal, "phenology"),
        (lambda: bool(x[4] and y[4]) and x[4] != y[4], "impossible"),
        (lambda: na in road and nb in road, "infrastructure"),
        (lambda: na in plants and nb in plants and abs(plants.index(na) - plants.index(nb)) >= 2, "real-change"),
        (lambda: na in plants and nb in plants, "succession"),
        (lambda: nb in BUILT and na not in BUILT, "construction"),
        (lambda: na in BUILT and nb not in BUILT, "demolition"),
        (lambda: "artifact" in (x[3], y[3]), "noise"),
        (lambda: class_distance(a, b) < 0.4, "noise"),
    ]
    return next((name for test, name in rules if test()), "real-change")


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)


def dim_class(spark: SparkSession) -> DataFrame:
    """The 47 classes: a constant table, so its broadcast has a fixed size."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows())} as d({', '.join(names)})")


@cache
def pair_rows() -> list[tuple]:
    n = len(rows())
    return [(a, b, class_distance(a, b), change_category(a, b)) for a in range(n) for b in range(n)]


def dim_class_pair(spark: SparkSession) -> DataFrame:
    """(a, b, distance, category) of all ordered pairs, computed from the rules."""
    return spark.sql("select * from values " + ", ".join(f"({a}, {b}, {d!r}D, '{c}')" for a, b, d, c in pair_rows()) + " as p(a, b, distance, category)")


def duck_dim() -> str:
    """The same class dimension as a DuckDB subquery."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows())}) t({', '.join(names)}))"


def duck_pairs() -> str:
    return "(select * from (values " + ", ".join(f"({a}, {b}, {d!r}::double, '{c}')" for a, b, d, c in pair_rows()) + ") t(a, b, distance, category))"
