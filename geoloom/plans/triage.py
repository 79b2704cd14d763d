"""Triage: small auditable policies scored over units (chips or blocks) within a budget.

A policy is data (JSON).  Its weights are a broadcast dimension, its rules compile to Catalyst
expressions, and a whole corpus of units is scored by one aggregation and one projection.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators.rank import number_rows

# Excluded mass, entropy weights, control share, budget, habitat and proximity terms.
EXCLUDE_DOMINANCE, CONTROL_FRACTION, BUDGET = 0.80, 0.03, 0.20
ENTROPY_WEIGHT = {"R1": 0.0, "R2": 0.15, "R3": 0.5}
HABITAT_WEIGHT, NEAR_M, PROXIMITY_CAP, APPLICABLE_MIN, CONTEXT_WEIGHT, NEAR_MISS = 0.6, 120.0, 0.5, 0.02, 0.45, 0.6


@dataclass
class Policy:
    policy_id: str
    query: str
    regime: str = "R2"
    class_weights: dict[str, float] = field(default_factory=dict)
    hard_exclude: list[str] = field(default_factory=list)
    rules: list[tuple[str, float]] = field(default_factory=list)
    applies_to: list[str] = field(default_factory=list)
    context_classes: list[str] = field(default_factory=list)
    absence: bool = False
    unmatched: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        made = cls(**json.loads(text))
        made.rules = [tuple(r) for r in made.rules]
        return made

    def understood(self) -> str:
        """What the policy does, in a line."""
        parts = [f"weights {len(self.class_weights)} classes", f"excludes {len(self.hard_exclude)}", f"{len(self.rules)} rules"]
        return f"{self.policy_id}: " + ", ".join(parts) + (f"; not understood: {', '.join(self.unmatched)}" if self.unmatched else "")


# The built-in policies.
BUILTIN = {
    "vehicles": Policy(
        "find-vehicles@v0", "find vehicles, including off-road and partially concealed", "R1+R2",
        {"Car": 1.0, "PavedRoad": 0.9, "Pavement": 0.85, "DirtRoad": 0.7, "DirtRoadB": 0.6, "Clutter": 0.5, "Shadow": 0.45, "House": 0.4, "DryGrassland": 0.25, "Batha": 0.2, "GreenGrassland": 0.2},
        ["Water", "MaralBadlands", "LimestoneBoulder", "DolomiteBoulder", "BasaltBoulder", "LimestoneRockDipSlope", "NariRockDipSlope", "ChalkSmoothRockSlopes", "MaralSmoothRockSlopes"],
        [("dist_to.PavedRoad < 100", 1.6), ("dist_to.DirtRoad < 50", 1.4), ("dist_to.House < 60", 1.3)],
    ),
    "structures": Policy(
        "find-structures@v0", "find buildings and built structures", "R1",
        {"House": 1.0, "Pavement": 0.7, "BrickWall": 0.6, "Clutter": 0.5, "Shadow": 0.4, "PavedRoad": 0.3},
        ["Water", "MaralBadlands", "LimestoneBoulder", "BasaltBoulder"],
        [("dist_to.PavedRoad < 150", 1.4)],
    ),
    "settlement": Policy(
        "find-in-settlement@v0", "find ground objects inside the built-up street network", "R2",
        {"Clutter": 0.9, "Car": 0.9, "Pavement": 0.7, "House": 0.6, "Shadow": 0.55, "Unclassified": 0.5, "PavedRoad": 0.5, "DirtRoad": 0.4, "DryGrassland": 0.2},
        ["Water"],
        [("osm.dist_road < 30", 1.6), ("osm.building_frac > 0.15", 1.4), ("osm.n_junctions > 0", 1.2)],
    ),
    "oov": Policy(
        "find-out-of-vocabulary@v0", "find anything the taxonomy has no word for", "R3",
        {"Clutter": 1.0, "Unclassified": 0.95, "Shadow": 0.5},
        ["Water"],
        [("entropy > 2.5", 1.3)],
    ),
}

_RULE = re.compile(r"\s*([A-Za-z_]+)(?:\.([A-Za-z_]+))?\s*(<=|>=|<|>|==)\s*(-?\d+(?:\.\d+)?)\s*$")


def rule_column(text: str, columns: set[str]) -> Column:
    """A rule as a Boolean expression; what can't be parsed or isn't measured is false, not an error."""
    m = _RULE.match(text)
    if not m:
        return F.lit(False)
    head, tail, op, number = m.groups()
    name = {"dist_to": f"dist_{tail}", "frac": f"frac_{tail}", "osm": f"osm_{tail}", "interface": f"iface_{tail}"}.get(head, head) if tail else head
    if name not in columns:
        return F.lit(False)
    return F.coalesce(F.expr(f"`{name}` {op} {number}"), F.lit(False))


def weight_vector(policy: Policy, dim: DataFrame) -> DataFrame:
    """(class_id, weight) of every class; 0 where the policy names none."""
    weights = F.create_map(*(x for n, w in policy.class_weights.items() for x in (F.lit(tx.class_id(n)), F.lit(float(w))))) if policy.class_weights else None
    return dim.select("class_id", F.coalesce(F.try_element_at(weights, F.col("class_id")), F.lit(0.0)).alias("weight") if weights is not None else F.lit(0.0).alias("weight"))


def not_applicable(selected: DataFrame, applicable: DataFrame, key: list[str]) -> DataFrame:
    """(n): rejected units where what is asked for could not be anyway."""
    both = selected.where(~F.col("selected")).join(applicable, key)
    return both.agg(F.count_if(F.col("applicability") < APPLICABLE_MIN).alias("n"))


def missing_features(policy: Policy, columns: set[str]) -> list[str]:
    """Rules of a policy that these units can't measure."""
    out = []
    for text, _ in policy.rules:
        m = _RULE.match(text)
        name = m and (f"{ {'dist_to': 'dist', 'frac': 'frac', 'osm': 'osm', 'interface': 'iface'}.get(m[1], m[1]) }_{m[2]}" if m[2] else m[1])
        if not m or name not in columns:
            out.append(text)
    return out


def units(i) -> DataFrame:
    """Chips with entropy and the distance in metres to each anchor class; null where it is absent."""
    d = i.chip_anchor.groupBy("chip_r", "chip_c").pivot("anchor", tx.ids(tx.ANCHORS)).agg(F.first("d2"))
    names = {k: n for k, n in zip(tx.ids(tx.ANCHORS), tx.ANCHORS)}
    d = d.select("chip_r", "chip_c", *((F.sqrt(F.col(str(k))) * i.gsd).alias(f"dist_{n}") for k, n in names.items()))
    return i.chips.join(d, ["chip_r", "chip_c"], "left")


def score(policy: Policy, frac: DataFrame, unit: DataFrame, key: list[str]) -> DataFrame:
    """(key, score, excluded, ex_frac): weighted class mass, less excluded mass, times rules and entropy."""
    weight = F.create_map(*(x for n, w in policy.class_weights.items() for x in (F.lit(tx.class_id(n)), F.lit(float(w)))))
    mass = frac.groupBy(*key).agg(F.sum(F.coalesce(weight[F.col("class_id")], F.lit(0.0)) * F.col("frac")).alias("mass"), F.sum(F.when(F.col("class_id").isin(tx.ids(policy.hard_exclude)), F.col("frac")).otherwise(0.0)).alias("ex_frac"))
    rows = unit.join(mass, key)
    s = F.col("mass") * (1 - F.col("ex_frac"))
    for text, factor in policy.rules:
        s = s * F.when(rule_column(text, set(unit.columns)), factor).otherwise(1.0)
    s = s * (1 + ENTROPY_WEIGHT.get(policy.regime.split("+")[0], 0.15) * F.col("entropy") / 4.0)
    out = F.col("ex_frac") > EXCLUDE_DOMINANCE
    return rows.select(*key, F.when(out, 0.0).otherwise(s).alias("score"), out.alias("excluded"), "ex_frac")


def applicability(policy: Policy, frac: DataFrame, unit: DataFrame, key: list[str]) -> DataFrame:
    """(key, applicability): could what is asked about be here at all?  1 where the policy doesn't say."""
    if not policy.applies_to:
        return unit.select(*key, F.lit(1.0 if not policy.unmatched else 0.0).alias("applicability"))
    target, habitat = tx.ids(policy.applies_to), tx.ids([c for c in policy.context_classes if c not in policy.applies_to])
    part = lambda ids, w: F.sum(F.when(F.col("class_id").isin(ids), w * F.col("frac")).otherwise(0.0)) if ids else F.lit(0.0)
    mass = frac.groupBy(*key).agg(part(target, 1.0).alias("t"), part(habitat, CONTEXT_WEIGHT).alias("h"))
    anchors = [f"dist_{n}" for n in [*policy.applies_to, *policy.context_classes] if f"dist_{n}" in unit.columns]
    best = (F.least(*anchors) if len(anchors) > 1 else F.col(anchors[0])) if anchors else F.lit(None).cast("double")
    near = PROXIMITY_CAP * F.coalesce(F.greatest(F.lit(0.0), 1 - best / NEAR_M), F.lit(0.0))
    own = F.greatest("t", "h") if policy.absence else F.least(F.lit(1.0), F.col("t") + HABITAT_WEIGHT * F.col("h"))
    return unit.join(mass, key).select(*key, F.least(F.lit(1.0), F.greatest(own, near)).alias("applicability"), "t")


def select(scored: DataFrame, key: list[str], budget: float = BUDGET) -> DataFrame:
    """scored with rank, selected and control: the budget counts all units, excluded ones included.

    k = max(1, round half even of n * budget); the control set is a hash order of what was rejected.
    Both orders are numbered by range, so no task sees all units.
    """
    n = scored.agg(F.count("*").alias("n"), F.count_if("excluded").alias("n_ex")).select(F.greatest(F.lit(1), F.bround(F.col("n") * budget)).alias("k"), "n")
    ranked = number_rows(scored.withColumn("_down", -F.round("score", 9)), ["excluded", "_down", *key], "rank").join(F.broadcast(n))
    ranked = ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("selected", (F.col("rank") <= F.col("k")) & ~F.col("excluded"))
    drawn = number_rows(ranked.withColumn("_h", F.xxhash64(*key)), ["selected", "_h", *key], "lot")
    control = ~F.col("selected") & (F.col("lot") <= F.greatest(F.lit(1), F.bround((F.col("n") - F.col("k")) * CONTROL_FRACTION)))
    return drawn.withColumn("control", control).select(*scored.columns, "rank", "selected", "control")


# ---- compiling a question ------------------------------------------------------------------------

# Words of questions and the classes they stand for.
VOCABULARY = {
    "vehicle": ["Car"], "car": ["Car"], "truck": ["Car"],
    "building": ["House"], "house": ["House"], "structure": ["House", "BrickWall"], "wall": ["BrickWall"],
    "road": ["PavedRoad", "DirtRoad", "DirtRoadB"], "track": ["DirtRoad", "DirtRoadB"], "paved road": ["PavedRoad"],
    "tree": ["Maquis", "Garigue", "UnirrigatedOrchard", "IrrigatedOrchard"], "orchard": ["UnirrigatedOrchard", "IrrigatedOrchard"], "forest": ["Maquis"],
    "shrub": ["Garigue", "Batha"], "grass": ["GreenGrassland", "DryGrassland"], "field": ["IrrigatedField"],
    "water": ["Water"], "badland": ["MaralBadlands"], "boulder": ["LimestoneBoulder", "DolomiteBoulder", "BasaltBoulder"],
}
ABSENCE = {"missing", "absent", "without", "lost", "gaps", "gap"}
STOP = {"find", "all", "any", "the", "a", "an", "of", "in", "on", "and", "or", "show", "me", "where", "are", "is", "near", "with", "along"}


def compile_query(text: str) -> Policy:
    """A question as a policy; words that it doesn't know are said, never guessed."""
    words = re.findall(r"[a-z0-9_]+", text.lower())
    singular = [w[:-1] if w.endswith("s") and not w.endswith("ss") else w for w in words]
    targets: list[str] = []
    context: list[str] = []
    unmatched: list[str] = []
    k, after_near = 0, False
    while k < len(words):
        for n in (3, 2, 1):
            phrase = " ".join(singular[k : k + n])
            if len(singular[k : k + n]) == n and phrase in VOCABULARY:
                (context if after_near else targets).extend(c for c in VOCABULARY[phrase] if c not in targets + context)
                k += n
                break
        else:
            if words[k] in ("near", "along"):
                after_near = True
            elif words[k] not in STOP | ABSENCE:
                unmatched.append(words[k])
            k += 1
    absence = bool(ABSENCE & set(words))
    weights = {c: 1.0 for c in targets}
    for c in targets:
        for other in range(len(tx.rows())):
            name = tx.rows()[other][2]
            if name not in weights and 0 < tx.class_distance(tx.class_id(c), other) <= 0.25:
                weights[name] = NEAR_MISS
    weights.update({c: CONTEXT_WEIGHT for c in context if c not in weights})
    rules = [(f"dist_to.{c} < 100", 1.4) for c in context if c in tx.ANCHORS][:3]
    habitat = context + [c for c in weights if c not in targets and c not in context]
    exclude = [] if "Water" in targets + context else ["Water"]
    return Policy("compiled", text, "R2", weights, exclude, rules, targets, habitat, absence, unmatched)
