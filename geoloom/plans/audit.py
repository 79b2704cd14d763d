"""Consistency audit over regions, its roll-up into causes, and the adjudication of labels.

Findings are rows of one table; every check is a projection of regions joined with their boundary
histogram, so all checks of all regions are one plan.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators.graph import staged

# Kind -> floor and span of its severity band.
BANDS = {
    "aspect-incoherent": (0.60, 0.35),
    "slope-violation": (0.55, 0.35),
    "contradicted-context": (0.50, 0.40),
    "isolated-lithology": (0.40, 0.40),
    "oov-candidate": (0.35, 0.40),
    "nari-morphology": (0.35, 0.35),
    "isolated-speck": (0.25, 0.45),
    "missing-expected-context": (0.20, 0.40),
}
# Thresholds of the checks.
EXPECTS_SHARE, LITHOLOGY_SHARE, ENCLOSURE = 0.05, 0.85, 0.90
NARI_M2, NARI_COMPACT = 20000.0, 0.35
SPECK_PX, SPECK_DISTANCE, OOV_M2 = (32, 128), 0.70, 400.0
SIGMAS, LEAST_SIGMA, FULL_PERIMETER_M, MIN_AREA_M2 = 2.0, 0.5, 200.0, 25.0
SYSTEMATIC_RATE, SYSTEMATIC_REGIONS = 0.15, 8


def saturate(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def grade(kind: str, value: Column, confidence: Column | None = None) -> Column:
    """Severity within the kind's band; less sure evidence reaches half the span."""
    floor, span = BANDS[kind]
    sure = saturate(confidence) if confidence is not None else F.lit(1.0)
    return F.round(floor + span * saturate(value) * (0.5 + 0.5 * sure), 3)


class Audit:
    def __init__(self, index, min_area_m2: float = MIN_AREA_M2):
        self.i, self.min_area = index, min_area_m2

    @cached_property
    def regions(self) -> DataFrame:
        """Regions with their class's attributes."""
        return self.i.regions.join(self.i.dim.select("class_id", "name", "superclass", "lithology", "morphology"), "class_id")

    @cached_property
    def hist(self) -> DataFrame:
        return self.i.neighbour_hist.join(F.broadcast(tx.dim_class(self.i.spark)).select(F.col("class_id").alias("nbr_class"), F.col("name").alias("nbr_name"), F.col("lithology").alias("nbr_lith")), "nbr_class")

    @cached_property
    def host(self) -> DataFrame:
        """(region_id, host, host_name, host_share): the class with most of the boundary, ties to the smaller id."""
        top = F.max_by(F.struct("nbr_class", "nbr_name", "share"), F.struct("shared_px", -F.col("nbr_class")))
        return self.hist.groupBy("region_id").agg(top.alias("t")).select("region_id", F.col("t.nbr_class").alias("host"), F.col("t.nbr_name").alias("host_name"), F.col("t.share").alias("host_share"))

    def _out(self, rows: DataFrame, kind: str, severity: Column, detail: Column) -> DataFrame:
        cause = F.concat_ws("/", F.lit(kind), "name", detail)
        return rows.select("region_id", "class_id", F.lit(kind).alias("kind"), severity.alias("severity"), "area_m2", cause.alias("cause"))

    def context(self) -> DataFrame:
        out = []
        for subject, others, _, _ in tx.PRIORS:
            if not others:
                continue
            share = self.hist.where(F.col("nbr_class").isin(tx.ids(others))).groupBy("region_id").agg(F.sum("share").alias("s"))
            rows = self.regions.where(F.col("class_id") == tx.class_id(subject)).join(share, "region_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).where(F.col("s") < EXPECTS_SHARE)
            sev = grade("missing-expected-context", 1 - F.col("s") / EXPECTS_SHARE, F.col("perimeter_m") / FULL_PERIMETER_M)
            out.append(self._out(rows, "missing-expected-context", sev, F.lit("+".join(others))))
        return reduce(DataFrame.unionByName, out)

    def contradicted(self, priors: list[tuple[str, list[str]]], share_most: float = 0.40) -> DataFrame:
        """The rule for priors that forbid neighbours; none is in force, callers may bring their own."""
        out = []
        for subject, others in priors:
            share = self.hist.where(F.col("nbr_class").isin(tx.ids(others))).groupBy("region_id").agg(F.sum("share").alias("s"))
            rows = self.regions.where(F.col("class_id") == tx.class_id(subject)).join(share, "region_id").where(F.col("s") > share_most)
            sev = grade("contradicted-context", (F.col("s") - share_most) / (1 - share_most), F.col("perimeter_m") / FULL_PERIMETER_M)
            out.append(self._out(rows, "contradicted-context", sev, F.lit("+".join(others))))
        return reduce(DataFrame.unionByName, out)

    def slope(self) -> DataFrame:
        out = []
        for subject, _, band, _ in tx.PRIORS:
            if band is None:
                continue
            lo, hi = band
            rows = self.regions.where((F.col("class_id") == tx.class_id(subject)) & ~F.col("mean_slope").between(lo, hi))
            excess = F.greatest(lo - F.col("mean_slope"), F.col("mean_slope") - hi)
            out.append(self._out(rows, "slope-violation", grade("slope-violation", excess / (SIGMAS * F.greatest(F.col("std_slope"), F.lit(LEAST_SIGMA)))), F.lit(None).cast("string")))
        return reduce(DataFrame.unionByName, out)

    def aspect(self) -> DataFrame:
        out = []
        for subject, _, _, cap in tx.PRIORS:
            if cap is not None:
                rows = self.regions.where((F.col("class_id") == tx.class_id(subject)) & (F.col("aspect_circvar") > cap))
                out.append(self._out(rows, "aspect-incoherent", grade("aspect-incoherent", (F.col("aspect_circvar") - cap) / (1 - cap)), F.lit(None).cast("string")))
        return reduce(DataFrame.unionByName, out)

    def lithology(self) -> DataFrame:
        """Rock islands in rock of another kind: the confusion that colour can't settle."""
        rock = self.regions.where("lithology is not null")
        mix = rock.select("region_id", "lithology").join(self.hist.where("nbr_lith is not null"), "region_id").groupBy("region_id", "lithology", "nbr_lith").agg(F.sum("share").alias("s"))
        best = mix.groupBy("region_id", "lithology").agg(F.sum(F.when(F.col("nbr_lith") != F.col("lithology"), F.col("s")).otherwise(0.0)).alias("other"), F.max_by(F.struct("nbr_lith", "s"), F.struct("s", "nbr_lith")).alias("top"))
        rows = rock.join(best.drop("lithology"), "region_id").where((F.col("other") > LITHOLOGY_SHARE) & (F.col("top.nbr_lith") != F.col("lithology")))
        return self._out(rows, "isolated-lithology", grade("isolated-lithology", (F.col("other") - LITHOLOGY_SHARE) / (1 - LITHOLOGY_SHARE), F.col("top.s")), F.concat(F.lit("in-"), "top.nbr_lith"))

    def nari(self, area_m2: float = NARI_M2, compact: float = NARI_COMPACT) -> DataFrame:
        rows = self.regions.where((F.col("lithology") == "Nari") & (F.col("area_m2") > area_m2) & (F.col("compactness") > compact))
        big, blocky = saturate((F.col("area_m2") / area_m2 - 1) / 4), saturate((F.col("compactness") - compact) / (1 - compact))
        return self._out(rows, "nari-morphology", grade("nari-morphology", F.sqrt(F.greatest(big, F.lit(1e-6)) * F.greatest(blocky, F.lit(1e-6)))), F.lit(None).cast("string"))

    @cached_property
    def enclosed(self) -> DataFrame:
        return self.regions.join(self.host, "region_id").where(F.col("host_share") >= ENCLOSURE)

    def speck(self, px: tuple[int, int] = SPECK_PX) -> DataFrame:
        """Islands too small to have a texture, in a class far from theirs; counted in cells, whatever their metres."""
        lo, hi = px
        pairs = self.i.pairs.select(F.col("a").alias("class_id"), F.col("b").alias("host"), "distance")
        rows = self.enclosed.where(F.col("area_px").between(lo, hi) & (F.col("superclass") != "artifact")).join(pairs, ["class_id", "host"]).where(F.col("distance") >= SPECK_DISTANCE)
        value = ((F.col("distance") - SPECK_DISTANCE) / (1 - SPECK_DISTANCE) + (F.col("host_share") - ENCLOSURE) / (1 - ENCLOSURE) + (hi - F.col("area_px")) / (hi - lo)) / 3
        return self._out(rows, "isolated-speck", grade("isolated-speck", value, F.col("host_share")), F.concat(F.lit("in-"), "host_name"))

    def oov(self) -> DataFrame:
        rows = self.enclosed.where((F.col("superclass") == "artifact") & (F.col("area_m2") <= OOV_M2))
        value = 0.5 * (F.col("host_share") - ENCLOSURE) / (1 - ENCLOSURE) + 0.5 * saturate((OOV_M2 - F.col("area_m2")) / max(OOV_M2 - self.min_area, 1.0))
        return self._out(rows, "oov-candidate", grade("oov-candidate", value, F.col("host_share")), F.concat(F.lit("in-"), "host_name"))

    @cached_property
    def findings(self) -> DataFrame:
        """All checks; those about shape and context only above the area cut, specks at any size."""
        gated = reduce(DataFrame.unionByName, [self.context(), self.slope(), self.aspect(), self.lithology(), self.nari(), self.oov()]).where(F.col("area_m2") >= self.min_area)
        return staged(gated.unionByName(self.speck()))

    @cached_property
    def causes(self) -> DataFrame:
        """Findings rolled up: regions once a cause, severity weighted by area, value = severity * area ** 0.5."""
        each = self.findings.groupBy("cause", "kind", "class_id", "region_id").agg(F.max("severity").alias("severity"), F.max("area_m2").alias("area_m2"), F.count("*").alias("n"))
        w = F.greatest(F.col("area_m2"), F.lit(1.0))
        out = each.groupBy("cause", "kind", "class_id").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_regions"), F.sum("area_m2").alias("area_m2"), (F.sum(F.col("severity") * w) / F.sum(w)).alias("severity"), F.max("severity").alias("worst"))
        return out.withColumn("value", F.col("severity") * F.sqrt(F.greatest("area_m2", F.lit(1.0))))

    def worklist(self, budget: int) -> DataFrame:
        """Causes by review value up to the budget, each with how many the cut leaves out."""
        w = Window.orderBy(F.desc(F.round("value", 6)), "cause")
        ranked = self.causes.withColumn("rank", F.row_number().over(w)).withColumn("dropped", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy()) - budget))
        return ranked.where(F.col("rank") <= budget)

    def by_class(self) -> DataFrame:
        flagged = self.findings.groupBy("class_id").agg(F.count_distinct("region_id").alias("flagged"), F.avg("severity").alias("severity"))
        n = self.i.region_ids.groupBy("class_id").agg(F.count("*").alias("n_regions"))
        return n.join(flagged, "class_id", "left").select("class_id", "n_regions", F.coalesce("flagged", F.lit(0)).cast("long").alias("flagged"), "severity", (F.coalesce("flagged", F.lit(0)) / F.col("n_regions")).alias("rate"))

    def systematic(self) -> DataFrame:
        return self.by_class().where((F.col("n_regions") >= SYSTEMATIC_REGIONS) & (F.col("rate") >= SYSTEMATIC_RATE))

    def checked_classes(self) -> list[int]:
        """Classes that some check can speak about at all."""
        named = [s for s, *_ in tx.PRIORS]
        return sorted({tx.class_id(n) for n in named} | {r[0] for r in tx.rows() if r[4] or r[3] == "artifact"})

    def coverage(self) -> DataFrame:
        """For each class on the map whether a check examines it, and its share of the area."""
        hist = self.i.valid.groupBy("class_id").agg(F.count("*").alias("px"))
        total = hist.agg(F.sum("px").alias("n"))
        return hist.join(F.broadcast(total)).select("class_id", "px", (F.col("px") / F.col("n")).alias("share"), F.col("class_id").isin(self.checked_classes()).alias("examined"))


# ---- adjudication --------------------------------------------------------------------------------

# Weights of context, morphology and geometry; farthest candidate; switch and twin margins.
WEIGHTS = (0.45, 0.35, 0.20)
FARTHEST, SWITCH, TWINS = 0.5, 0.15, 0.08


def candidates(a: Audit, noted: DataFrame | None = None) -> DataFrame:
    """(region_id, cand): the label, classes near it in meaning, and the three main neighbours.

    noted (class_id, cand) are confusions that analysts have seen, which a distance can't know.
    """
    near = a.i.region_ids.join(a.i.pairs.where(F.col("distance") <= FARTHEST).select(F.col("a").alias("class_id"), F.col("b").alias("cand")), "class_id").select("region_id", "cand")
    k = F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("shared_px"), "nbr_class"))
    nbrs = a.i.neighbour_hist.withColumn("k", k).where("k <= 3").select("region_id", F.col("nbr_class").alias("cand"))
    if noted is not None:
        near = near.unionByName(a.i.region_ids.join(noted.select("class_id", "cand"), "class_id").select("region_id", "cand"))
    return near.unionByName(nbrs).distinct()


def scores(a: Audit, noted: DataFrame | None = None) -> DataFrame:
    """(region_id, class_id, cand, context, morph, geometry, total) of every candidate."""
    cand = candidates(a, noted)
    dim = F.broadcast(tx.dim_class(a.i.spark)).select(F.col("class_id").alias("cand"), F.col("name").alias("cand_name"), F.col("lithology").alias("cand_lith"), F.col("morphology").alias("cand_morph"))
    rows = cand.join(dim, "cand").join(a.i.regions.select("region_id", "class_id", "area_m2", "elongation", "mean_slope", "aspect_circvar"), "region_id")
    priors = [(s, o) for s, o, _, _ in tx.PRIORS if o]
    marks = a.hist.groupBy("region_id").agg(*(F.sum(F.when(F.col("nbr_class").isin(tx.ids(o)), F.col("share")).otherwise(0.0)).alias(f"p{k}") for k, (_, o) in enumerate(priors)), *(F.sum(F.when(F.col("nbr_lith") == lith, F.col("share")).otherwise(0.0)).alias(f"l_{lith}") for lith in LITHOLOGIES))
    rows = rows.join(marks, "region_id", "left").fillna(0.0, [f"p{k}" for k in range(len(priors))] + [f"l_{x}" for x in LITHOLOGIES])
    pick = lambda pairs, default: reduce(lambda c, p: c.when(p[0], p[1]), pairs, F.when(F.lit(False), 0.0)).otherwise(default)
    expected = pick([(F.col("cand_name") == s, 0.5 * F.col(f"p{k}")) for k, (s, _) in enumerate(priors)], 0.0)
    same = pick([(F.col("cand_lith") == x, F.col(f"l_{x}")) for x in LITHOLOGIES], 0.0)
    context = saturate(0.5 + expected + F.when(F.col("cand_lith").isNotNull(), 0.3 * same - 0.15 * (1 - same)).otherwise(0.0))

    def band(lo: float, hi: float) -> Column:
        fit = 0.5 + 0.4 * (1 - (hi - lo) / 90.0)
        miss = F.least(F.abs(F.col("mean_slope") - lo), F.abs(F.col("mean_slope") - hi))
        return F.when(F.col("mean_slope").between(lo, hi), fit).otherwise(F.greatest(F.lit(0.0), fit - miss / 15.0))

    open_band = band(0.0, 90.0)
    morph = pick([(F.col("cand_morph") == m, band(*b)) for m, b in tx.MORPHOLOGY_SLOPES.items()], open_band)
    morph = F.when(F.col("cand_morph").isNull(), 0.5).otherwise(F.when(F.col("cand_morph").isin(tx.COHERENT) & (F.col("aspect_circvar") > 0.3), morph * 0.3).otherwise(morph))
    area = pick([(F.col("cand_name") == n, F.when(F.col("area_m2").between(*b), 1.0).otherwise(0.05)) for n, b in tx.AREA_BANDS.items()], 0.5)
    geometry = F.when(F.col("cand_name").isin(tx.LINEAR), F.when(F.col("elongation") >= 2.0, F.greatest(area, F.lit(0.9))).otherwise(F.least(area, F.lit(0.2)))).otherwise(area)
    out = rows.select("region_id", "class_id", "cand", "cand_lith", "cand_morph", context.alias("context"), morph.alias("morph"), geometry.alias("geometry"))
    return out.withColumn("total", WEIGHTS[0] * F.col("context") + WEIGHTS[1] * F.col("morph") + WEIGHTS[2] * F.col("geometry"))


LITHOLOGIES = ["Marl", "Limestone", "Dolomite", "Nari", "Basalt", "Chalk"]


def verdicts(a: Audit) -> DataFrame:
    """UNDECIDABLE where another rock with the leader's morphology is as good, else SWITCH by a margin, else KEEP."""
    s = scores(a).withColumn("t", F.round("total", 9))
    own = F.col("cand") == F.col("class_id")
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("t"), F.desc(own.cast("int")), "cand")))
    lead = ranked.where("rank = 1").select("region_id", F.col("cand").alias("lead"), F.col("t").alias("lead_t"), F.col("cand_lith").alias("ll"), F.col("cand_morph").alias("lm"))
    twin = (F.col("cand_lith").isNotNull() & F.col("ll").isNotNull() & (F.col("cand_lith") != F.col("ll")) & (F.col("cand_morph") == F.col("lm")) & (F.col("lead_t") - F.col("t") <= TWINS)).cast("int")
    met = ranked.join(lead, "region_id").groupBy("region_id", "class_id", "lead", "lead_t").agg(F.max(twin).alias("twins"), F.max(F.when(own, F.col("t"))).alias("own_t"))
    margin = F.round(F.col("lead_t") - F.col("own_t"), 6)
    name = F.when(F.col("twins") == 1, "UNDECIDABLE").when((F.col("lead") != F.col("class_id")) & (margin >= SWITCH), "SWITCH").otherwise("KEEP")
    return met.select("region_id", "class_id", "lead", margin.alias("margin"), name.alias("verdict"))
