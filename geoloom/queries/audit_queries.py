"""Audit findings, their roll-ups, and adjudication verdicts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..plans import audit as au
from ..plans.index import index
from .composition import R6
from .duck import sql


@cache
def _audit(i) -> au.Audit:
    return au.Audit(i, 1.0)


def audit(spark, d) -> au.Audit:
    """The audit at a 1 m2 cut: the derived grid's regions are a few square metres each."""
    return _audit(index(spark, d))


def grade_sql(kind: str, value: str, conf: str = "1") -> str:
    floor, span = au.BANDS[kind]
    clip = lambda x: f"greatest(0, least(1, {x}))"
    return f"round({floor} + {span} * {clip(value)} * (0.5 + 0.5 * {clip(conf)}), 3)"


REG = "(select regions.*, name, superclass, lithology, morphology from regions join dim using (class_id))"
HOST = "(select region_id, arg_max(nbr_class, shared_px * 100 - nbr_class) host, max(share) host_share from nh group by 1)"
PARTS = {
    "missing-expected-context": " union all ".join(
        f"select x.region_id, x.class_id, 'missing-expected-context' kind, {grade_sql('missing-expected-context', '1 - coalesce(s, 0) / 0.05', 'perimeter_m / 200.0')} severity, area_m2, 'missing-expected-context/{s}/{'+'.join(o)}' cause from {REG} x left join (select region_id, sum(share) s from nh where nbr_class in ({', '.join(map(str, tx.ids(o)))}) group by 1) q using (region_id) where name = '{s}' and coalesce(s, 0) < 0.05"
        for s, o, _, _ in tx.PRIORS
        if o
    ),
    "slope-violation": " union all ".join(
        f"select region_id, class_id, 'slope-violation' kind, {grade_sql('slope-violation', f'greatest({b[0]} - mean_slope, mean_slope - {b[1]}) / (2 * greatest(std_slope, 0.5))')} severity, area_m2, 'slope-violation/{s}' cause from {REG} x where name = '{s}' and not mean_slope between {b[0]} and {b[1]}"
        for s, _, b, _ in tx.PRIORS
        if b
    ),
    "aspect-incoherent": " union all ".join(
        f"select region_id, class_id, 'aspect-incoherent' kind, {grade_sql('aspect-incoherent', f'(aspect_circvar - {c}) / (1 - {c})')} severity, area_m2, 'aspect-incoherent/{s}' cause from {REG} x where name = '{s}' and aspect_circvar > {c}"
        for s, _, _, c in tx.PRIORS
        if c
    ),
    "isolated-lithology": f"""select x.region_id, x.class_id, 'isolated-lithology' kind, {grade_sql('isolated-lithology', '(other - 0.85) / 0.15', 'top_s')} severity, area_m2, 'isolated-lithology/' || name || '/in-' || top cause from {REG} x join
      (select region_id, lithology own, sum(s) filter (nl <> lithology) other, max_by(nl, {{'s': s, 'n': nl}}) top, max(s) top_s from (select z.region_id, w.lithology, n.lithology nl, sum(share) s from nh z join {REG} w using (region_id) join dim n on n.class_id = z.nbr_class where n.lithology is not null and w.lithology is not null group by 1, 2, 3) group by 1, 2) q using (region_id) where other > 0.85 and top <> lithology""",
    "nari-morphology": f"select region_id, class_id, 'nari-morphology' kind, {grade_sql('nari-morphology', 'sqrt(greatest(greatest(0, least(1, (area_m2 / 20000.0 - 1) / 4)), 1e-6) * greatest(greatest(0, least(1, (compactness - 0.35) / 0.65)), 1e-6))')} severity, area_m2, 'nari-morphology/' || name cause from {REG} x where lithology = 'Nari' and area_m2 > 20000 and compactness > 0.35",
    "oov-candidate": f"select region_id, x.class_id, 'oov-candidate' kind, {grade_sql('oov-candidate', '0.5 * (host_share - 0.9) / 0.1 + 0.5 * greatest(0, least(1, (400 - area_m2) / 399.0))', 'host_share')} severity, area_m2, 'oov-candidate/' || x.name || '/in-' || n.name cause from {REG} x join {HOST} h using (region_id) join dim n on n.class_id = host where x.superclass = 'artifact' and area_m2 <= 400 and host_share >= 0.9",
}
SPECK = "select region_id, x.class_id, 'isolated-speck' kind, {sev} severity, area_m2, 'isolated-speck/' || x.name || '/in-' || n.name cause from {reg} x join {host} h using (region_id) join dim n on n.class_id = host join pairs p on p.a = x.class_id and p.b = host where x.superclass <> 'artifact' and area_px between {lo} and {hi} and host_share >= 0.9 and distance >= 0.7"


def speck_sql(lo: int, hi: int) -> str:
    return SPECK.format(sev=grade_sql("isolated-speck", f"((distance - 0.7) / (1 - 0.7) + (host_share - 0.9) / (1 - 0.9) + ({hi} - area_px) / {float(hi - lo)}) / 3", "host_share"), reg=REG, host=HOST, lo=lo, hi=hi)


def part(kind: str) -> str:
    return sql("nh dim pairs", f"select region_id, class_id, kind, severity::double severity, area_m2::double area_m2, cause from ({PARTS[kind]}) f where area_m2 >= 1")


ALL = "(" + " union all ".join(f"select * from ({p}) z{k} where area_m2 >= 1" for k, p in enumerate(PARTS.values())) + f" union all {speck_sql(32, 128)})"
COLS = ["region_id", "class_id", "kind", "severity", "area_m2", "cause"]


def _check(name: str, kind: str, method: str) -> None:
    @query(name, part(kind))
    def run(spark, d):
        return getattr(audit(spark, d), method)().where("area_m2 >= 1").select(*COLS)


for _n, _k, _m in (("audit_missing_context", "missing-expected-context", "context"), ("audit_slope", "slope-violation", "slope"), ("audit_aspect", "aspect-incoherent", "aspect"), ("audit_lithology", "isolated-lithology", "lithology"), ("audit_nari", "nari-morphology", "nari"), ("audit_oov", "oov-candidate", "oov")):
    _check(_n, _k, _m)


@query("audit_speck", sql("nh dim pairs", f"select region_id, class_id, kind, severity::double severity, area_m2::double area_m2, cause from ({speck_sql(12, 20)}) f"))
def audit_speck(spark, d):
    """Specks in a window of 12 to 20 cells, which the derived grid has."""
    return audit(spark, d).speck((12, 20)).select(*COLS)


@query("audit_contradicted", sql("nh dim", f"select region_id, class_id, 'contradicted-context' kind, {grade_sql('contradicted-context', '(s - 0.4) / (1 - 0.4)', 'perimeter_m / 200.0')}::double severity, area_m2::double area_m2, 'contradicted-context/House/Batha+Water' cause from {REG} x join (select region_id, sum(share) s from nh where nbr_class in (23, 11) group by 1) q using (region_id) where name = 'House' and s > 0.4"))
def audit_contradicted(spark, d):
    """The rule for forbidden neighbours, with a prior of the caller's: houses in heath or water."""
    return audit(spark, d).contradicted([("House", ["Batha", "Water"])]).select(*COLS)


@query("findings_all", sql("nh dim pairs", f"select region_id, class_id, kind, severity::double severity, area_m2::double area_m2, cause from {ALL} f"))
def findings_all(spark, d):
    return audit(spark, d).findings.select(*COLS)


CAUSE = f"""(select cause, kind, class_id, sum(n)::bigint n_findings, count(*) n_regions, sum(area_m2)::double area_m2, sum(severity * greatest(area_m2, 1)) / sum(greatest(area_m2, 1)) severity, max(severity) worst,
  sum(severity * greatest(area_m2, 1)) / sum(greatest(area_m2, 1)) * sqrt(greatest(sum(area_m2), 1)) val
  from (select cause, kind, class_id, region_id, max(severity)::double severity, max(area_m2)::double area_m2, count(*) n from {ALL} f group by 1, 2, 3, 4) e group by 1, 2, 3)"""


@query("cause_rollup", sql("nh dim pairs", f"select cause, n_findings, n_regions, area_m2, round(severity, 5) severity, worst::double worst, round(val, 4) review_value from {CAUSE} c"))
def cause_rollup(spark, d):
    return audit(spark, d).causes.select("cause", "n_findings", "n_regions", "area_m2", F.round("severity", 5).alias("severity"), "worst", F.round("value", 4).alias("review_value"))


@query("worklist", sql("nh dim pairs", f"select rank, cause, dropped from (select row_number() over (order by round(val, 6) desc, cause) rank, cause, greatest(0, count(*) over () - 10) dropped from {CAUSE} c) where rank <= 10"))
def worklist(spark, d):
    return audit(spark, d).worklist(10).select(F.col("rank").cast("long").alias("rank"), "cause", F.col("dropped").cast("long").alias("dropped"))


@query("cause_detail", sql("nh dim pairs", f"select cause, array_to_string(list_slice(list_sort(list(distinct region_id)), 1, 5), ',') example_ids from {ALL} f group by 1"))
def cause_detail(spark, d):
    """Five example regions a cause."""
    from pyspark.sql import Window

    each = audit(spark, d).findings.select("cause", "region_id").distinct()
    k = F.row_number().over(Window.partitionBy("cause").orderBy("region_id"))
    return each.withColumn("k", k).where("k <= 5").groupBy("cause").agg(F.array_join(F.array_sort(F.collect_list("region_id")), ",").alias("example_ids"))


@query("by_kind", sql("nh dim pairs", f"select kind, count(*) n, count(distinct cause) n_causes, round(avg(severity), 5) severity from {ALL} f group by 1"))
def by_kind(spark, d):
    return audit(spark, d).findings.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("cause").alias("n_causes"), F.round(F.avg("severity"), 5).alias("severity"))


BY_CLASS = f"(select class_id, n_regions, coalesce(flagged, 0) flagged, coalesce(flagged, 0)::double / n_regions rate from (select class_id, count(*) n_regions from rid group by 1) a left join (select class_id, count(distinct region_id) flagged from {ALL} f group by 1) b using (class_id))"


@query("by_class", sql("nh dim pairs", f"select class_id, n_regions, flagged, round(rate, 6) rate from {BY_CLASS} q"))
def by_class(spark, d):
    return audit(spark, d).by_class().select("class_id", "n_regions", "flagged", R6("rate").alias("rate"))


@query("systematic", sql("nh dim pairs", f"select class_id, n_regions, round(rate, 6) rate from {BY_CLASS} q where n_regions >= 8 and rate >= 0.15"))
def systematic(spark, d):
    return audit(spark, d).systematic().select("class_id", "n_regions", R6("rate").alias("rate"))


CHECKED = ", ".join(str(k) for k in au.Audit.checked_classes(None))


@query("coverage", sql("cells", f"select class_id, count(*) px, round(count(*)::double / sum(count(*)) over (), 6) share, class_id in ({CHECKED}) examined from cells where valid group by 1"))
def coverage(spark, d):
    return audit(spark, d).coverage().select("class_id", "px", R6("share").alias("share"), "examined")


@query("unexamined_classes", sql("cells", f"select distinct class_id from cells where valid and class_id not in ({CHECKED})"))
def unexamined_classes(spark, d):
    return audit(spark, d).coverage().where("not examined").select("class_id")


@query("audit_summary", sql("nh dim pairs", f"select count(*) n_findings, count(distinct cause) n_causes, count(distinct region_id) n_regions from {ALL} f"))
def audit_summary(spark, d):
    return audit(spark, d).findings.agg(F.count("*").alias("n_findings"), F.count_distinct("cause").alias("n_causes"), F.count_distinct("region_id").alias("n_regions"))


@query("sort_severity", sql("nh dim pairs", f"select region_id, cause, severity::double severity from {ALL} f order by severity desc, area_m2 desc, region_id, cause"))
def sort_severity(spark, d):
    return audit(spark, d).findings.orderBy(F.desc("severity"), F.desc("area_m2"), "region_id", "cause").select("region_id", "cause", "severity")


# ---- adjudication --------------------------------------------------------------------------------

CAND = "(select rid.region_id, p.b cand from rid join pairs p on p.a = rid.class_id where p.distance <= 0.5 union select region_id, nbr_class from (select region_id, nbr_class, row_number() over (partition by region_id order by shared_px desc, nbr_class) k from nh) where k <= 3)"
_PRI = [(s, o) for s, o, _, _ in tx.PRIORS if o]
CONTEXT = (
    "greatest(0, least(1, 0.5 + case "
    + " ".join(f"when n.name = '{s}' then 0.5 * coalesce((select sum(share) from nh where nh.region_id = c.region_id and nbr_class in ({', '.join(map(str, tx.ids(o)))})), 0)" for s, o in _PRI)
    + " else 0 end + case when n.lithology is not null then 0.45 * coalesce((select sum(share) from nh join dim m on m.class_id = nh.nbr_class where nh.region_id = c.region_id and m.lithology = n.lithology), 0) - 0.15 else 0 end))"
)


def _band(lo: float, hi: float) -> str:
    fit = 0.5 + 0.4 * (1 - (hi - lo) / 90.0)
    return f"case when mean_slope between {lo} and {hi} then {fit!r} else greatest(0, {fit!r} - least(abs(mean_slope - {lo}), abs(mean_slope - {hi})) / 15.0) end"


_MORPH = "case " + " ".join(f"when n.morphology = '{m}' then {_band(*b)}" for m, b in tx.MORPHOLOGY_SLOPES.items()) + f" else {_band(0.0, 90.0)} end"
MORPH = f"case when n.morphology is null then 0.5 when n.morphology in ({', '.join(repr(m) for m in tx.COHERENT)}) and aspect_circvar > 0.3 then 0.3 * ({_MORPH}) else {_MORPH} end"
_AREA = "case " + " ".join(f"when n.name = '{k}' then case when area_m2 between {b[0]} and {b[1]} then 1.0 else 0.05 end" for k, b in tx.AREA_BANDS.items()) + " else 0.5 end"
GEOM = f"case when n.name in ({', '.join(repr(m) for m in tx.LINEAR)}) then case when elongation >= 2 then greatest({_AREA}, 0.9) else least({_AREA}, 0.2) end else {_AREA} end"
SCORES = f"(select c.region_id, r.class_id, c.cand, n.lithology cl, n.morphology cm, ({CONTEXT})::double context, ({MORPH})::double morph, ({GEOM})::double geometry from {CAND} c join regions r using (region_id) join dim n on n.class_id = c.cand)"


@query("s2_candidates", sql("nh pairs", f"select region_id, cand from {CAND} c"))
def s2_candidates(spark, d):
    return au.candidates(audit(spark, d)).select("region_id", "cand")


for _term in ("context", "morph", "geometry"):

    @query(f"s2_{'morphology' if _term == 'morph' else _term}", sql("nh pairs dim", f"select region_id, cand, round({_term}, 5) {_term} from {SCORES} s"))
    def s2_term(spark, d, term=_term):
        return au.scores(audit(spark, d)).select("region_id", "cand", F.round(term, 5).alias(term))


@query("s2_rank", sql("nh pairs dim", f"select region_id, cand lead, round(t, 5) total from (select *, row_number() over (partition by region_id order by t desc, (cand = class_id)::int desc, cand) k from (select *, round(0.45 * context + 0.35 * morph + 0.20 * geometry, 9) t from {SCORES} s)) where k = 1"))
def s2_rank(spark, d):
    from pyspark.sql import Window

    s = au.scores(audit(spark, d)).withColumn("t", F.round("total", 9))
    k = F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("t"), F.desc((F.col("cand") == F.col("class_id")).cast("int")), "cand"))
    return s.withColumn("k", k).where("k = 1").select("region_id", F.col("cand").alias("lead"), F.round("t", 5).alias("total"))


VERDICT = f"""(select region_id, class_id, lead, case when max(twin) = 1 then 'UNDECIDABLE' when lead <> class_id and round(lead_t - max(own), 6) >= 0.15 then 'SWITCH' else 'KEEP' end verdict from
 (select s.region_id, s.class_id, lead, lead_t, case when s.cl is not null and ll is not null and s.cl <> ll and s.cm = lm and lead_t - t <= 0.08 then 1 else 0 end twin, case when s.cand = s.class_id then t end own from
  (select *, round(0.45 * context + 0.35 * morph + 0.20 * geometry, 9) t from sc) s join
  (select region_id, cand lead, t lead_t, cl ll, cm lm from (select *, row_number() over (partition by region_id order by t desc, (cand = class_id)::int desc, cand) k from (select *, round(0.45 * context + 0.35 * morph + 0.20 * geometry, 9) t from sc)) where k = 1) l using (region_id)) group by 1, 2, 3, lead_t)"""


def _with_scores(body: str) -> str:
    return sql("nh pairs dim", "").rstrip() + f", sc as {SCORES} " + body


@query("s2_verdict", _with_scores(f"select region_id, class_id, lead, verdict from {VERDICT} v"))
def s2_verdict(spark, d):
    return au.verdicts(audit(spark, d)).select("region_id", "class_id", "lead", "verdict")


@query("s2_ledger", _with_scores(f"select verdict, count(*) n, round(count(*)::double / sum(count(*)) over (), 6) share from {VERDICT} v group by 1"))
def s2_ledger(spark, d):
    v = au.verdicts(audit(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))
    return v.join(F.broadcast(v.agg(F.sum("n").alias("t")))).select("verdict", "n", R6(F.col("n") / F.col("t")).alias("share"))
