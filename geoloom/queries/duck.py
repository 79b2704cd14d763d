"""Pieces of reference SQL: WITH clauses that build the same index tables in DuckDB."""

from __future__ import annotations

from ..functions.taxonomy import duck_dim, duck_pairs
from ..plans.index import CHIP, MIN_AREA_PX
from ..sources.cells import DUCK_CELLS, DUCK_WAYS

PIECES = {
    "cells": DUCK_CELLS,
    "dim": f"\ndim as {duck_dim()}",
    "pairs": f"\npairs as {duck_pairs()}",
    "ways": DUCK_WAYS,
    "nb": """
nb as (select x.r, x.c, x.class_id a, y.class_id b from cells x join cells y on y.r = x.r and y.c = x.c + 1 where x.valid and y.valid
  union all select x.r, x.c, x.class_id a, y.class_id b from cells x join cells y on y.c = x.c and y.r = x.r + 1 where x.valid and y.valid)""",
    "slope": """
grad as (select *, case when lag(elev) over cc is not null and lead(elev) over cc is not null then (lead(elev) over cc - lag(elev) over cc) / 1.0 when lead(elev) over cc is not null then (lead(elev) over cc - elev) / 0.5 when lag(elev) over cc is not null then (elev - lag(elev) over cc) / 0.5 else 0.0 end gy,
  case when lag(elev) over rr is not null and lead(elev) over rr is not null then (lead(elev) over rr - lag(elev) over rr) / 1.0 when lead(elev) over rr is not null then (lead(elev) over rr - elev) / 0.5 when lag(elev) over rr is not null then (elev - lag(elev) over rr) / 0.5 else 0.0 end gx
  from cells window cc as (partition by c order by r), rr as (partition by r order by c)),
sl as (select *, degrees(atan(sqrt(gx * gx + gy * gy))) slope from grad)""",
    "comp": """
lab as (select r * 1000 + c u, r, c, class_id k from cells where valid),
link as (select a.u, b.u v from lab a join (select unnest([-1, 0, 1]) dr) x on true join (select unnest([-1, 0, 1]) dc) y on true join lab b on b.r = a.r + dr and b.c = a.c + dc and a.k = b.k),
reach as (select u, v from link union select reach.u, link.v from reach join link on reach.v = link.u),
comp as (select u, min(v) root from reach group by u),
lroot as (select lab.*, root from lab join comp using (u))""",
    "regions": f"""
rid as (select root, k::int class_id, count(*) area_px, row_number() over (order by k, root) region_id from lroot group by root, k having count(*) >= {MIN_AREA_PX}),
creg as (select lroot.r, lroot.c, region_id, class_id from lroot join rid using (root)),
gl as (select cells.r, cells.c, coalesce(root, -1) g from cells left join lroot on lroot.r = cells.r and lroot.c = cells.c),
pe as (select g a, coalesce(lead(g) over (partition by r order by c), -1) b from gl union all select g, coalesce(lead(g) over (partition by c order by r), -1) from gl),
per as (select root, count(*) perim_px from (select a root from pe where a <> b union all select b from pe where a <> b) where root >= 0 group by root),
zon as (select region_id, min(creg.r) r0, min(creg.c) c0, max(creg.r) + 1 r1, max(creg.c) + 1 c1, avg(creg.r) cy, avg(creg.c) cx, avg(slope) mean_slope,
  sqrt(greatest(0, avg(slope * slope) - avg(slope) * avg(slope))) std_slope, avg(elev) mean_elev, 1 - sqrt(avg(cos(atan2(gy, -gx))) ** 2 + avg(sin(atan2(gy, -gx))) ** 2) aspect_circvar
  from creg join sl on sl.r = creg.r and sl.c = creg.c group by region_id),
regions as (select rid.*, perim_px, r0, c0, r1, c1, cy, cx, mean_slope, std_slope, mean_elev, aspect_circvar, area_px * 0.25 area_m2, perim_px * 0.5 perimeter_m,
  case when perim_px > 0 then 4 * pi() * area_px * 0.25 / (perim_px * 0.5) ** 2 else 0 end compactness,
  greatest(r1 - r0, c1 - c0)::double / greatest(1, least(r1 - r0, c1 - c0)) elongation
  from rid join per using (root) join zon using (region_id))""",
    "edges": """
rp as (select x.region_id a, y.region_id b from creg x join creg y on y.r = x.r and y.c = x.c + 1 union all select x.region_id, y.region_id from creg x join creg y on y.c = x.c and y.r = x.r + 1),
edges as (select least(a, b) a, greatest(a, b) b, count(*) shared_px from rp where a <> b group by 1, 2)""",
    "nh": """
nh as (select x.region_id, x.class_id, y.class_id nbr_class, sum(shared_px)::bigint shared_px, sum(shared_px)::double / sum(sum(shared_px)) over (partition by x.region_id) share
  from (select a, b, shared_px from edges union all select b, a, shared_px from edges) e join rid x on x.region_id = e.a join rid y on y.region_id = e.b group by 1, 2, 3)""",
    "chips": f"""
ext as (select max(r) mr, max(c) mc from cells),
chip_class as (select r // {CHIP} chip_r, c // {CHIP} chip_c, class_id, count(*) px from cells, ext where valid and r < (mr + 1) // {CHIP} * {CHIP} and c < (mc + 1) // {CHIP} * {CHIP} group by 1, 2, 3),
chip_frac as (select *, sum(px) over (partition by chip_r, chip_c)::bigint n_px, px::double / sum(px) over (partition by chip_r, chip_c) frac from chip_class),
chips as (select chip_r, chip_c, n_px, -sum(frac * log2(frac)) entropy, count(*) n_classes from chip_frac group by 1, 2, 3)""",
    "blocks": """
free as (select r * 1000 + c u, r, c from cells where valid and not exists (select 1 from way_cells w where w.r = cells.r and w.c = cells.c)),
flink as (select a.u, b.u v from free a join (select unnest([-1, 0, 1]) dr) x on true join (select unnest([-1, 0, 1]) dc) y on true join free b on b.r = a.r + dr and b.c = a.c + dc),
freach as (select u, v from flink union select freach.u, flink.v from freach join flink on freach.v = flink.u),
broot as (select u, min(v) root from freach group by u),
blk as (select free.r, free.c, root from free join broot using (u))""",
}
NEEDS = {"nb": ["cells"], "slope": ["cells"], "comp": ["cells"], "regions": ["slope", "comp"], "edges": ["regions"], "nh": ["edges"], "chips": ["cells"], "ways": ["cells"], "blocks": ["ways"]}


def sql(pieces: str, body: str) -> str:
    """WITH RECURSIVE of the named pieces and what they need, then body."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if PIECES[name] not in out:
            out.append(PIECES[name])

    for p in pieces.split():
        add(p)
    return ("with recursive " + ",".join(out) + " " if out else "") + body
