"""Queries return all there is, told from the index tables and plain NumPy rather than from the reference SQL."""

import os

import duckdb
import numpy as np
import pytest

from geoloom import catalog
from geoloom.operators import grid
from geoloom.plans import reference_map
from geoloom.plans.index import index
from geoloom.queries import audit_queries


def test_georeference_places_every_cell(spark, sf):
    cells = {(r, c) for r, c in index(spark, sf).cells.select("r", "c").collect()}
    h, w = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
    got = {(x.r, x.c): (x.lon, x.lat) for x in catalog.QUERIES["georeference"](spark, sf).collect()}
    assert got.keys() == cells
    for (r, c), (lon, lat) in got.items():
        assert abs(lon - (35.0 + (c + 0.5) * 0.2 / w)) < 2e-9 and abs(lat - (31.1 - (r + 0.5) * 0.1 / h)) < 2e-9


def test_mosaic_has_every_valid_cell(spark, sf):
    want = sorted(tuple(x) for x in index(spark, sf).cells.where("valid").select("r", "c", "class_id").collect())
    assert sorted(tuple(x) for x in catalog.QUERIES["mosaic_seam"](spark, sf).select("r", "c", "class_id").collect()) == want


def best_window(a, size, step):
    """(r, c, total) of the first best window, by looking at all of them."""
    at = [(r, c) for r in range(0, a.shape[0] - size + 1, step) for c in range(0, a.shape[1] - size + 1, step)]
    r, c = max(at, key=lambda x: (int(a[x[0] : x[0] + size, x[1] : x[1] + size].sum()), -x[0], -x[1]))
    return r, c, int(a[r : r + size, c : c + size].sum())


@pytest.mark.parametrize("step", [1, 2, 3, 8])
def test_densest_window_of_any_step(spark, step):
    a = (np.random.default_rng(step).random((23, 30)) < 0.1).astype(int)
    a[6:10, 14:18] = 1  # a cluster across the corner of four aligned tiles
    cells = spark.createDataFrame([(r, c, int(a[r, c])) for r, c in np.ndindex(a.shape)], "r long, c long, v int")
    assert [tuple(x) for x in grid.densest_window(cells, "v", 8, step).collect()] == [best_window(a, 8, step)]


def test_densest_window_looks_everywhere(spark, sf):
    rows = index(spark, sf).cells.selectExpr("r", "c", "cast(class_id = 4 as int) v").collect()
    a = np.zeros((max(x.r for x in rows) + 1, max(x.c for x in rows) + 1), int)
    for x in rows:
        a[x.r, x.c] = x.v
    assert [tuple(x) for x in catalog.QUERIES["densest_window"](spark, sf).collect()] == [best_window(a, 8, 1)]


def test_shifts_reach_six_metres(spark, sf):
    i = index(spark, sf)
    ways = {tuple(x) for x in i.road_cells.select("r", "c").collect()}
    roads = {tuple(x) for x in i.valid.where("class_id in (8, 9, 10)").select("r", "c").collect()}
    steps = range(-12, 13)  # 6 m of 0.5 m cells
    want = {(a, b): n for a in steps for b in steps if (n := sum((r + a, c + b) in roads for r, c in ways))}
    assert {(x.dr, x.dc): x.px for x in catalog.QUERIES["align_shift"](spark, sf).collect()} == want


@pytest.mark.parametrize("shift, verdict", [((0, 0), "OK"), ((-1, 2), "OK"), ((6, 0), "DOUBTFUL"), ((-9, 9), "MISREGISTERED")])
def test_a_shifted_map_is_told(spark, shift, verdict):
    at = {tuple(x) for x in np.random.default_rng(3).integers(-40, 40, (200, 2)).tolist()}
    cells = lambda dr, dc: spark.createDataFrame([(r + dr, c + dc) for r, c in at], "r long, c long")
    counts = reference_map.shift_counts(cells(0, 0), cells(*shift), 0.5, tile=16).collect()
    assert max(counts, key=lambda x: x.px)[:] == (*shift, len(at))
    assert len({(x.dr, x.dc) for x in counts}) == len(counts) and sum(x.px for x in counts) == sum(abs(r + shift[0] - y) <= 12 and abs(c + shift[1] - x) <= 12 for r, c in at for y, x in at)
    assert reference_map.registration(spark.createDataFrame(counts, "dr long, dc long, px long"), 0.5) == verdict


def test_no_roads_no_verdict(spark):
    none = spark.createDataFrame([], "r long, c long")
    some = spark.createDataFrame([(1, 1)], "r long, c long")
    assert reference_map.registration(reference_map.shift_counts(some, none, 0.5), 0.5) is None


def test_sorts_keep_all_rows(spark, sf):
    got = [tuple(x) for x in catalog.QUERIES["sort_area"](spark, sf).collect()]
    assert len(got) > 40 and got == sorted((tuple(x) for x in index(spark, sf).region_ids.select("region_id", "area_px").collect()), key=lambda x: (-x[1], x[0]))
    found = audit_queries.audit(spark, "/root/testdata/sf0.01").findings.select("region_id", "cause", "severity", "area_m2").collect()
    want = [tuple(x)[:3] for x in sorted(found, key=lambda x: (-x.severity, -x.area_m2, x.region_id, x.cause))]
    assert len(want) > 30 and [tuple(x) for x in catalog.QUERIES["sort_severity"](spark, "/root/testdata/sf0.01").collect()] == want


@pytest.mark.parametrize("patches, odd", [(20000, "w"), (40000, "h"), (60000, ""), (140000, "hw"), (500, ""), (0, "")])
def test_crop_is_centred_as_in_its_sql(spark, tmp_path, patches, odd):
    """Margins that are and aren't whole cells, a grid of 8,000 cells, and one without cells."""
    con = duckdb.connect()
    con.sql(f"create table part as select i::bigint p_partkey, (i * 7 % 50)::int p_size from range({patches}) t(i)")
    con.sql("create view lineitem as select * from '/root/testdata/sf0.001/lineitem.parquet'")
    con.sql(f"copy part to '{tmp_path}/part.parquet'")
    for t in ("lineitem", "nation"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    h, w = patches // 50 * 4, 200
    left = {n: size - int(size * min(1, (8000 / (h * w)) ** 0.5)) for n, size in (("h", h), ("w", w)) if patches}
    assert {n for n, x in left.items() if x % 2} == set(odd)
    assert [tuple(r) for r in catalog.QUERIES["crop_window"](spark, str(tmp_path)).collect()] == con.sql(catalog.ORACLES["crop_window"]).fetchall()
