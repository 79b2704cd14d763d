"""Readers and writers on files made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.sources import notes, rasters, store, vectors


def tiff(a, x0=0.0, y0=0.0, px=1.0, nodata=None, mapping=None, crs=4326, deflate=True):
    """A little-endian single-strip TIFF with geographic tags."""
    data = zlib.compress(a.tobytes()) if deflate else a.tobytes()
    entries, extra = [], b""
    base = 8 + len(data)

    def add(tag, kind, values):
        nonlocal extra
        body = values if isinstance(values, bytes) else b"".join(struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind], v) for v in values)
        n = len(body) if kind == 2 else len(values)
        if len(body) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, n, base + len(extra)))
            extra += body

    add(256, 3, [a.shape[1]]), add(257, 3, [a.shape[0]]), add(258, 3, [8 * a.itemsize]), add(259, 3, [8 if deflate else 1])
    add(273, 4, [8]), add(277, 3, [1]), add(278, 3, [a.shape[0]]), add(279, 4, [len(data)]), add(339, 3, [1])
    add(33550, 12, [px, px, 0.0]), add(33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), add(34735, 3, [1, 1, 0, 1, 2048, 0, 1, crs])
    if mapping:
        add(42112, 2, f'<GDALMetadata><Item name="ID_TO_LABEL_MAPPING">{json.dumps(mapping)}</Item></GDALMetadata>\0'.encode())
    if nodata is not None:
        add(42113, 2, f"{nodata}\0".encode() + b"\0\0\0\0")
    entries.sort(key=lambda e: struct.unpack("<H", e[:2])[0])
    return b"II*\0" + struct.pack("<I", base + len(extra)) + data + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def grid(df, shape):
    out = np.full(shape, -1)
    for r, c, k in df.where("valid").select("r", "c", "class_id").collect():
        out[r, c] = k
    return out


def test_npy_and_png_and_bmp(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 47, (9, 14)).astype(np.uint8)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "b.png").write_bytes(rasters.write_png(a))
    wide = np.zeros((9, 16), np.uint8)
    wide[:, :14] = a[::-1]
    (tmp_path / "c.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + 1024 + wide.size, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 14, 9, 1, 8, 0, 0, 0, 0, 0, 0) + bytes(1024) + wide.tobytes())
    for name in ("a.npy", "b.png", "c.bmp"):
        assert (grid(rasters.labels(spark, str(tmp_path / name)), a.shape) == a).all(), name


def test_out_of_range_and_three_bands_are_refused(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.full((2, 2), 47))
    with pytest.raises(Exception, match="out of range"):
        rasters.labels(spark, str(tmp_path / "a.npy")).collect()
    with pytest.raises(rasters.Refused):
        rasters.read_png(rasters.write_png(np.zeros((2, 2, 3), np.uint8)))
    with pytest.raises(rasters.Refused):
        rasters.read_npy(open(tmp_path / "a.npy", "rb").read()[:0] + _npy(np.zeros((2, 2, 2), int)))


def _npy(a):
    import io

    b = io.BytesIO()
    np.save(b, a)
    return b.getvalue()


def test_wire_ids_map_by_name_and_nodata_is_no_class(spark, tmp_path):
    a = np.array([[0, 10, 10], [40, 112, 0]], np.uint8)
    (tmp_path / "t.tif").write_bytes(tiff(a, nodata=0, mapping={"10": "House", "40": "Water", "112": "Rendzina"}))
    got = rasters.labels(spark, str(tmp_path / "t.tif"))
    assert (grid(got, a.shape) == np.array([[-1, 4, 4], [11, 17, -1]])).all()
    assert got.where("not valid and class_id is not null").count() == 0
    with pytest.raises(rasters.Refused, match="unknown class"):
        rasters.labels(spark, str(tmp_path / "t.tif"), {10: "Greenhouse"})
    with pytest.raises(Exception, match="unmapped wire id"):
        rasters.labels(spark, str(tmp_path / "t.tif"), {10: "House"}).collect()
    assert rasters.class_map(json.dumps(json.dumps({"3": "Shadow"}))) == {3: "Shadow"}


def test_mosaic_joins_across_a_seam_and_crops(spark, tmp_path):
    left, right = np.zeros((8, 8), np.uint8), np.zeros((8, 8), np.uint8)
    left[2:6, 4:], right[2:6, :4] = 4, 4
    (tmp_path / "a.tif").write_bytes(tiff(left, 0.0, 8.0, nodata=0))
    (tmp_path / "b.tif").write_bytes(tiff(right, 8.0, 8.0, nodata=0, deflate=False))
    got = rasters.mosaic(spark, str(tmp_path))
    assert (grid(got, (4, 8)) == 4).all() and got.count() == 32
    (tmp_path / "c.tif").write_bytes(tiff(right, 16.0, 8.0, nodata=0, crs=32636))
    with pytest.raises(rasters.Refused):
        rasters.mosaic(spark, str(tmp_path))


def test_headers_decode_no_pixels(spark, tmp_path):
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "b.png").write_bytes(rasters.write_png(a)[:40])  # cut off before its pixels
    whole = tiff(a, 2.0, 5.0, 0.5, nodata=0, mapping={"1": "House"})
    (tmp_path / "c.tif").write_bytes(whole.replace(zlib.compress(a.tobytes()), bytes(len(zlib.compress(a.tobytes())))))
    got = [tuple(r)[1:] for r in rasters.headers(spark, str(tmp_path)).orderBy("path").collect()]
    none = (None,) * 7
    assert got == [(2, 3, *none), (2, 3, *none), (2, 3, 0.5, 0.5, 2.0, 5.0, 4326, 0, '{"1": "House"}')]


@pytest.fixture(scope="module")
def wide_map(spark, tmp_path_factory):
    """Two overlapping tiles, 1,300 columns together, and the same cells as an array."""
    rng = np.random.default_rng(3)
    a = np.repeat(np.repeat(rng.choice([4, 8, 9, 11, 14, 17, 20], (8, 163)), 8, axis=0), 8, axis=1)[:60, :1300].astype(np.uint8)
    a[rng.random(a.shape) < 0.02] = 250
    folder = tmp_path_factory.mktemp("tiles")
    first = a[:, :800].copy()
    first[:, 700:] = 3  # the later tile wins in the overlap
    first[:, 700:][a[:, 700:800] == 250] = 250
    (folder / "a.tif").write_bytes(tiff(first, 0.0, 60.0, nodata=250))
    (folder / "b.tif").write_bytes(tiff(a[:, 700:], 700.0, 60.0, nodata=250))
    return str(folder), a


def test_queries_over_a_mosaic_equal_those_over_its_cells(spark, wide_map):
    from geoloom.plans import audit, triage, verbs
    from geoloom.plans.index import Index

    path, a = wide_map
    rows = [(r, c, int(k) if k != 250 else None, bool(k != 250)) for (r, c), k in np.ndenumerate(a) if k != 250]
    cells = spark.createDataFrame(rows, "r long, c long, class_id int, valid boolean")
    both = [Index.from_raster(spark, path, 0.3), Index(spark, cells=cells, gsd=0.3, stride=a.shape[1])]
    key = ["chip_r", "chip_c"]

    def answers(i):
        policy = triage.compile_query("find houses near water")
        picked = triage.select(triage.score(policy, i.chip_frac, triage.units(i), key), key)
        frames = [verbs.run(i, "find House minarea 4").rows, verbs.run(i, "count Water near House 3").rows, verbs.run(i, "distance House Water").rows, audit.Audit(i).findings.select("region_id", "cause", "severity"), picked.select(*key, F.round("score", 9), "rank", "selected", "control")]
        return [sorted(map(str, f.collect())) for f in frames]

    one, two = map(answers, both)
    assert one == two and all(one)
    names = {r.region_id: (r.area_px, r.r0, r.c0) for r in both[0].regions.collect()}
    assert len(names) == len(set(names.values())) and max(v[2] for v in names.values()) > 1000
    assert (a == 4).sum() * 0.09 == pytest.approx(verbs.run(both[0], "describe").rows.where("name = 'House'").first().area_m2)
    with pytest.raises(verbs.Unanswerable):
        verbs.run(both[0], "find House slope > 5")


def test_an_index_is_kept_across_sessions_and_rebuilt_when_cells_change(spark, wide_map, tmp_path):
    from geoloom.plans.index import Index

    path, a = wide_map
    kept = store.IndexStore(spark, str(tmp_path / "kept"))
    first = Index.from_raster(spark, path, 0.3, store=kept).regions.count()
    n = kept.entries().count()
    assert Index.from_raster(spark, path, 0.3, store=kept).regions.count() == first and kept.entries().count() == n
    Index.from_raster(spark, path, 0.5, store=kept).regions.count()
    assert kept.entries().count() == 2 * n


def test_the_command_line_reads_a_raster(wide_map, capsys, spark):
    from geoloom import cli

    assert cli.main(["--input", wide_map[0], "--gsd", "0.3", "ask", "count", "House"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "n\tarea_m2"


def test_half_widths(spark):
    """By hand: a believable width wins, lanes are a floor, links are their road, nonsense is ignored."""
    tags = [
        ({"highway": "residential"}, 4.0), ({"highway": "residential", "width": "6 m"}, 3.0), ({"highway": "residential", "width": "6m"}, 3.0), ({"highway": "residential", "lanes": "4"}, 7.0),
        ({"highway": "motorway", "lanes": "2"}, 11.0), ({"highway": "service", "width": "900"}, 3.0), ({"highway": "trunk"}, 8.0), ({"highway": "primary_link"}, 7.0), ({"highway": "unknown"}, 3.0),
        ({"highway": "steps"}, 1.0), ({"highway": "pedestrian"}, 2.5), ({"highway": "track", "est_width": "4.5"}, 2.25), ({"highway": "track", "width": "1"}, 1.0), ({"highway": "road", "lanes": "3;2"}, 5.25),
        ({"highway": "road", "lanes": "40"}, 4.0), ({"highway": "living_street", "width": "20'"}, 3.5), ({"waterway": "river"}, 3.0), ({"highway": "path", "width": "", "est_width": "3"}, 1.5),
    ]
    ways = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(tags)], "way_id long, tags map<string,string>")
    assert [r.half for r in ways.select("way_id", vectors.half_width().alias("half")).orderBy("way_id").collect()] == [w for _, w in tags]


def test_vectors_from_three_formats(spark, tmp_path):
    over = {"elements": [{"type": "way", "id": 7, "tags": {"highway": "track", "name": "A"}, "nodes": [1, 2], "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}, {"type": "node", "id": 1}]}
    (tmp_path / "o.json").write_text(json.dumps(over))
    a = vectors.from_overpass(spark, str(tmp_path / "o.json"))
    assert [(r.way_id, r.tags["name"], r.lon) for r in a.collect()] == [(7, "A", [2.0, 2.5])]
    assert [tuple(r) for r in vectors.skipped_counts(spark, str(tmp_path / "o.json")).collect()] == [("node", 1)]
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "way/7", "properties": {"highway": "track", "name": "A"}, "geometry": {"type": "LineString", "coordinates": [[2.0, 1.0], [2.5, 1.5]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    b = vectors.from_geojson(spark, str(tmp_path / "g.json"))
    (tmp_path / "x.osm").write_text('<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.5" lon="2.5"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="track"/><tag k="name" v="A"/></way></osm>')
    c = vectors.from_osm_xml(spark, str(tmp_path / "x.osm"))
    assert vectors.fingerprint(a) == vectors.fingerprint(b) == vectors.fingerprint(c)
    assert json.loads(vectors.as_geojson(a).first().feature)["geometry"]["coordinates"] == [[2.0, 1.0], [2.5, 1.5]]


def test_burning(spark):
    row = lambda k, tags, rows, cols, nodes=None: (k, tags, [0.0] * len(rows), [0.0] * len(rows), nodes or [], rows, cols)
    schema = vectors.WAYS + ", rows array<double>, cols array<double>"
    road = spark.createDataFrame([row(1, {"highway": "track", "width": "2 m"}, [5.0, 5.0], [2.0, 8.0])], schema)
    got = {(r, c) for _, r, c in vectors.burn_capsules(road, 0.5).collect()}
    want = {(r, c) for r in range(12) for c in range(12) if min((r + 0.5 - 5) ** 2 + (c + 0.5 - max(2.0, min(8.0, c + 0.5))) ** 2, 99) <= 4}
    assert got == want
    square = spark.createDataFrame([row(2, {"building": "yes"}, [1.0, 1.0, 4.0, 4.0, 1.0], [1.0, 5.0, 5.0, 1.0, 1.0]), row(3, {"building": "yes"}, [9.1, 9.1, 9.2, 9.1], [9.1, 9.2, 9.2, 9.1])], schema)
    cells = {tuple(r) for r in vectors.fill_polygons(square).collect()}
    assert cells == {(2, r, c) for r in range(1, 4) for c in range(1, 5)} | {(3, 9, 9)}
    two = spark.createDataFrame([row(1, {"highway": "track", "name": "B"}, [], [], [1, 2]), row(2, {"highway": "service", "name": "A"}, [], [], [2, 3]), row(3, {"building": "yes"}, [], [], [2])], schema)
    assert [(r.node, r.degree, r.names) for r in vectors.junctions(two).collect()] == [(2, 2, ["A", "B"])]
    with pytest.raises(ValueError, match="reprojected"):
        vectors.to_pixels(road, 0, 0, 1, 1, crs=32636)


def test_store_rebuilds_only_what_changed(spark, tmp_path):
    s, made = store.IndexStore(spark, str(tmp_path / "s")), []
    build = lambda n: lambda: made.append(n) or spark.range(n)
    assert s.entries().count() == 0
    assert s.get("regions", "f1", {"min": 12}, build(3)).count() == 3
    assert s.get("regions", "f1", {"min": 12}, build(4)).count() == 3
    assert s.get("regions", "f1", {"min": 13}, build(5)).count() == 5
    assert s.get("regions", "f2", {"min": 12}, build(6)).count() == 6
    assert made == [3, 5, 6] and s.entries().count() == 3
    (tmp_path / "s" / f"chips-{store.key_of('chips', 'f', {})}").mkdir()  # half-written: no metadata
    assert s.get("chips", "f", {}, build(2)).count() == 2


def test_notes():
    text = "## House\nscale: 25 to 2000 m2\nconfused_with: Clutter - roofs; Igloo — snow\n  more\nfoo: bar\n## Igloo\nscale: -\n"
    rows = notes.parse(text)
    assert rows[1] == ("House", "confused_with", "Clutter - roofs; Igloo — snow more", False) and rows[2][3]
    assert notes.confusions(rows[1][2]) == ([("Clutter", "roofs")], ["Igloo"])
    assert notes.scale_range(rows[0][2]) == (25.0, 2000.0) and notes.scale_range("large") is None
    assert not notes.filled("-") and notes.filled("x") and len(notes.problems(rows)) == 3
    assert len({r[0] for r in notes.parse(notes.template())}) == 47


def test_places_of_rasters():
    from types import SimpleNamespace as Head

    m = Head(path="m", px=0.01, py=0.01, x0=35.0, y0=31.0, height=100, width=200, crs=4326)
    s, w, n, e = rasters.bbox_of(m)
    assert (s, n) == pytest.approx((30.0 - 150 / 111320, 31.0 + 150 / 111320)) and (w, e) == pytest.approx((35.0 - 150 / (111320 * np.cos(np.radians(30.5))), 37.0 + 150 / (111320 * np.cos(np.radians(30.5)))))
    tile = Head(path="t", px=0.01, py=0.01, x0=35.5, y0=30.8, height=10, width=20, crs=4326)
    assert rasters.window_of_tile(m, tile) == (20, 50, 30, 70)
    for change in ({"crs": 32636}, {"px": 0.02}, {"px": None}):
        with pytest.raises(rasters.Refused):
            rasters.window_of_tile(m, Head(**{**vars(tile), **change}))
    with pytest.raises(rasters.Refused):
        rasters.bbox_of(Head(**{**vars(m), "x0": None}))
    assert [store.age_text(s) for s in (5, 90, 7200, 200000)] == ["5 s", "2 min", "2 h", "2 d"]


def test_pairs_grids_streets_and_caveats(spark):
    from geoloom.plans import change, providers

    a, b = change.pair_of(change.pair_key(F.lit(46), F.lit(3)))
    assert tuple(spark.range(1).select(a, b).first()) == (46, 3)
    assert change.grids_match({"cols": 3}, {"cols": 3}) == "" and "cols" in change.grids_match({"cols": 3}, {"cols": 4})
    ways = spark.createDataFrame([(1, {"highway": "track", "name": "A"}), (2, {"highway": "track", "name": "A"}), (3, {"highway": "track"}), (4, {"building": "yes", "name": "B"})], "way_id long, tags map<string,string>")
    assert [r.name for r in vectors.named_streets(ways).collect()] == ["A"]
    scores = spark.createDataFrame([(0.5,), (None,), (0.0,), (1.0,)], "score double")
    text = providers.caveats("builtin", scores, False, ("made for wheels",))
    assert "25.0%" in text and "no elevation" in text and text.endswith("#   made for wheels")
