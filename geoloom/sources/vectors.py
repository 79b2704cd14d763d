"""Street and building vectors: Overpass JSON, GeoJSON and OSM XML to one table of ways; burning to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WAYS = "way_id bigint, tags map<string,string>, lon array<double>, lat array<double>, nodes array<bigint>"
_OVERPASS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>>>"
_GEOJSON = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def from_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Ways with a geometry; other elements are skipped (see skipped_counts)."""
    e = spark.read.schema(_OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    ok = e.where("type = 'way' and size(geometry) >= 2")
    return ok.select(F.col("id").alias("way_id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), F.col("geometry.lon").alias("lon"), F.col("geometry.lat").alias("lat"), "nodes")


def skipped_counts(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.schema(_OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return e.where("type <> 'way' or geometry is null or size(geometry) < 2").groupBy("type").agg(F.count("*").alias("n"))


def from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Lines and the outer rings of polygons."""
    f = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("k", "f")).select("k", "f.*")
    line = F.from_json("geometry.coordinates", "array<array<double>>")
    ring = F.element_at(F.from_json("geometry.coordinates", "array<array<array<double>>>"), 1)
    xy = F.when(F.col("geometry.type") == "LineString", line).when(F.col("geometry.type") == "Polygon", ring)
    ok = f.withColumn("xy", xy).where("size(xy) >= 2")
    key = F.coalesce(F.expr("try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)"), F.col("k").cast("long"))
    return ok.select(key.alias("way_id"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("tags"), F.transform("xy", lambda p: p[0]).alias("lon"), F.transform("xy", lambda p: p[1]).alias("lat"), F.lit(None).cast("array<bigint>").alias("nodes"))


def from_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an OSM XML file with their nodes' places; the schema is given, so one tag isn't a struct."""
    tag = "array<struct<_k:string,_v:string>>"
    node = spark.read.format("xml").option("rowTag", "node").schema("_id bigint, _lat double, _lon double").load(path)
    way = spark.read.format("xml").option("rowTag", "way").schema(f"_id bigint, nd array<struct<_ref:bigint>>, tag {tag}").load(path)
    each = way.select("_id", "tag", F.posexplode("nd._ref").alias("k", "ref")).join(node.select(F.col("_id").alias("ref"), "_lat", "_lon"), "ref")
    pts = each.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("k", "ref", "_lon", "_lat"))).alias("p"), F.first("tag").alias("tag"))
    return pts.where("size(p) >= 2").select(F.col("_id").alias("way_id"), F.coalesce(F.map_from_entries("tag"), F.create_map().cast("map<string,string>")).alias("tags"), F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ref").alias("nodes"))


def as_geojson(ways: DataFrame) -> DataFrame:
    """(way_id, feature) with a GeoJSON text for each way."""
    shape = F.struct(F.lit("LineString").alias("type"), F.arrays_zip("lon", "lat").alias("coordinates"))
    points = F.struct(F.lit("LineString").alias("type"), F.transform(shape["coordinates"], lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return ways.select("way_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("way_id").alias("id"), F.col("tags").alias("properties"), points.alias("geometry"))).alias("feature"))


def fingerprint(ways: DataFrame) -> str:
    """A digest of ids, tags and rounded coordinates that doesn't depend on row order."""
    line = F.concat_ws("|", F.col("way_id").cast("string"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))), F.array_join(F.transform("lon", lambda x: F.round(x, 7).cast("string")), ","), F.array_join(F.transform("lat", lambda x: F.round(x, 7).cast("string")), ","))
    total = ways.select(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
    return f"{int(total[0] or 0):x}-{total[1]}"


# ---- tags ----------------------------------------------------------------------------------------

# Half widths in metres by grade and without one, lane width, least half width;
# widths and numbers of lanes that are believed.
HALF_WIDTHS = {
    "motorway": 11.0, "trunk": 8.0, "primary": 7.0, "secondary": 6.0, "tertiary": 5.0, "unclassified": 4.0, "residential": 4.0,
    "living_street": 3.5, "service": 3.0, "track": 2.5, "road": 4.0,
    "pedestrian": 2.5, "footway": 1.0, "path": 1.0, "steps": 1.0, "cycleway": 1.0, "bridleway": 1.0, "corridor": 1.0,
}
DEFAULT_M, LANE_M, LEAST_M = 3.0, 3.5, 1.0
WIDTH_RANGE, LANES_RANGE = (0.5, 60.0), (1.0, 12.0)


def tag(name: str) -> Column:
    return F.col("tags")[name]


def kind() -> Column:
    """road, building, water, barrier, or null."""
    return (
        F.when(tag("highway").isNotNull(), "road")
        .when(tag("building").isNotNull() & ~tag("building").isin("no", "roof"), "building")
        .when((tag("natural") == "water") | tag("waterway").isNotNull(), "water")
        .when(tag("barrier").isNotNull(), "barrier")
    )


def half_width() -> Column:
    """Half of a believable width tag; else the grade's half width, of which lanes are a floor; a metre at least."""
    number = F.expr("try_cast(trim(split(trim(replace(coalesce(nullif(tags['width'], ''), tags['est_width']), 'm', ' ')), ' ')[0]) as double)")
    lanes = F.expr("try_cast(trim(split(tags['lanes'], ';')[0]) as double)")
    grades = F.create_map(*(x for k, v in HALF_WIDTHS.items() for x in (F.lit(k), F.lit(v))))
    by_grade = F.coalesce(F.try_element_at(grades, grade()), F.lit(DEFAULT_M))
    by_lanes = F.when(lanes.between(*LANES_RANGE), lanes * LANE_M / 2)
    return F.greatest(F.lit(LEAST_M), F.coalesce(F.when(number.between(*WIDTH_RANGE), number / 2), F.greatest(by_grade, by_lanes)))


def grade() -> Column:
    """The highway value, a link counting as the road it leads to; null for what is no road."""
    return F.regexp_replace(F.nullif(tag("highway"), F.lit("")), "_link$", "")


def is_closed() -> Column:
    return (F.size("lon") >= 4) & (F.element_at("lon", 1) == F.element_at("lon", -1)) & (F.element_at("lat", 1) == F.element_at("lat", -1))


def is_area() -> Column:
    """Closed ways that are filled rather than buffered: tags decide."""
    return is_closed() & (F.coalesce(tag("area") == "yes", F.lit(False)) | F.coalesce(kind().isin("building", "water"), F.lit(False))) & ~F.coalesce(tag("area") == "no", F.lit(False))


def label() -> Column:
    return F.coalesce(tag("name:en"), tag("name"), F.when(tag("highway").isNotNull(), F.concat(F.lit("unnamed "), tag("highway"))), F.concat(F.coalesce(kind(), F.lit("way")), F.lit(" "), F.col("way_id").cast("string")))


# ---- burning -------------------------------------------------------------------------------------


def to_pixels(ways: DataFrame, x0: float, y0: float, px: float, py: float, crs: int = 4326) -> DataFrame:
    """ways with rows and cols arrays; only WGS84 grids are placed, others are refused."""
    if crs != 4326:
        raise ValueError(f"vectors are WGS84; a raster in EPSG:{crs} would have to be reprojected")
    return ways.withColumn("rows", F.transform("lat", lambda y: (y0 - y) / py)).withColumn("cols", F.transform("lon", lambda x: (x - x0) / px))


def burn_capsules(ways: DataFrame, gsd: float, cells: DataFrame | None = None) -> DataFrame:
    """(way_id, r, c) whose centres lie within half_width metres of a segment, half a cell at least.

    A segment's bounding box is exploded to candidate cells, and a closed-form distance decides: no
    kernel, no pairwise join.
    """
    segs = ways.withColumn("half", F.greatest(F.lit(0.5), half_width() / gsd)).select("way_id", "half", F.explode(F.expr("transform(sequence(0, size(rows) - 2), i -> struct(rows[i] as r0, cols[i] as c0, rows[i + 1] as r1, cols[i + 1] as c1))")).alias("s")).select("way_id", "half", "s.*")
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) - F.col("half")), F.floor(F.greatest(a, b) + F.col("half")))
    near = segs.withColumn("r", F.explode(span("r0", "r1"))).withColumn("c", F.explode(span("c0", "c1")))
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    y, x = F.col("r") + 0.5, F.col("c") + 0.5
    long = dr * dr + dc * dc
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((y - F.col("r0")) * dr + (x - F.col("c0")) * dc) / long))).otherwise(0.0)
    d2 = (y - F.col("r0") - t * dr) ** 2 + (x - F.col("c0") - t * dc) ** 2
    out = near.where(d2 <= F.col("half") * F.col("half")).select("way_id", "r", "c").distinct()
    return out.join(cells.select("r", "c"), ["r", "c"], "left_semi") if cells is not None else out


def fill_polygons(ways: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(way_id, r, c) inside closed ways by the even-odd rule at cell centres; one below a cell keeps its corner cell."""
    segs = ways.select("way_id", F.explode(F.expr("transform(sequence(0, size(rows) - 2), i -> struct(rows[i] as r0, cols[i] as c0, rows[i + 1] as r1, cols[i + 1] as c1))")).alias("s")).select("way_id", "s.*").where("r0 <> r1")
    lines = segs.withColumn("r", F.explode(F.sequence(F.ceil(F.least("r0", "r1") - 0.5), F.ceil(F.greatest("r0", "r1") - 0.5)))).where("r + 0.5 >= least(r0, r1) and r + 0.5 < greatest(r0, r1)")
    at = F.col("c0") + (F.col("r") + 0.5 - F.col("r0")) / (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    w = Window.partitionBy("way_id", "r").orderBy("x")
    crossed = lines.withColumn("x", at).withColumn("k", F.row_number().over(w)).withColumn("nxt", F.lead("x").over(w)).where("k % 2 = 1 and nxt is not null")
    lo, hi = F.ceil(F.col("x") - 0.5), F.ceil(F.col("nxt") - 0.5) - 1
    inside = crossed.where(lo <= hi).select("way_id", "r", F.explode(F.sequence(lo, hi)).alias("c"))
    corner = ways.select("way_id", F.floor(F.element_at("rows", 1)).alias("r"), F.floor(F.element_at("cols", 1)).alias("c")).join(inside.select("way_id").distinct(), "way_id", "left_anti")
    out = inside.unionByName(corner).distinct()
    return out.join(cells.select("r", "c"), ["r", "c"], "left_semi") if cells is not None else out


def named_streets(ways: DataFrame) -> DataFrame:
    """(name): the distinct names of roads."""
    return ways.where((kind() == "road") & tag("name").isNotNull()).select(tag("name").alias("name")).distinct()


def junctions(ways: DataFrame) -> DataFrame:
    """(node, ways, names): nodes that two roads or more share."""
    each = ways.where(kind() == "road").select("way_id", label().alias("name"), F.explode("nodes").alias("node"))
    return each.groupBy("node").agg(F.count_distinct("way_id").alias("degree"), F.array_sort(F.collect_set("name")).alias("names")).where("degree >= 2")


