"""Label rasters from files: .npy, single-band PNG and BMP, and a useful part of GeoTIFF.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and decoded in
tasks with NumPy and the standard library; a raster becomes rows of cells there.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..session import ensure_importable

CELLS = "path string, r long, c long, raw int, valid boolean"
META = "path string, height long, width long, px double, py double, x0 double, y0 double, crs int, nodata int, mapping string"


class Refused(ValueError):
    """A raster that can't be read as labels, and why."""


def shape_npy(data: bytes) -> tuple[tuple[int, int], dict]:
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if len(shape) != 2 or dtype.kind not in "iub":
        raise Refused(f"labels are a 2-D integer array, not {len(shape)}-D {dtype}")
    return shape, {}


def shape_png(data: bytes) -> tuple[tuple[int, int], dict]:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Refused("not a PNG file")
    w, h = struct.unpack(">II", data[16:24])
    return (h, w), {}


def shape_bmp(data: bytes) -> tuple[tuple[int, int], dict]:
    if data[:2] != b"BM":
        raise Refused("not a BMP file")
    w, h = struct.unpack("<ii", data[18:26])
    return (abs(h), w), {}


def read_npy(data: bytes) -> tuple[np.ndarray, dict]:
    a = np.load(io.BytesIO(data), allow_pickle=False)
    if a.ndim != 2 or a.dtype.kind not in "iub":
        raise Refused(f"labels are a 2-D integer array, not {a.ndim}-D {a.dtype}")
    return a.astype(np.int64), {}


def read_png(data: bytes) -> tuple[np.ndarray, dict]:
    """Grey or palette PNG of 8 or 16 bits, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Refused("not a PNG file")
    at, idat, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head = body if kind == b"IHDR" else head
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if color not in (0, 3) or bits not in (8, 16) or interlace:
        raise Refused(f"labels need one band of 8 or 16 bits, not colour type {color} of {bits}")
    step = bits // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for i in range(h):
        kind, line = int(raw[i, 0]), raw[i, 1:].astype(np.int64)
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for j in range(len(line)):
                a = int(line[j - step]) if j >= step else 0
                b, c = int(above[j]), int(above[j - step]) if j >= step else 0
                if kind == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[j] = (line[j] + p) & 255
        out[i] = line
        above = line
    return (out if step == 1 else out.view(">u2")).astype(np.int64), {}


def write_png(a: np.ndarray) -> bytes:
    """An 8-bit grey (2-D) or RGB (3-D) PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_bmp(data: bytes) -> tuple[np.ndarray, dict]:
    """Uncompressed BMP of 8 bits a cell."""
    if data[:2] != b"BM":
        raise Refused("not a BMP file")
    start, size, w, h, _, bits, packed = (struct.unpack("<I", data[10:14]) + struct.unpack("<IiiHHI", data[14:34]))[:7]
    if bits != 8 or packed:
        raise Refused(f"labels need one uncompressed band of 8 bits, not {bits}")
    stride = (w + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, :w]
    return (a[::-1] if h > 0 else a).astype(np.int64), {}


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_KINDS = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8"}


def tiff_tags(data: bytes) -> tuple[str, dict[int, object]]:
    """Byte order and tags of a TIFF's first picture."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise Refused("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, object] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        e = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", e[:8])
        size = _SIZES.get(kind, 1) * n
        body = e[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(order + "I", e[8:12])[0]) : o + size]
        tags[tag] = body.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else np.frombuffer(body, order + _KINDS[kind]).tolist() if kind in _KINDS else body
    return order, tags


def shape_tiff(data: bytes) -> tuple[tuple[int, int], dict]:
    """Size and geographic tags, without any pixel."""
    _, tags = tiff_tags(data)
    return (tags.get(257, [0])[0], tags.get(256, [0])[0]), tiff_meta(tags)


def tiff_meta(tags: dict[int, object]) -> dict:
    meta: dict = {}
    if 33550 in tags and 33922 in tags:
        (sx, sy, *_), tie = tags[33550], tags[33922]
        meta |= {"px": sx, "py": sy, "x0": tie[3] - tie[0] * sx, "y0": tie[4] + tie[1] * sy}
    keys = tags.get(34735, [])
    for k in range(4, len(keys), 4):
        if keys[k] in (2048, 3072):
            meta["crs"] = int(keys[k + 3])
    if isinstance(tags.get(42113), str) and tags[42113].strip():
        meta["nodata"] = int(float(tags[42113]))
    m = re.search(r'name="ID_TO_LABEL_MAPPING"[^>]*>(.*?)</Item>', str(tags.get(42112, "")), re.S)
    if m:
        meta["mapping"] = m[1].replace("&quot;", '"')
    return meta


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """The first band of a TIFF in strips or tiles, plain or deflated, with its geographic tags."""
    order, tags = tiff_tags(data)
    one = lambda t, default: tags.get(t, [default])[0]
    w, h, bits, packed, bands = one(256, 0), one(257, 0), one(258, 1), one(259, 1), one(277, 1)
    if bands != 1:
        raise Refused(f"labels need one band, not {bands}")
    if packed not in (1, 8, 32946) or bits not in (8, 16, 32) or one(317, 1) not in (1, 2):
        raise Refused(f"compression {packed} of {bits} bits isn't read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(bits // 8))
    tw, th = (one(322, w), one(323, h)) if 322 in tags else (w, one(278, h))
    places, sizes = (tags[324], tags[325]) if 322 in tags else (tags[273], tags[279])
    out, across = np.zeros((h, w), dtype), -(-w // tw)
    for k, (o, n) in enumerate(zip(places, sizes)):
        part = data[o : o + n]
        part = zlib.decompress(part) if packed != 1 else part
        r, c = k // across * th, k % across * tw
        rows = th if 322 in tags else min(th, h - r)
        a = np.frombuffer(part, dtype, rows * tw).reshape(rows, tw)
        a = np.cumsum(a, axis=1, dtype=dtype) if one(317, 1) == 2 else a
        out[r : r + th, c : c + tw] = a[: h - r, : w - c]
    meta = tiff_meta(tags)
    return out if dtype.kind == "f" else out.astype(np.int64), meta


READERS = {".npy": read_npy, ".png": read_png, ".bmp": read_bmp, ".tif": read_tiff, ".tiff": read_tiff}


SHAPES = {".npy": shape_npy, ".png": shape_png, ".bmp": shape_bmp, ".tif": shape_tiff, ".tiff": shape_tiff}


def decode(path: str, data: bytes) -> tuple[np.ndarray, dict]:
    return _by_ending(READERS, path)(data)


def _by_ending(table: dict, path: str):
    ending = path[path.rfind(".") :].lower()
    if ending not in table:
        raise Refused(f"{path}: no reader for {ending!r}")
    return table[ending]


def class_map(text: str | dict) -> dict[int, str]:
    """Wire id -> class name, from a dict, JSON, or JSON within JSON."""
    made = text
    while isinstance(made, str):
        made = json.loads(made)
    return {int(k): v for k, v in made.items()}


def files(spark: SparkSession, path: str, glob: str = "*.{npy,png,bmp,tif,tiff}") -> DataFrame:
    """(path, content), in the order of names when sorted by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw cells of one file or of every raster in a directory: a file a task, bands of rows a batch."""
    ensure_importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, meta = decode(name, data)
                if a.dtype.kind == "f":
                    raise Refused(f"{name}: labels are integers")
                w = a.shape[1]
                for r0 in range(0, a.shape[0], max(1, (1 << 16) // max(w, 1))):
                    part = a[r0 : r0 + max(1, (1 << 16) // max(w, 1))]
                    r, c = np.indices(part.shape).reshape(2, -1)
                    flat = part.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(r + r0), pa.array(c), pa.array(flat.astype(np.int32)), pa.array(flat != meta["nodata"] if "nodata" in meta else np.ones(len(flat), bool))], names=["path", "r", "c", "raw", "valid"])

    return files(spark, path).mapInArrow(run, CELLS)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Size, placement, reference system, nodata value and class mapping of each raster; no pixel is decoded."""
    ensure_importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "height", "width", "px", "py", "x0", "y0", "crs", "nodata", "mapping"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shape, m = _by_ending(SHAPES, name)(data)
                row = [name, *shape, *(m.get(k) for k in names[3:])]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return files(spark, path).mapInArrow(run, META)


DEGREE_M = 111320.0


def bbox_of(head, margin_m: float = 150.0) -> tuple[float, float, float, float]:
    """(south, west, north, east) in degrees of a header row, padded; refused without a place on Earth."""
    if head.px is None or head.x0 is None:
        raise Refused(f"{head.path}: no affine, so its place isn't known")
    if head.crs not in (None, 4326):
        raise Refused(f"{head.path}: EPSG:{head.crs} would have to be reprojected")
    south, north = sorted((head.y0, head.y0 - head.height * head.py))
    west, east = sorted((head.x0, head.x0 + head.width * head.px))
    up = margin_m / DEGREE_M
    side = margin_m / max(DEGREE_M * np.cos(np.radians((south + north) / 2)), 1.0)
    return south - up, west - side, north + up, east + side


def window_of_tile(mosaic_head, tile_head) -> tuple[int, int, int, int]:
    """(r0, c0, r1, c1) of a tile in its mosaic, from both headers; other systems or cell sizes are refused, never resampled."""
    for head in (mosaic_head, tile_head):
        if head.px is None or head.x0 is None:
            raise Refused(f"{head.path}: no affine, so it can't be placed")
    if mosaic_head.crs != tile_head.crs:
        raise Refused(f"EPSG:{tile_head.crs} isn't the mosaic's EPSG:{mosaic_head.crs}")
    if any(abs(a - b) > abs(a) * 1e-6 for a, b in ((mosaic_head.px, tile_head.px), (mosaic_head.py, tile_head.py))):
        raise Refused(f"cells of {tile_head.px} x {tile_head.py} aren't the mosaic's {mosaic_head.px} x {mosaic_head.py}")
    r0, c0 = round((mosaic_head.y0 - tile_head.y0) / mosaic_head.py), round((tile_head.x0 - mosaic_head.x0) / mosaic_head.px)
    return r0, c0, r0 + tile_head.height, c0 + tile_head.width


def labels(spark: SparkSession, path: str, mapping: dict[int, str] | str | None = None) -> DataFrame:
    """(path, r, c, class_id, valid): wire ids mapped by name; an unmapped valid id is refused, nodata is no class."""
    raw = scan(spark, path)
    if mapping is None:
        found = [r.mapping for r in headers(spark, path).where("mapping is not null").select("mapping").distinct().collect()]
        mapping = found[0] if found else None
    if mapping is None:
        wrong = (F.col("raw") < 0) | (F.col("raw") >= len(tx.rows()))
        safe = F.when(F.col("valid") & wrong, F.raise_error(F.concat(F.lit("class id out of range: "), F.col("raw").cast("string"))).cast("int")).when(F.col("valid"), F.col("raw"))
        return raw.select("path", "r", "c", safe.alias("class_id"), "valid")
    names = class_map(mapping)
    unknown = sorted(set(names.values()) - set(tx.by_name()))
    if unknown:
        raise Refused(f"unknown class names in the mapping: {', '.join(unknown)}")
    dim = spark.sql("select * from values " + ", ".join(f"({w}, {tx.class_id(n)})" for w, n in names.items()) + " as m(raw, dense)")
    met = raw.join(F.broadcast(dim), "raw", "left")
    safe = F.when(F.col("valid") & F.col("dense").isNull(), F.raise_error(F.concat(F.lit("unmapped wire id: "), F.col("raw").cast("string"))).cast("int")).when(F.col("valid"), F.col("dense"))
    return met.select("path", "r", "c", safe.alias("class_id"), "valid")


def mosaic(spark: SparkSession, path: str, mapping: dict[int, str] | str | None = None, crop: bool = True) -> DataFrame:
    """Tiles of a directory placed by their affines; mixed reference systems or cell sizes are refused.

    Where tiles overlap the later name wins; cells outside all data are cropped off.
    """
    head = headers(spark, path)
    kinds = head.select("crs", F.round("px", 12), F.round("py", 12)).distinct().count()
    if kinds != 1 or head.where("px is null").count():
        raise Refused("tiles need one reference system and one cell size")
    corner = head.agg(F.min("x0").alias("mx"), F.max("y0").alias("my"))
    place = head.join(F.broadcast(corner)).select("path", F.round((F.col("my") - F.col("y0")) / F.col("py")).cast("long").alias("dr"), F.round((F.col("x0") - F.col("mx")) / F.col("px")).cast("long").alias("dc"))
    cells = labels(spark, path, mapping).join(F.broadcast(place), "path").where("valid")
    one = cells.groupBy((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.max_by("class_id", "path").alias("class_id"))
    if not crop:
        return one.withColumn("valid", F.lit(True))
    e = one.agg(F.min("r").alias("r0"), F.min("c").alias("c0"))
    return one.join(F.broadcast(e)).select((F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "class_id", F.lit(True).alias("valid"))


def colourise(a: np.ndarray) -> np.ndarray:
    """An RGB picture of labels: hues by golden-angle steps, the same for a class every time."""
    k = np.arange(len(tx.rows()))
    h = (k * 0.61803398875) % 1 * 6
    x = (1 - np.abs(h % 2 - 1)) * 200 + 40
    rgb = np.select([h[:, None] < j for j in range(1, 7)], [np.stack(p, 1) for p in ((240 + 0 * x, x, 40 + 0 * x), (x, 240 + 0 * x, 40 + 0 * x), (40 + 0 * x, 240 + 0 * x, x), (40 + 0 * x, x, 240 + 0 * x), (x, 40 + 0 * x, 240 + 0 * x), (240 + 0 * x, 40 + 0 * x, x))])
    return rgb[np.clip(a, 0, len(k) - 1)].astype(np.uint8)
