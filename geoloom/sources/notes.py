"""Analysts' class notes: Markdown sections of named fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tx

# Fields of a note, and texts that count as not filled in.
FIELDS = ["definition", "looks_like", "scale", "context", "confused_with", "season", "seen_in", "not_seen_in", "quality", "remarks"]
PLACEHOLDERS = {"", "-", "tbd", "todo", "n/a", "?", "..."}


def parse(text: str) -> list[tuple[str, str, str, bool]]:
    """(class, field, value, is_extra) rows: continued lines are joined, unknown fields are kept."""
    out: list[list] = []
    name = None
    for line in text.splitlines():
        if line.startswith("## "):
            name = line[3:].strip()
        elif name and (m := re.match(r"([A-Za-z_][\w ]*?)\s*:\s*(.*)$", line)) and not line.startswith((" ", "\t")):
            field = m[1].strip().lower().replace(" ", "_")
            out.append([name, field, m[2].strip(), field not in FIELDS])
        elif name and line.strip() and out and out[-1][0] == name:
            out[-1][2] = (out[-1][2] + " " + line.strip()).strip()
    return [tuple(r) for r in out]


def filled(value: str) -> bool:
    return value.strip().lower() not in PLACEHOLDERS and not value.strip().startswith("(seed)")


def confusions(value: str) -> tuple[list[tuple[str, str]], list[str]]:
    """((class, why), ...) of a confused_with field, and the names that are no class."""
    good, bad = [], []
    for item in re.split(r"[;\n]", value):
        if item.strip():
            name, _, why = (x.strip() for x in re.match(r"\s*(\S+)\s*(-|–|—)?\s*(.*)$", item).groups(default=""))
            (good.append((name, why)) if name in tx.by_name() else bad.append(name))
    return good, bad


def scale_range(value: str) -> tuple[float, float] | None:
    """The least and greatest square metres that a scale note states, if it states a range."""
    m = re.search(r"(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*(?:m2|m²|sq\.?\s*m|sqm|square\s+met)", value, re.I)
    return tuple(sorted(map(float, m.groups()))) if m else None


def problems(rows: list[tuple]) -> list[str]:
    """Sections of unknown classes, unknown fields, and confusions with unknown names."""
    out = [f"{c}: not a class" for c in dict.fromkeys(r[0] for r in rows) if c not in tx.by_name()]
    out += [f"{c}: unknown field {f}" for c, f, _, extra in rows if extra]
    return out + [f"{c}: confused with {n}, which is no class" for c, f, v, _ in rows if f == "confused_with" for n in confusions(v)[1]]


def confused(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(class_id, cand, why): classes that notes say are mixed up; names that are no class are left to problems()."""
    found = [(tx.class_id(c), tx.class_id(n), why) for c, f, v, _ in rows if f == "confused_with" and c in tx.by_name() and filled(v) for n, why in confusions(v)[0]]
    return spark.createDataFrame(found, "class_id int, cand int, why string")


def fields_filled(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(class_id, filled, definition) of classes with a note: how many known fields say something, and the definition if it does."""
    out: dict[str, tuple[int, str | None]] = {}
    for c, f, v, extra in rows:
        if c in tx.by_name() and not extra and filled(v):
            n, text = out.get(c, (0, None))
            out[c] = (n + 1, v if f == "definition" else text)
    return spark.createDataFrame([(tx.class_id(c), n, t) for c, (n, t) in out.items()], "class_id int, filled int, definition string")


def coverage(hist: DataFrame, dim: DataFrame, noted: DataFrame) -> DataFrame:
    """(class_id, name, px, filled): every class by how much of the map it covers, so that notes go where the map is."""
    every = dim.select("class_id", "name").join(hist.select("class_id", "px"), "class_id", "left").join(noted.select("class_id", "filled"), "class_id", "left")
    return every.select("class_id", "name", F.coalesce("px", F.lit(0)).alias("px"), F.coalesce("filled", F.lit(0)).alias("filled"))


def template() -> str:
    """A stub section for every class."""
    return "\n".join("## " + r[2] + "\n" + "\n".join(f"{f}: -" for f in FIELDS) + "\n" for r in tx.rows())


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, field, value, is_extra) of a notes file: a few hundred lines, parsed on the driver."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    rows = parse(text)
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rows:
        return spark.createDataFrame([], "class_name string, field string, value string, is_extra boolean")
    return spark.sql("select * from values " + ", ".join(f"({q(c)}, {q(f)}, {q(v)}, {str(e).lower()})" for c, f, v, e in rows) + " as n(class_name, field, value, is_extra)")
