"""Index tables kept by what they were made from: Parquet beside a metadata file that is written last."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
_META = "kind string, key string, fingerprint string, params string, made double"


def key_of(kind: str, fingerprint: str, params: dict) -> str:
    """16 hex digits over the input's fingerprint, the parameters and the schema version."""
    return hashlib.sha256(json.dumps([kind, fingerprint, params, SCHEMA_VERSION], sort_keys=True).encode()).hexdigest()[:16]


def fingerprint_of(df: DataFrame) -> str:
    """Rows and content of a table, whatever their order."""
    n, h = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()
    return f"{n}-{h or 0:x}"


def age_text(seconds: float) -> str:
    """How long ago, in the largest unit that fits."""
    for unit, size in (("d", 86400), ("h", 3600), ("min", 60)):
        if seconds >= size:
            return f"{seconds / size:.0f} {unit}"
    return f"{max(0, seconds):.0f} s"


class IndexStore:
    """get() reads a table whose key matches, else builds and writes it; a half-written entry has no metadata and is rebuilt."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _meta(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_META).json(f"{self.root}/_meta")
        except Exception:  # noqa: BLE001  (nothing stored yet)
            return None

    def get(self, kind: str, fingerprint: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        key = key_of(kind, fingerprint, params)
        path, meta = f"{self.root}/{kind}-{key}", self._meta()
        if meta is None or not meta.where((F.col("key") == key) & (F.col("fingerprint") == fingerprint)).limit(1).count():
            build().write.mode("overwrite").parquet(path)
            row = f"('{kind}', '{key}', '{fingerprint}', '{json.dumps(params, sort_keys=True)}', {time.time()!r}D)"
            self.spark.sql(f"select * from values {row} as m(kind, key, fingerprint, params, made)").coalesce(1).write.mode("append").json(f"{self.root}/_meta")
        return self.spark.read.parquet(path)

    def entries(self) -> DataFrame:
        """What is stored, newest first, with its age in seconds."""
        meta = self._meta()
        if meta is None:
            return self.spark.createDataFrame([], _META + ", age double")
        return meta.withColumn("age", F.lit(time.time()) - F.col("made")).orderBy(F.desc("made"), "key")
