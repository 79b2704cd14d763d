"""Shared helpers of the training-data operators: scratch tables, batch sizing, word tables."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import scratch_root, staged  # noqa: F401  (part of this module's interface)
from ..session import ensure_importable

def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 96) -> None:
    """Bound what one Arrow batch holds: few rows, and few bytes where Spark can count them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # noqa: BLE001  (a Spark without this setting)
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    ensure_importable(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: a worker is used again, and shares its executor's limit with others."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def text_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most about most_bytes each; a null text is empty; a larger text comes alone."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, v in zip(keys, values):
            v = v or ""
            if texts and held + len(v) > most_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(k)
            texts.append(v)
            held += len(v)
    if texts:
        yield ids, texts


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; whatever else the table has is pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, for checking a bound before data is held or broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_types(df: DataFrame, schema: str) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: An odd base for polynomial hashes modulo 2**64, and its inverse there.
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        n = 1 << (n - 1).bit_length()
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(base)
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["i"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of buf, all at once by prefix sums."""
    p, inv = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) * _MULT))


def env_single_thread() -> None:
    """Native tokenizer pools are of no use inside a Spark task, which owns one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
