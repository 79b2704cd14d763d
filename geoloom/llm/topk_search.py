"""Exact top-k inner-product search with norm-bucketed retrieval.

All vectors are numbered by length, longest first, and cut into groups of buckets.  Groups are
searched in waves, the longest group first, then four times as many each time.  A wave knows each
query's k-th best score so far, and a query goes to a group only if the product of both lengths can
reach it; groups that can't hold a result are left out before anything is shuffled.  Within a group
the threshold becomes a local cosine threshold for each bucket.  Above 1 the bucket is skipped; if
it is high, a bound on the query's strongest coordinate leaves few vectors; else the prefix of
vectors long enough is kept.  What is left is verified by whole products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import number_rows
from .common import map_arrow, record_batch, staged

#: Vectors in a bucket and in a group, bytes of a group, queries in a block: what a task holds.
BUCKET, GROUP, GROUP_BYTES, QUERIES = 2048, 16384, 32 << 20, 512
#: Queries that meet a group in one task; more go to further tasks.
ASKED = 65536
#: The driver holds a length for each group and dimension; groups grow when there would be more of them.
GROUPS = 1 << 20
#: From this local cosine threshold on, pruning by coordinate pays.
COSINE = 0.85
#: Integers up to here are exact in a double.
EXACT = 2.0**52
_PACKED = pa.schema([("g", pa.int64()), ("dim", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())])


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("data", pa.binary())])
    for batch in batches:
        rows = []
        for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key is None or v is None or None in v:
                continue
            x = np.floor(64.0 * np.array(v, np.float64))
            if np.isfinite(x).all():
                rows.append((key, len(x), float(np.sqrt(np.dot(x, x))), x.tobytes()))
        if rows:
            yield record_batch(schema, *zip(*rows))


def _packed(size: int):
    """Rows (g, vec_id, dim, norm, data), sorted by group, dimension and length, as buckets of one group and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            return record_batch(_PACKED, [held[0][0]], [held[0][2]], [max(r[3] for r in held)], [np.array([r[1] for r in held], np.int64).tobytes()], [b"".join(r[4] for r in held)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == size or (row[0], row[2]) != (held[0][0], held[0][2])):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return run


class Best:
    """The k best of each query so far, and the score that a further one must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        q, score, key = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, key])
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        full = rank == self.k - 1
        self.least[q[full]] = score[full].astype(np.float64)
        self.q, self.score, self.id = q[kept], score[kept], key[kept]


def products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Whole inner products: exact in doubles below 2**52, else by Python's integers, held to a long."""
    if bound < EXACT:
        return q @ v.T
    ints = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = np.dot(ints(q), ints(v).T)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in row] for row in exact], object).reshape(exact.shape)


def search_bucket(best: Best, qn: np.ndarray, q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray) -> int:
    """Offer a bucket (sorted by length, longest first) to all queries; the number of products made."""
    vn = np.sqrt(np.einsum("ij,ij->i", v, v))
    top = float(vn[0])
    slack = 1e-9 * (1 + np.abs(best.least))  # bounds are rounded, products aren't
    need = best.least - np.where(np.isfinite(best.least), slack, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(qn * top > 0, need / (qn * top), np.where(need <= 0, -np.inf, np.inf))
    made = 0
    by_coordinate = (cosine >= COSINE) & (cosine <= 1)
    exact = float(qn.max(initial=0)) * top < EXACT
    for i in np.flatnonzero(by_coordinate).tolist():
        unit = q[i] / qn[i]
        f = int(np.argmax(np.abs(unit)))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.minimum(1.0, need[i] / (qn[i] * vn))
            x = v[:, f] / vn
        spread = np.sqrt(np.maximum(0, 1 - t * t) * max(0.0, 1 - unit[f] * unit[f]))
        some = np.flatnonzero((need[i] <= qn[i] * vn * (1 + 1e-12)) & (np.abs(x - unit[f] * t) <= spread + 1e-9) if exact else need[i] <= qn[i] * vn * (1 + 1e-12))
        # below the threshold's cosine the region only grows towards the query: keep that side whole
        some = np.union1d(some, np.flatnonzero((x * np.sign(unit[f]) >= abs(unit[f]) * t) & (need[i] <= qn[i] * vn * (1 + 1e-12))))
        _offer(best, np.array([i]), q[i : i + 1], qid[i : i + 1], v[some], vid[some], qn[i : i + 1], vn[some])
        made += len(some)
    rest = np.flatnonzero(~by_coordinate & (cosine <= 1))
    if len(rest):
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.min(np.where(need[rest] > 0, need[rest] / np.maximum(qn[rest], 1e-300), -np.inf))
        n = int(np.searchsorted(-vn, -shortest * (1 - 1e-12), side="right")) if shortest > 0 else len(v)
        _offer(best, rest, q[rest], qid[rest], v[:n], vid[:n], qn[rest], vn[:n])
        made += n * len(rest)
    return made


def _offer(best: Best, which, q, qid, v, vid, qn, vn) -> None:
    if not len(v):
        return
    s = products(q, v, float(qn.max()) * float(vn.max()))
    good = np.asarray(s >= best.least[which][:, None], bool) & (qid[:, None] != vid[None, :])
    i, j = np.nonzero(good)
    best.add(which[i], s[i, j].astype(np.int64), vid[j])


def _asked(tops: dict[int, tuple[int, np.ndarray]], lo: int, hi: int):
    """Rows (uid, vec_id, dim, norm, data, least) once for each group of the wave, the lo-th to the hi-th of its dimension, that can reach least."""
    schema = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("least", pa.int64()), ("data", pa.binary()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, key, dim, norm, data, least in zip(*(c.to_pylist() for c in batch.columns)):
                first, lengths = tops.get(dim, (0, np.zeros(0)))
                lengths = lengths[lo:hi]
                if least is not None:
                    lengths = lengths[norm * lengths * (1 + 1e-9) + 1e-6 >= least]  # a prefix, as lengths fall
                rows += [(uid, key, dim, least, data, first + lo + j) for j in range(len(lengths))]
            for i in range(0, len(rows), 4096):
                yield record_batch(schema, *zip(*rows[i : i + 4096]))

    return run


def _searched(k: int):
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, buckets, asked = None, [], []

        def out():
            uid, key, least = (np.array(x) for x in zip(*((r[0], r[1], -np.inf if r[2] is None else r[2] - abs(r[2]) * 2.0**-50) for r in asked)))
            q = np.frombuffer(b"".join(r[3] for r in asked), np.float64).reshape(len(asked), -1)
            best = Best(len(asked), k)
            best.least = least.astype(np.float64)
            qn = np.sqrt(np.einsum("ij,ij->i", q, q))
            for keys, m in buckets:
                search_bucket(best, qn, q, key, m, keys)
            if len(best.q):
                yield record_batch(schema, uid[best.q], key[best.q], best.id, best.score)

        for batch in batches:
            for g, part, dim, query, uid, key, least, data, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part, dim) != at:
                    if asked:
                        yield from out()
                    at, buckets, asked = (g, part, dim), [], []
                if not query:
                    keys = np.frombuffer(ids, np.int64)
                    buckets.append((keys, np.frombuffer(data, np.float64).reshape(len(keys), dim)))
                    continue
                asked.append((uid, key, least, data))
                if len(asked) == QUERIES:
                    yield from out()
                    asked = []
        if asked:
            yield from out()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer products, ties to the smaller id.

    Components become floor(64 x).  Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; a query meets vectors of its own dimension (empty ones
    have products of 0), and not rows with its own id; repeated rows all take part, and a repeated
    query row has a result of its own; empty tables give an empty result; other columns are
    ignored.  Products beyond a long are held to its limits and then tie.
    """
    pick = lambda df: map_arrow(df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")), _quantised, "vec_id long, dim int, norm double, data binary")
    all_v = staged(pick(vectors).withColumn("shorter", -F.col("norm")))
    all_q = staged(pick(queries).withColumn("uid", F.monotonically_increasing_id()))
    n, wide = all_v.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    parts = max(1, -(-all_q.count() // ASKED))
    size = max(1, min(GROUP, GROUP_BYTES // (8 * max(1, wide))), -(-n // GROUPS))
    ranked = number_rows(all_v, ["dim", "shorter", "vec_id"], "rn").withColumn("g", F.floor((F.col("rn") - 1) / size).cast("long"))
    packed = ranked.repartition(max(1, -(-n // size)), "g").sortWithinPartitions("g", "dim", "rn").select("g", "vec_id", "dim", "norm", "data")
    buckets = staged(map_arrow(packed, _packed(BUCKET), "g long, dim int, top double, ids binary, data binary"))
    tops: dict[int, tuple[int, list]] = {}
    for g, dim, top in buckets.groupBy("g", "dim").agg(F.max("top").alias("top")).orderBy("dim", "g").toLocalIterator():
        tops.setdefault(dim, (g, []))[1].append(top)
    tops = {dim: (g, np.array(x)) for dim, (g, x) in tops.items()}
    longest = max((len(x) for _, x in tops.values()), default=0)
    best = vectors.sparkSession.createDataFrame([], "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    lo, width = 0, 1
    while lo < longest:
        least = best.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        asked = map_arrow(all_q.join(least, "uid", "left").select("uid", "vec_id", "dim", "norm", "data", "least"), _asked(tops, lo, lo + width), "uid long, vec_id long, dim int, least long, data binary, g long")
        wave = [F.col("dim").eqNullSafe(dim) & F.col("g").between(g + lo, g + lo + width - 1) for dim, (g, x) in tops.items() if len(x) > lo]
        here = reduce(lambda a, b: a | b, wave)
        left = buckets.where(here).select("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", F.lit(0).alias("query"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("least"), "data", "ids", "top")
        right = asked.select("g", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), "dim", F.lit(1).alias("query"), "uid", "vec_id", "least", "data", F.lit(None).cast("binary").alias("ids"), F.lit(0.0).alias("top"))
        cells = left.unionByName(right).repartition(min(4096, width * len(wave) * parts), "g", "part").sortWithinPartitions("g", "part", "dim", "query", F.desc("top"), "uid")
        found = map_arrow(cells.drop("top"), _searched(k), "uid long, query_id long, vec_id long, score long")
        best = staged(best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        lo, width = lo + width, 4 * width
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def oracle_sql(k: int = 20) -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0)::bigint score
      from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e))
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= {k}"""
