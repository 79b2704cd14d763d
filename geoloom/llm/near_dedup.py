"""Near-duplicate components by SetSketch registers.

A document's set of word shingles becomes m registers, each the truncated exponent (on an
exponentially spaced scale) of a minimum of exponential variables: registers of a union are the
maxima of the parts' registers, and equal with a probability near the Jaccard similarity.  Bands of
registers propose pairs, the joint likelihood of the register comparisons drops pairs that can't
reach the threshold, and every link is confirmed on the full shingle sets.

Groups of copies don't make all pairs.  Texts with the same words are one node.  Within a band's
bucket each node meets the bucket's most central node only.  Nodes of a bucket that are then still
in several components meet by what sets them apart from the group's common shingles: exactly the
pairs that can be linked do (see _apart).  Any linked pair of a bucket is so found, or joined already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import map_arrow, mix64, record_batch, span_hashes, staged, text_blocks

#: Registers, registers in a band, base of the register scale and rate of the exponentials, as in
#: the sketch's published form; the highest register value.
REGISTERS, BAND, BASE, RATE, TOP = 96, 4, 1.001, 20.0, (1 << 16) - 1
#: A pair is dropped if the threshold's likelihood is this many nats below the best.
NATS = 14.0
#: Bits of the filter that finds the texts a verification needs: its size is fixed; once it is
#: full it passes every text and only costs time.
FILTER_BITS = 1 << 24
#: Partners of a node that meet one copy of its text.
MEMBERS = 512
#: Bytes of the texts to a partition in which they are sorted.
PART_BYTES = 4 << 20
#: Least sizes of the levels of differences: each about a seventh above the one before.
LEVELS = [0]
while LEVELS[-1] < 1 << 40:
    LEVELS.append(max(LEVELS[-1] + 1, -(-LEVELS[-1] * 115 // 100)))
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.uint64(0xD6E8FEB86659FD93)
SKETCH = "doc_id long, n_shingles long, n_bytes long, words_id binary, registers binary, key long"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; with fewer words, of the whole sequence."""
    out: list[np.ndarray] = []
    buf = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)
    buf = buf + np.uint8(32) * ((buf >= 65) & (buf <= 90))
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = span_hashes(buf, starts, ends)
    grams = h.copy()
    n = len(h)
    with np.errstate(over="ignore"):
        for k in range(1, width):
            grams[: max(0, n - k)] = mix64(grams[: max(0, n - k)] * _SEED + h[k:])
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, at)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            g = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    g = mix64(np.array([g * _SEED + x], np.uint64))[0]
            out.append(np.array([g], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] ^ _B
        part *= _A
        np.minimum(low, part.min(axis=0), out=low)
    u = (low.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: str) -> Column:
    """A key for each band of a column of registers; kept nowhere, as keys are as long as the registers."""
    width = BAND * 2
    return F.array(*(F.xxhash64(F.lit(k), F.substring(registers, k * width + 1, width)) for k in range(REGISTERS // BAND)))


def likely(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of threshold or more is likely enough, jointly over all registers.

    more and less: how many registers of a are above, below those of b.  Set sizes are known, so
    the similarity is the one unknown of the likelihood, which has one maximum.
    """
    total = n_a + n_b
    u, v = n_a / total, n_b / total
    grid = np.linspace(0.0, 1.0, 101)
    grid[-1] = 1 - 1e-9
    scale = (BASE - 1) / BASE

    def loglik(j):
        p = -np.log1p(-np.maximum(u - v * j, 1e-12) * scale) / np.log(BASE)
        q = -np.log1p(-np.maximum(v - u * j, 1e-12) * scale) / np.log(BASE)
        return more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(np.maximum(1 - p - q, 1e-12))

    feasible = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best, above = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    for j in np.append(grid, threshold):
        ll = np.where(j <= feasible + 1e-9, loglik(j), -np.inf)
        best = np.maximum(best, ll)
        if j >= threshold:
            above = np.maximum(above, ll)
    return above >= best - NATS


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64()), ("words_id", pa.binary()), ("registers", pa.binary()), ("key", pa.int64())])
        for ids, texts in text_blocks(batches, 1 << 19):
            texts = [t or b"" for t in texts]
            keys = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
            sets = shingle_sets(texts, width)
            regs = [registers_of(s) if len(s) else None for s in sets]
            words = [hashlib.md5(b"\x20".join(t.lower().split())).digest() if r is not None else None for t, r in zip(texts, regs)]
            yield record_batch(schema, ids, [len(s) for s in sets], [len(t) for t in texts], words, [None if r is None else r.tobytes() for r in regs], keys)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, SKETCH)


def _probable(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose registers (ra, rb) and sizes (na, nb) leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            good = likely(na.astype(float), nb.astype(float), (ra > rb).sum(axis=1), (ra < rb).sum(axis=1), threshold)
            yield record_batch(schema, a[good], b[good])

    return map_arrow(pairs.select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def _needed(docs: DataFrame, ids: DataFrame, width: int | None = None) -> DataFrame:
    """The (id, text) that ids name, and few others: a filter of fixed size goes to the scan, the caller's join does the rest.

    With a width the same map makes shingle sets of the texts, (id, s): a map of its own after this
    one would share its stage, and a task would keep two Python workers.
    """
    spots = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS)) for k in range(2)))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for w, bits in words.toLocalIterator():
        table[w] = bits
    held = table.view(np.uint64)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"), *(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(k)), F.lit(FILTER_BITS)).alias(f"p{k}") for k in range(2)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                p = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                good &= (held[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            if good.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["id", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64()))])
        for keys, texts in text_blocks(named(batches), 1 << 19):
            yield record_batch(schema, keys, [x.view(np.int64) for x in shingle_sets([t or b"" for t in texts], width)])

    found = map_arrow(rows, named, "id long, text binary") if width is None else map_arrow(rows, sets, "id long, s array<long>")
    return found.where("id is not null")


def _small(rows: list[tuple], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts of rows in blocks of bounded size: hashing holds many times a block's bytes."""
    held, size = [], 0
    for _, t in rows:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _confirmed(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * intersection >= num * union; sizes: (id, n_bytes) of texts.

    The text of b is sent once for every MEMBERS of its partners, in front of them, not with each:
    a node with very many partners is split into as many parts, and a task holds one set of b.
    Where each text goes is settled on ids alone, so texts are shuffled twice only, by id and by part.
    """
    leads = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(leads, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("id"))
    first = leads.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("id"))
    routes = staged(first.unionByName(members))
    sent = routes.groupBy("id").agg(F.count("*").alias("k")).join(sizes, "id").agg(F.sum(F.col("k") * F.col("n_bytes"))).first()[0]
    texts = _needed(docs, routes.select("id").distinct())
    met = routes.join(texts, "id").select("b", "part", "side", F.col("id").alias("a"), "text")
    met = met.repartition(max(16, (sent or 0) // PART_BYTES), "b", "part").sortWithinPartitions("b", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        at, own = None, []
        for batch in batches:
            good: list[tuple[int, int]] = []
            held: list[tuple[int, bytes]] = []

            def judge() -> None:
                done = 0
                for part in _small(held):
                    for t in shingle_sets(part, width):
                        for s in own:
                            both_n = len(s) + len(t) - len(np.union1d(s, t)) if len(s) and len(t) else 0
                            if both_n > 0 and den * both_n >= num * (len(s) + len(t) - both_n):
                                good.append((held[done][0], at[0]))
                                break
                        done += 1
                held.clear()

            for b, part, side, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, part) != at:
                    judge()
                    at, own = (b, part), []
                if side == 0:
                    own += shingle_sets([text], width)
                else:
                    held.append((a, text))
            judge()
            if good:
                yield record_batch(schema, *zip(*good))

    return map_arrow(met, run, "a long, b long").distinct()


def _rows(names: list[str], g: int, i: int, c: int, f: int, own, other, e) -> pa.RecordBatch:
    same = [pa.array(np.full(len(e), x, np.int64)) for x in (g, i, c, f)]
    return pa.RecordBatch.from_arrays([*same, pa.array(own, pa.int32()), pa.array(other, pa.int32()), pa.array(e, pa.int64())], names=names)


def _apart(members: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of members (g, id, c) of one group g and two components c that are linked.

    Not by testing all pairs: let C be the shingles that most of a group's sets have, D(x) the
    symmetric difference of x and C, and F(x) = (den - num) |x| - (den + num) |D(x)|.  As the
    symmetric difference of x and y is that of D(x) and D(y), x and y are linked exactly if
    2 (den + num) |D(x) & D(y)| + F(x) + F(y) >= 0.  If F(x) + F(y) >= 0 already, both are linked
    with the node of greatest F, and one link to it stands for all such pairs.  Any other link
    needs common elements of the differences, o = -(F(x) + F(y)) / (2 (den + num)) of them, so by
    the prefix principle one among the first |D| - o + 1 of each, in an order of elements that all
    share: own shingles before missing ones, which are the more common.  o depends on the other's
    |D|, so a node is listed once for each level of that, with a prefix as short as the level
    allows; copies that differ in places of their own then don't meet.
    """
    ids = members.select("id").distinct()
    texts = _needed(docs, ids, width).join(ids, "id", "left_semi").groupBy("id").agg(F.max("s").alias("s"))
    held = staged(members.join(texts, "id"))
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    common = staged(held.select("g", F.explode("s").alias("e")).groupBy("g", "e").agg(F.count("*").alias("k")).join(sizes, "g").where("2 * k > size").groupBy("g").agg(F.collect_list("e").alias("common")))

    def apart_from(own, usual) -> tuple[int, np.ndarray]:
        own, usual = (np.zeros(0, np.int64) if x.as_py() is None else x.values.to_numpy(zero_copy_only=False) for x in (own, usual))
        own = np.unique(own)
        return len(own), np.concatenate([np.setdiff1d(own, usual), np.setdiff1d(usual, own)])

    def f_and_level(n: int, d: np.ndarray) -> tuple[int, int]:
        return (den - num) * n - (den + num) * len(d), int(np.searchsorted(LEVELS, len(d), side="right")) - 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("c", pa.int64()), ("f", pa.int64()), ("own", pa.int32())])
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                n, d = apart_from(batch.column(3)[k], batch.column(4)[k])
                rows.append((*(batch.column(i)[k].as_py() for i in range(3)), *f_and_level(n, d)))
            if rows:
                yield record_batch(schema, *zip(*rows))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, held_ = ["g", "id", "c", "f", "own", "other", "e"], [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: a long text's list is as long as the text
                g, i, c, levels = (batch.column(n)[k].as_py() for n in (0, 1, 2, 5))
                n, d = apart_from(batch.column(3)[k], batch.column(4)[k])
                f, level = f_and_level(n, d)
                slack = n * (den - num) / num  # (den - num) / (den + num) (|x| + |y|) at most, as |y| <= |x| den / num
                lo, hi = (int(np.searchsorted(LEVELS, max(0.0, x), side="right")) - 1 for x in (len(d) - slack, len(d) + slack))
                for other in range(lo, hi + 1):
                    need = max(1, int(np.ceil((len(d) + LEVELS[other] - slack) / 2 - 1e-9)))
                    e = d[: max(0, len(d) - need + 1)]
                    if len(e) and (levels is None or other in levels):
                        out.append(_rows(names, g, i, c, f, np.full(len(e), level, np.int32), np.full(len(e), other, np.int32), e))
                        held_ += len(e)
                if held_ > 1 << 16:
                    yield pa.concat_batches(out)
                    out, held_ = [], 0
        if out:
            yield pa.concat_batches(out)

    size = staged(map_arrow(held.join(common, "g", "left").select("g", "id", "c", "s", "common"), measure, "g long, id long, c long, f long, own int"))
    best = size.groupBy("g").agg(F.max_by(F.struct("id", "c", "f"), F.struct("f", -F.col("id"))).alias("t")).select("g", F.col("t.id").alias("b"), F.col("t.c").alias("cb"), F.col("t.f").alias("fb"))
    near = size.join(best, "g").where("c <> cb and f + fb >= 0").select(F.col("id").alias("a"), "b")
    # nodes of the best node's component are one already: they are listed only for levels at which there are others
    levels = size.join(best, "g").where("c <> cb").groupBy("g").agg(F.collect_set("own").alias("levels"))
    groups = staged(levels.join(best.select("g", "cb"), "g").join(common, "g", "left"))
    listed = held.join(groups, "g").select("g", "id", "c", "s", "common", F.when(F.col("c") == F.col("cb"), F.col("levels")).alias("levels"))
    rows = staged(map_arrow(listed, differ, "g long, id long, c long, f long, own int, other int, e long"))

    x, y = ([F.col(n).alias(n + k) for n in ("id", "c", "f")] for k in "xy")
    # nodes of different levels: the lower one's rows meet the higher one's, so that each row is sent once
    lower = rows.where("own < other").select("g", "e", F.col("own").alias("lo"), F.col("other").alias("hi"), *x)
    higher = rows.where("own > other").select("g", "e", F.col("other").alias("lo"), F.col("own").alias("hi"), *y)
    level = rows.where("own = other").select("g", "e", "own", "id", "c", "f")
    met = [lower.join(higher, ["g", "e", "lo", "hi"]), level.select("g", "e", "own", *x).join(level.select("g", "e", "own", *y), ["g", "e", "own"]).where("idx < idy")]
    linked = [p.where("cx <> cy and fx + fy < 0").select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")) for p in met]
    return near.unionByName(linked[0]).unionByName(linked[1]).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents linked at a Jaccard
    similarity of num / den or more of their distinct word shingles.

    Words: maximal runs without white space, A-Z lower-cased.  Null, empty and blank texts have no
    shingle and are linked with nothing.  Rows with the same doc_id are one node with the links of
    each of its texts; a row without doc_id is linked with nothing, has no component and is kept.
    Empty tables give an empty result; other columns are ignored.
    """
    return _components(docs, width, num, den).select("doc_id", "n_shingles", "component_id", "kept")


def _components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of near_duplicates with words_id (equal words, equal id; null without words) and key (a hash of the text)."""
    threshold = num / den
    every = staged(sketches(docs, width))
    some = every.where("words_id is not null and doc_id is not null")
    nodes = staged(some.groupBy("words_id").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.max("n_bytes").alias("n_bytes"), F.any_value("registers").alias("r")))
    member = nodes.select("id", "n", F.explode(band_keys("r")).alias("key"))
    bucket = staged(member.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
    sizes = nodes.select("id", "n_bytes")
    central = bucket.groupBy("id").agg(F.sum("size").alias("central"))
    leaders = bucket.join(central, "id").groupBy("key").agg(F.max_by(F.struct(F.col("id"), F.col("n")), F.struct("central", -F.col("id"))).alias("top"))
    leaders = leaders.select("key", F.col("top.id").alias("b"), F.col("top.n").alias("nb"))
    sized = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)

    def links(pairs: DataFrame) -> DataFrame:
        ra = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
        rb = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
        return staged(_confirmed(staged(_probable(pairs.join(ra, "a").join(rb, "b"), threshold).distinct()), docs, sizes, width, num, den))

    led = bucket.select(F.col("id").alias("a"), F.col("n").alias("na"), "key").join(leaders, "key")
    first = links(led.where(sized & (F.col("a") != F.col("b"))).select("a", "b").distinct())
    roots = staged(connected_components(first))
    # Buckets in which nodes other than the central one are of more than one component.
    rooted = bucket.join(roots.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    others = rooted.join(leaders.select("key", "b"), "key").where("id <> b")
    mixed = others.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    members = staged(others.join(mixed, "key").select(F.col("b").alias("g"), "id", "c").distinct())
    second = staged(_confirmed(staged(_apart(members, docs, width, num, den)), docs, sizes, width, num, den))
    roots = connected_components(first.unionByName(second))
    names = nodes.select("words_id", "id").join(roots.select(F.col("node").alias("id"), "component"), "id", "left").groupBy("words_id").agg(F.min(F.coalesce("component", "id")).alias("component"))
    out = every.select("doc_id", "n_shingles", "words_id", "key").join(names, "words_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "words_id", "key")


def drop_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id, once.

    Rows with one doc_id but different words are judged each by its own text; those with the same
    words are one, the one with the least hash of its text.  Null, empty and blank texts stay, once
    for each doc_id and text; rows without doc_id all stay; an empty table stays empty; other
    columns, whatever their names and types, are carried.
    """
    found = staged(_components(docs, width, num, den).where("doc_id is not null").select("doc_id", "key", "words_id", "kept"))
    lone = found.where("kept and words_id is not null").groupBy("doc_id", "words_id").agg(F.min("key").alias("one"), F.max("key").alias("last")).where("one < last")
    again = found.join(lone, ["doc_id", "words_id"]).where("key > one").select("doc_id", "key")
    dropped = found.where("not kept").select("doc_id", "key").unionByName(again).distinct().select(F.col("doc_id").alias("id"), "key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))))
    alike = Window.partitionBy("id", "key", F.when(F.col("id").isNull(), F.monotonically_increasing_id())).orderBy("key")
    kept = rows.join(dropped, ["id", "key"], "left_anti").withColumn("n", F.row_number().over(alike)).where("n = 1")
    return kept.select("row.*")


def brute_force(docs: list[tuple], width: int, num: int, den: int) -> list[tuple]:
    """The same rows from all pairs, for tests."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (key, _) in enumerate(docs):
        low[find(i)] = min(key, low.get(find(i), key))
    return [(key, len(sets[i]), low[find(i)], key == low[find(i)]) for i, (key, _) in enumerate(docs)]
