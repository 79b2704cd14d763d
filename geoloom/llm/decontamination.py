"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of documents as one sequence of word numbers: words that no benchmark
item has can't be part of a match and become terminators.  Its suffixes are sorted by prefix
doubling (terminators are unique, so sorting ends at the longest repeat within a document), the
Burrows-Wheeler transform goes into a wavelet matrix, and all distinct benchmark windows are
searched backward at once through its ranks.  Occurrences are located by walking to sampled
suffix positions, and become merged spans of words to remove.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Bytes of benchmark text that one pass over the documents searches; more items make more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of document text in one shard (a longer document is a shard of its own).
SHARD_BYTES = 2 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of words, lower-cased; every other byte a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Sorted suffixes of seq, whose 0s are terminators, each its own smallest symbol by position."""
    n = len(seq)
    key = seq.astype(np.int64)
    alive = key > 0
    g = max(1, 62 // bits)
    for j in range(1, g):
        nxt = np.zeros(n, np.int64)
        if j < n:
            nxt[:-j] = seq[j:]
        nxt[~alive] = 0
        key = (key << bits) | nxt
        alive &= nxt > 0
    sa = np.argsort(key, kind="stable")
    sk = key[sa]
    head = np.ones(n, bool)
    head[1:] = (sk[1:] != sk[:-1]) | ~alive[sa[1:]]
    h = g
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        single = head & np.append(head[1:], True)
        slots = slots[~single]
        if not len(slots):
            return sa
        part = sa[slots]
        key = rank[part] * n + rank[part + h]
        order = np.argsort(key, kind="stable")
        part, key = part[order], key[order]
        sa[slots] = part
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        rank[part] = np.maximum.accumulate(np.where(head, slots, 0))
        h *= 2


class Bits:
    """A bit vector with constant-time ranks, all in whole arrays."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).tobytes(), np.uint64)
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            one = (seq >> shift) & 1 == 1
            self.levels.append((shift, Bits(one), len(seq) - int(one.sum())))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        i, start = i.copy(), np.zeros_like(i)
        for shift, b, zeros in self.levels:
            one = (c >> shift) & 1 == 1
            for x in (i, start):
                r = b.rank(x)
                np.copyto(x, np.where(one, zeros + r, x - r))
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        i, c = i.copy(), np.zeros(len(i), np.int64)
        for shift, b, zeros in self.levels:
            one, r = b.get(i), b.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return c


class FMIndex:
    """Backward search and location over a sequence of word numbers with 0 as terminator."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        bits = max(1, int(sigma - 1).bit_length())
        sa = suffix_array(seq, bits)
        before = seq[sa - 1]
        before[sa == 0] = 0
        self.n = len(seq)
        self.tree = WaveletMatrix(before, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])[:sigma]
        kept = (sa % sample == 0) | (before == 0)
        self.marks, self.samples = Bits(kept), sa[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high) of the rows of windows, all of one length, that occur."""
        which = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[which, j]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: a walk to the next sampled position on its left."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.marks.get(rows)
            out[todo[done]] = self.samples[self.marks.rank(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            c = self.tree.access(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Windows:
    """Distinct windows of a block of items by length, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        by_len: dict[int, dict[tuple, dict[int, None]]] = {}
        for name, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not words:
                continue
            k = number.setdefault(name, len(number))
            if k == len(self.names):
                self.names.append(name)
            for i in range(max(1, len(words) - width + 1)):
                w = tuple(words[i : i + width])
                by_len.setdefault(len(w), {}).setdefault(w, {})[k] = None
        self.by_len = {n: (np.array(list(ws), np.int64), [list(x) for x in ws.values()]) for n, ws in by_len.items()}
        self.sigma = len(self.vocab) + 1


def search_shard(texts: list[bytes], wins: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: number of words, merged spans [start, end) of hit words, items that occur."""
    get = wins.vocab.get
    dtype = np.uint16 if wins.sigma < 1 << 16 else np.int32
    parts, counts = [], []
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        parts.append(np.fromiter([get(w, 0) for w in words] + [0], dtype, len(words) + 1))
    seq = np.concatenate(parts)
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] > 0) | (seq[:-1] > 0)  # one terminator for a run of them
    at = np.flatnonzero(keep)  # place of each kept word, with one terminator place a text
    index = FMIndex(seq[keep].astype(np.int64), wins.sigma)
    edges = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    cover = np.zeros(len(seq) + 1, np.int32)
    for n, (windows, owners) in wins.by_len.items():
        which, lo, hi = index.search(windows)
        if not len(which):
            continue
        sizes = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        place = at[index.locate(rows)]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + n, -1)
        doc = np.searchsorted(edges, place, side="right") - 1
        pairs = np.unique(np.repeat(which, sizes) * len(texts) + doc)
        for w, d in zip((pairs // len(texts)).tolist(), (pairs % len(texts)).tolist()):
            found[d].update(wins.names[k] for k in owners[w])
    hit = np.cumsum(cover) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        d = int(np.searchsorted(edges, a, side="right")) - 1
        spans[d].append((a - int(edges[d]), b - int(edges[d])))
    return counts, spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Flat [start, end, ...] in characters of merged spans of words."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    at = np.array([x for a, b in spans for x in (places[a][0], places[b - 1][1])])
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that start a character
    return np.concatenate([[0], np.cumsum(first)])[at].tolist()


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; the caller keeps them all, as the plan does: the whole benchmark."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary")).where("text is not null")
    for name, text in rows.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((name, bytes(text)))
        held += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items array<string> (sorted), word_spans and char_spans
    (flat arrays [start, end, ...] of merged removal spans); with carry, instead, _row (all columns
    of docs as they are) and _spans (those in characters).

    Documents stream through one narrow map, whose task meets a shard with one block of items after
    the other: no shuffle, and it holds a shard and the windows of the benchmark.  Null texts have no words; empty items and null item texts
    match nothing; rows with the same item_id are one item; a null item_id is called null;
    repeated documents give repeated rows; empty tables and other columns are fine.
    """
    extra = docs.columns if carry else []
    key, text = F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("binary").alias("_text")
    rows = docs.select(key, text, *(F.col(c).alias(f"x_{i}") for i, c in enumerate(extra)))
    fields = [T.StructField(f"x_{i}", docs.schema[c].dataType) for i, c in enumerate(extra)]
    out = T._parse_datatype_string(_FINAL)
    rows = map_arrow(rows, _pass(list(benchmark_blocks(benchmark, block_bytes)), width), T.StructType(out.fields + fields))
    found = ["n_words", "n_hit", "n_items", "items", "word_spans", "char_spans"]
    return rows.select(F.struct(*(F.col(f"x_{i}").alias(c) for i, c in enumerate(extra))).alias("_row"), F.col("char_spans").alias("_spans")) if carry else rows.select(F.col("_doc_id").alias("doc_id"), *found)


_FINAL = "_doc_id long, n_words long, n_hit long, n_items long, items array<string>, word_spans array<int>, char_spans array<int>"


def _pass(blocks: list[list], width: int):
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                n = batch.column(1).nbytes
                if held and size + n > SHARD_BYTES:
                    yield pa.concat_batches(held)
                    held, size = [], 0
                held.append(batch)
                size += n
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins = [Windows(block, width) for block in blocks]
        for shard in shards(batches):
            texts = [t or b"" for t in shard.column(1).to_pylist()]
            counts, spans, found = search_shard(texts, wins[0])
            for w in wins[1:]:
                _, more, items = search_shard(texts, w)
                spans = [merged(s + m) for s, m in zip(spans, more)]
                found = [f | i for f, i in zip(found, items)]
            flat, items = [[x for s in sp for x in s] for sp in spans], [sorted(f) for f in found]
            new = [("n_words", pa.array(counts, pa.int64())), ("n_hit", pa.array([sum(b - a for a, b in sp) for sp in spans], pa.int64())), ("n_items", pa.array(map(len, items), pa.int64())), ("items", pa.array(items, strings)), ("word_spans", pa.array(flat, ints)), ("char_spans", pa.array(map(char_spans, texts, spans), ints))]
            carried = [(n, shard.column(k)) for k, n in enumerate(shard.schema.names) if n.startswith("x_")]
            columns = [("_doc_id", shard.column(0)), *new, *carried]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return run


def remove_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with the removal spans cut out of their texts; other texts stay as they are.

    A null text stays null; rows without doc_id and repeated rows are cut each by itself; empty
    tables of documents or items change nothing; other columns, whatever their names, are carried.
    """
    found = decontaminate(docs, benchmark, width, carry=True)
    hit, cut = F.size("_spans") > 0, F.expr(
        """concat(array_join(transform(sequence(0, size(_spans) div 2 - 1), i ->
        substring(_text, if(i = 0, 0, _spans[greatest(2 * i - 1, 0)]) + 1, _spans[2 * i] - if(i = 0, 0, _spans[greatest(2 * i - 1, 0)]))), ''),
        substring(_text, _spans[size(_spans) - 1] + 1))"""
    )
    found = found.withColumn("_text", F.col("_row.text").cast("string")).withColumn("_cut", F.when(hit, cut).otherwise(F.col("_text")))
    new = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_cut").cast("long")).otherwise(F.col("_row.n_chars"))
    return found.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """The same rows from nested loops, for tests."""
    out = []
    for key, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        hit, names = set(), set()
        for name, item in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in item or ""))
            for i in range(max(1, len(w) - width + 1) if w else 0):
                x = w[i : i + width]
                for p in range(len(words) - len(x) + 1):
                    if words[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        names.add(str(name))
        listed = ",".join(sorted(names))
        out.append((key, len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out
