"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a block are one array of code points.  A class table turns them into symbols of a small
automaton; every symbol is a function from state to state, functions compose associatively, and
a blocked prefix scan over their finite monoid gives the state before each code point, hence the
match boundaries of the pre-tokenising pattern, without any regular expression.  The slices go
through a cached pair merge; token lengths and offsets are kept, and decoding gathers the bytes
of all tokens of a block at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, map_arrow, record_batch, text_blocks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"

# Code-point classes.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
# Symbols of the automaton: a class with what the next code points tell.
S_L, S_N, S_O, S_Q1, S_Q2, S_WIN, S_BLANK, S_WLAST = range(8)
# States: nothing open, or the kind of match that is.
CLOSED, IN_L, IN_N, IN_O, IN_W, PREFIX, LEFT1, LEFT2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a match starts at this symbol)."""
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return CLOSED, False
    run = {S_L: IN_L, S_N: IN_N, S_O: IN_O}.get(symbol)
    if run is not None:
        return run, state not in (run, PREFIX)
    if symbol in (S_Q1, S_Q2):  # a quote with a contraction's letters after it
        if state in (IN_O, PREFIX):
            return IN_O, False
        return (LEFT1 if symbol == S_Q1 else LEFT2), True
    if symbol == S_WIN:  # white space that more white space or the end follows
        return IN_W, state != IN_W
    return (PREFIX if symbol == S_BLANK else CLOSED), True  # the last of its run


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generators (symbols, then symbols that start a text), composition, application, boundaries."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)]
    gens += [(_step(CLOSED, y)[0],) * 8 for y in range(8)]
    known = {g: k for k, g in enumerate(dict.fromkeys(gens))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in dict.fromkeys(gens):
            h = tuple(g[f[s]] for s in range(8))
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    fs = list(known)
    compose = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in fs] for f in fs], np.uint16)
    starts = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])
    return np.array([known[g] for g in gens], np.uint16), compose, np.array(fs, np.uint8), starts


def states_after(symbols: np.ndarray, gen: np.ndarray, compose: np.ndarray, apply: np.ndarray) -> np.ndarray:
    """State after each symbol, by a blocked associative scan; symbols of 8 up start a text."""
    n = len(symbols)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint16)
    f[:n] = gen[symbols]
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    m = compose.shape[1]
    flat = compose.ravel()
    for j in range(1, width):
        f[j] = flat[f[j - 1].astype(np.int32) * m + f[j]]
    into = np.zeros(rows, np.uint8)
    state = CLOSED
    for k, g in enumerate(f[-1].tolist()):
        into[k] = state
        state = int(apply[g, state])
    return apply[f, into[None, :]].T.reshape(-1)[:n]


class Codec:
    """Ranks, class table and caches of one vocabulary; one per Python worker."""

    #: Entries of each of the two generations of the piece cache.
    CACHE = 130_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, r in self.ranks.items():
            words[r] = w
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.classes = self._class_table()
        self.gen, self.compose, self.apply, self.bounds = _monoid()
        self.cache = self.CACHE
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    @staticmethod
    def _class_table() -> np.ndarray:
        """Letter, number and space as the reference library's own engine has them, for its Unicode version."""
        import tiktoken

        table = np.full(0x110000, OTHER, np.uint8)
        single = {bytes([i]): i for i in range(256)}
        for cls, pat in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            engine = tiktoken.Encoding(f"class{cls}", pat_str=pat, mergeable_ranks=single, special_tokens={})
            for lo in chain(range(0, 0xD800, 0x800), range(0xE000, 0x110000, 0x800)):  # in slices: ids take many times a text's bytes
                got = bytes(engine.encode_ordinary("".join(map(chr, range(lo, lo + 0x800))))).decode()
                table[np.frombuffer(got.encode("utf-32-le"), np.uint32)] = cls
        table[0x20] = BLANK
        table[0x27] = QUOTE
        return table

    def boundaries(self, cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Indexes of code points at which a match starts; firsts: where non-empty texts start."""
        n = len(cps)
        cls = self.classes[cps]
        is_first = np.zeros(n + 3, bool)
        is_first[firsts] = True
        is_first[n:] = True
        white = (cls == SPACE) | (cls == BLANK)
        more = np.zeros(n, bool)
        more[:-1] = white[1:]
        more |= is_first[1 : n + 1]  # the end of a text counts as white space
        sym = np.array([S_L, S_N, S_O, S_WLAST, S_BLANK, S_O], np.uint8)[cls]
        sym[white & more] = S_WIN
        q = np.flatnonzero((cls == QUOTE) & ~is_first[1 : n + 1])
        if len(q):
            pad = np.concatenate([cps, np.zeros(2, cps.dtype)])
            one, two = pad[q + 1], np.where(is_first[q + 2], 0, pad[q + 2])
            sym[q[np.isin(one, [ord(c) for c in "stmd"])]] = S_Q1
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            sym[q[pair]] = S_Q2
        after = states_after(sym + np.uint8(8) * is_first[:n], self.gen, self.compose, self.apply)
        before = np.empty(n, np.uint8)
        before[0] = CLOSED
        before[1:] = after[:-1]
        before[is_first[:n]] = CLOSED
        return np.flatnonzero(self.bounds[before, sym])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: the lowest rank first, leftmost among equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= 48:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            rs = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
            while rs and (low := min(rs)) < 1 << 30:
                i = rs.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del rs[i]
                if i < len(rs):
                    rs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
                if i:
                    rs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            return [ranks[p] for p in parts]
        n = len(piece)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != e:  # one of the two has been merged meanwhile
                continue
            alive[j], end[i], nxt[i] = 0, e, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _missed(self, piece: bytes) -> tuple:
        found = self.old.get(piece)
        if found is None:
            ids = self.merge(piece)
            found = (tuple(ids), ",".join(map(str, ids)).encode())
        if len(piece) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, texts: list[str]) -> tuple[list[tuple], np.ndarray]:
        """((ids, their decimals) of each piece, number of pieces before each text and at the end)."""
        text = "".join(texts)
        if not text:
            return [], np.zeros(len(texts) + 1, np.int64)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(lens)])
        cuts = self.boundaries(cps, edges[:-1][lens > 0])
        width = 1 + (cps >= 0x80) + (cps >= 0x800).astype(np.int64) + (cps >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        buf = text.encode()
        where = at[np.append(cuts, len(cps))].tolist()
        young, missed = self.young, self._missed
        out = []
        for i, j in zip(where, where[1:]):
            piece = buf[i:j]
            got = young.get(piece)
            if got is None:
                got = missed(piece)
                young = self.young
            out.append(got)
        return out, np.searchsorted(cuts, edges)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, offset of each token and the end): gathered in one step."""
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        offsets = np.concatenate([[0], ends])
        index = np.arange(offsets[-1]) + np.repeat(self.starts[ids] - offsets[:-1], lens)
        return self.bytes[index], offsets


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, ranks_path: str, with_ids: bool = False, cache: int = Codec.CACHE) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests; with_ids adds the real outputs
    (ids array<int>, offsets array<long> of the tokens in the decoded bytes, decoded string).

    Null texts count as empty (0 tokens, digests of nothing); repeated rows give repeated results;
    an empty table gives an empty result; other columns are ignored.  A narrow map, no shuffle;
    cache bounds the pieces that a worker remembers, twice.
    """
    schema = SCHEMA + (", ids array<int>, offsets array<long>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_pieces", pa.int64())]
        if with_ids:
            fields += [("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("decoded", pa.string())]
        out = pa.schema(fields)
        c = codec(ranks_path)
        c.cache = cache
        for keys, texts in text_blocks(batches, 1 << 19):
            pieces, edges = c.encode(texts)
            counts = np.fromiter((len(p[0]) for p in pieces), np.int64, len(pieces))
            ids = np.fromiter(chain.from_iterable(p[0] for p in pieces), np.int64, int(counts.sum()))
            decimals = [p[1] for p in pieces]
            before = np.concatenate([[0], np.cumsum(counts)])[edges]
            data, offsets = c.decode(ids)
            rows: list[tuple] = []
            for k, key in enumerate(keys):
                a, b = int(before[k]), int(before[k + 1])
                own = data[offsets[a] : offsets[b]].tobytes()
                row = (key, b - a, hashlib.sha256(b",".join(decimals[edges[k] : edges[k + 1]])).hexdigest(), hashlib.sha256(own).hexdigest(), int(edges[k + 1] - edges[k]))
                rows.append(row + ((ids[a:b].tolist(), (offsets[a:b] - offsets[a]).tolist(), own.decode()) if with_ids else ()))
            yield record_batch(out, *zip(*rows))

    return map_arrow(keyed_texts(docs), run, schema)
