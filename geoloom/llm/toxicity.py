"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

A word is compared with a landmark word by the letters they have in the same order within a short
span, each gap at a price: inserted characters and spaced-out insults stay close to the plain
form.  The machine is trained on words of labelled sentences through landmarks (its explicit
Nystroem features), and its decision function folds into one weight for each letter triple, so a
word costs a few gathers whatever the number of landmarks.  A text's score is a calibrated
function of its most suspicious words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, keyed_texts, record_batch, text_blocks

#: Bound of the fit: labelled rows with a toxic and with a clean label that are used, lowest hash
#: first, and bytes of their texts; one task holds them.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1500, 2500, 48 << 20
#: Landmarks, words used as negatives, price of a place in a span, longest span.
LANDMARKS, NEGATIVES, DECAY, SPAN = 320, 12000, 0.6, 6
#: Words whose value a worker keeps.
CACHE = 100_000
SIGMA, EDGE, GAP = 32, 0, 31
#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"})
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, words array<string>"
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


def _symbols() -> np.ndarray:
    table = np.full(0x110000, GAP, np.uint8)
    for c in range(128, 0x3000):
        if chr(c).isalpha():
            table[c] = 27 + c % 4
    table[0x3000:0xE000] = 30
    for k in range(26):
        table[97 + k] = k + 1
    table[0x7F] = EDGE  # a mark put before and after each word
    return table


_TABLE = _symbols()
_TRIPLE = np.arange(SIGMA**3)
VALID = ((_TRIPLE // 1024 != GAP) & (_TRIPLE // 32 % 32 != GAP) & (_TRIPLE % 32 != GAP) & ~((_TRIPLE // 1024 == EDGE) & (_TRIPLE // 32 % 32 == EDGE))).astype(np.float32)


def words_of(text: str) -> list[str]:
    """Lower-case words, and runs of three or more single characters as one word more."""
    tokens = text.lower().translate(LEET).split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(single) >= 3:
        run: list[int] = []
        extra = []
        for i in [*single, -9]:
            if run and i != run[-1] + 1:
                if len(run) >= 3:
                    extra.append("".join(tokens[k] for k in run))
                run = []
            run.append(i)
        tokens += extra
    return tokens


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, a mark around each and a gap as long as a span after it; where each starts."""
    tail = "\x7f" + "\x00" * SPAN
    text = "".join(["\x7f" + w + tail for w in words]) + "\x00" * SPAN
    sym = _TABLE[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2 + SPAN
    return sym.astype(np.int32), np.concatenate([[0], np.cumsum(lens)[:-1]])


def word_values(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word."""
    if not words:
        return np.zeros(0)
    sym, starts = _positions(words)
    n = len(sym) - SPAN
    dot, norm = np.zeros(n, np.float32), np.zeros(n, np.float32)
    first = sym[:n] * 1024
    for a, b in STEPS:
        t = first + sym[a : n + a] * 32 + sym[a + b : n + a + b]
        w = np.float32(DECAY ** (a + b))
        dot += w * weight[t]
        norm += w * w * VALID[t]
    return np.add.reduceat(dot, starts).astype(np.float64) / np.sqrt(np.maximum(np.add.reduceat(norm, starts), 1e-6)) + bias


def word_features(words: list[str]) -> np.ndarray:
    """Normalised subsequence features, one row a word (for landmarks and training words)."""
    sym, starts = _positions(words)
    n = len(sym) - SPAN
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    out, norm = np.zeros((len(words), SIGMA**3), np.float32), np.zeros(len(words))
    for a, b in STEPS:
        t = sym[:n] * 1024 + sym[a : n + a] * 32 + sym[a + b : n + a + b]
        w = DECAY ** (a + b)
        np.add.at(out, (owner, t), np.float32(w) * VALID[t])
        np.add.at(norm, owner, w * w * VALID[t])
    out /= np.sqrt(np.maximum(norm, 1e-6))[:, None].astype(np.float32)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the active rows, which are read in blocks."""
    n = x.shape[1] + 1
    reg = np.eye(n)
    reg[-1, -1] = 1e-3
    w, before = np.zeros(n), None
    blocks = [slice(i, i + 1024) for i in range(0, len(x), 1024)]
    wide = lambda b: np.hstack([x[b].astype(np.float64), np.ones((len(x[b]), 1))])
    for _ in range(rounds):
        active = np.concatenate([y[b] * (wide(b) @ w) < 1 for b in blocks])
        if before is not None and (active == before).all():
            break
        before = active
        left, right = reg.copy(), np.zeros(n)
        for b in blocks:
            xb = wide(b)[active[b]]
            left += xb.T @ (xb * cost[b][active[b], None])
            right += xb.T @ (cost[b] * y[b])[active[b]]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-4, atol=1e-4):
            break
        w = new
    return w[:-1], float(w[-1])


def cover(bags: list[set[str]], counts: Counter, ratio, depth: int = 2) -> list[tuple[str, int]]:
    """Words that explain the toxic texts, and how many each explains: greedily the best word for
    the texts that have fewer than depth such words yet, until no word explains two more."""
    odds = {w: float(np.log(ratio(w))) for w, n in counts.items() if n >= 3 and len(w) > 2 and ratio(w) >= 6}
    holds: dict[str, set[int]] = {}
    for k, bag in enumerate(bags):
        for w in bag & odds.keys():
            holds.setdefault(w, set()).add(k)
    need = [depth] * len(bags)
    out: list[tuple[str, int]] = []
    while holds:
        best = max(holds, key=lambda w: (len(holds[w]) * odds[w], w))
        mine = holds.pop(best)
        if len(mine) < 3:
            break
        out.append((best, len(mine)))
        for k in mine:
            need[k] -= 1
            if not need[k]:
                for w in bags[k] & holds.keys():
                    holds[w].discard(k)
    return out


def summary(values: np.ndarray, n_words: int) -> list[float]:
    """What of a text's words its score depends on: the three highest, and how many there are."""
    top = np.full(3, -2.0)
    if len(values):
        best = np.sort(values)[::-1][:3]
        top[: len(best)] = best
    return [*np.clip(top, -2, 2), float((values > 0).sum() > 0), np.log1p(n_words)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = 0.05 * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(reg + (x1 * (p * (1 - p))[:, None]).T @ x1, x1.T @ (y - p) - reg @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Folded triple weights and bias of the machine, and the calibration of a text's score."""

    def __init__(self, weight: np.ndarray | None = None, bias: float = -1.0, calibration: np.ndarray | None = None):
        self.weight = np.zeros(SIGMA**3, np.float32) if weight is None else weight
        self.bias = bias
        self.calibration = np.array([0.0] * 5 + [-3.0]) if calibration is None else calibration

    @classmethod
    def trained(cls, rows: list[tuple[str, int]]) -> Model:
        model = cls()
        same: dict[str, str] = {}  # one string a word, however many texts have it
        texts, y = [[same.setdefault(w, w) for w in words_of(t)] for t, _ in rows], np.array([v for _, v in rows])
        if len(y):
            model.calibration[-1] = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        if not len(y) or y.min() == y.max():
            return model
        # machine and calibration see different halves, so the calibration isn't fooled by memory
        half = np.arange(len(rows)) % 2 == 0
        model._machine([t for t, h in zip(texts, half) if h], y[half])
        x = np.array([summary(word_values(list(dict.fromkeys(t)), model.weight, model.bias), len(t)) for t, h in zip(texts, half) if not h])
        if y[~half].min() != y[~half].max():
            model.calibration = logistic(x, y[~half])
        model._machine(texts, y)
        return model

    def _machine(self, texts: list[list[str]], y: np.ndarray) -> None:
        toxic, clean = Counter(), Counter()
        for words, label in zip(texts, y):
            (toxic if label else clean).update(set(words))
        nt, nc = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        ratio = lambda w: ((toxic[w] + 0.5) / nt) / ((clean[w] + 0.5) / nc)
        pos = cover([set(w) for w, label in zip(texts, y) if label], toxic, ratio)
        if not pos:
            return
        marks = [w for w, _ in pos][: LANDMARKS // 2]
        chosen = {w for w, _ in pos}
        pool = sorted((w for w in clean if w not in chosen and ratio(w) < 3), key=lambda w: (-min(clean[w], 3), zlib.crc32(w.encode()), w))
        neg = pool[:NEGATIVES]
        # landmarks of the other side: the negatives nearest to the insults, and common words
        phi_pos = word_features(marks)
        near = np.concatenate([(word_features(neg[i : i + 50]) @ phi_pos.T).max(axis=1) for i in range(0, len(neg), 50)]) if neg else np.zeros(0)
        rest = LANDMARKS - len(marks)
        marks = list(dict.fromkeys(marks + [neg[i] for i in np.argsort(-near, kind="stable")[: rest * 3 // 4]] + neg[: rest // 4]))
        phi = word_features(marks)
        lam, u = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        keep = lam > 1e-4 * lam[-1]
        root = u[:, keep] / np.sqrt(lam[keep])
        root32 = root.astype(np.float32)
        explicit = lambda ws: np.concatenate([word_features(ws[i : i + 50]) @ phi.T @ root32 for i in range(0, len(ws), 50)])
        x_pos, weight = explicit([w for w, _ in pos]), np.sqrt(np.array([n for _, n in pos], float))
        for _ in range(3):
            x = np.concatenate([x_pos, explicit(neg)]) if neg else x_pos
            label = np.array([1.0] * len(pos) + [-1.0] * len(neg))
            w, self.bias = svm(x, label, np.concatenate([30 * weight, np.full(len(neg), 10.0)]))
            self.weight = (root @ w).astype(np.float32) @ phi
            # negatives of the next round: those of the whole pool that come nearest to being called insults
            value = np.concatenate([word_values(pool[i : i + 4000], self.weight, self.bias) for i in range(0, len(pool), 4000)]) if pool else np.zeros(0)
            hard = [pool[i] for i in np.argsort(-value, kind="stable")[: NEGATIVES // 4] if value[i] > -1]
            neg = list(dict.fromkeys(neg + hard))

    def scores(self, texts: list[str], cache: dict[str, float]) -> tuple[np.ndarray, list[list[str]]]:
        docs = [words_of(t) for t in texts]
        sets = [list(dict.fromkeys(d)) for d in docs]
        new = list({w for s in sets for w in s}.difference(cache))
        for i in range(0, len(new), 8000):
            part = new[i : i + 8000]
            cache.update(zip(part, word_values(part, self.weight, self.bias).tolist()))
        x, found = [], []
        for words, d in zip(sets, docs):
            v = np.fromiter((cache[w] for w in words), np.float64, len(words))
            x.append(summary(v, len(d)))
            found.append([words[i] for i in np.flatnonzero(v > 0).tolist()])
        z = np.hstack([np.array(x).reshape(len(docs), 5), np.ones((len(docs), 1))]) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), found


def held_out(column: str = "doc_id"):
    """The rows that nothing is learned from; a row without an id is not one of them."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train, in one task, on a bounded sample of labelled rows that aren't held out.

    The lowest hashes of each label are taken, TRAIN_TOXIC and TRAIN_CLEAN ids at most, and their
    texts in that order up to TRAIN_BYTES.  Only the folded weights come to the driver.  Null
    labels, ids and labels other than 0 and 1 are left out, a null text is empty, an id with both
    labels counts in both samples, and empty tables give a machine that knows nothing.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    order = F.crc32(F.concat(F.lit("train"), F.col("doc_id").cast("string")).cast("binary"))
    pick = lambda label, n: marked.where(F.col("toxic") == label).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(n)
    chosen = pick(1, TRAIN_TOXIC).unionByName(pick(0, TRAIN_CLEAN))
    rows = keyed_texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("at"), "doc_id")
    one = rows.repartition(1).sortWithinPartitions("at", "doc_id", "text", "toxic").select("text", "toxic")
    row = map_arrow(one, _fitted, "weight binary, bias double, calibration binary").first()
    return Model() if row is None else Model(np.frombuffer(bytes(row[0]), np.float32), row[1], np.frombuffer(bytes(row[2]), np.float64))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size += len(text or "")
            if size <= TRAIN_BYTES:
                rows.append((text or "", toxic))
    model = Model.trained(rows)
    schema = pa.schema([("weight", pa.binary()), ("bias", pa.float64()), ("calibration", pa.binary())])
    yield record_batch(schema, [model.weight.tobytes()], [float(model.bias)], [model.calibration.tobytes()])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the suspicious words, for every whole text.

    Null and empty texts get the calibrated score of a text without words; repeated rows give
    repeated results; an empty table gives an empty result; no other column is read.  A narrow
    map; the model is a few hundred kB, whatever the corpus.  Without labels of both kinds every
    text gets the share of toxic labels seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("words", pa.list_(pa.string()))])
        cache: dict[str, float] = {}
        for ids, texts in text_blocks(batches, 1 << 19):
            if len(cache) > CACHE:
                cache.clear()
            s, found = model.scores(texts, cache)
            yield record_batch(schema, ids, [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids], s, (s >= 0.5).astype(np.int32), found)

    return map_arrow(keyed_texts(docs), run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't called toxic.

    A null text is scored as empty and stays null; rows without doc_id and repeated rows are judged
    like any other; an empty table stays empty; other columns, whatever their names, are carried.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows:
                if len(cache) > CACHE:
                    cache.clear()
                s, _ = model.scores([t or "" for t in batch.column(at).to_pylist()], cache)
                yield batch.filter(pa.array(s < 0.5))

    return map_arrow(docs, run, docs.schema)


def digest(scored: DataFrame) -> DataFrame:
    """The columns of the query."""
    return scored.select("doc_id", "held_out", "score", "predicted")
