"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The vocabulary of training tokens is counted over the whole corpus and may be of any size.  Its
most frequent words, whose number grows with the fourth root of the vocabulary, are classes of the
model with vectors of their own; all others share classes by their ending, and within such a class
have their smoothed relative frequency, so the model is normalised over every token.  A class is
predicted from the two classes before it: bilinear scores of their vectors.  A pilot model is
trained on a bounded sample.  From it a model is trained on each shard of the training texts, which
are dealt by hash, so it doesn't matter how the table is partitioned; parameters are averaged by
tokens.  Scoring normalises each distinct context of a block once, by batched matrix products.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, staged, text_blocks

#: Words with a class of their own for each unit of the vocabulary's fourth root, classes of other
#: words by ending, size of the vectors.
WORDS_A_ROOT, ENDINGS, WIDTH = 10, 64, 32
#: Frequent tokens whose counts every worker holds; the others' counts are joined.
HEAD = 300_000
#: Texts the pilot model is trained on (lowest hashes of ids), their bytes at most, its passes.
PILOT_TEXTS, PILOT_BYTES, PILOT_PASSES = 1500, 16 << 20, 3
#: Noise samples of a batch, its tokens, step size; tokens of a shard of the training texts.
NOISE, BATCH, STEP, SHARD_TOKENS = 64, 2048, 0.15, 3_000_000
#: Tokens a counting task holds before it hands on partial counts.
HELD = 400_000
#: Averages of parameters are taken in groups of so many, level by level.
FAN = 32
END = b""

def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words of all texts, their ending classes, words before each text and at the end)."""
    buf = np.frombuffer(b"\x20".join(texts).lower() + b"\x20", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    before = np.where(space, np.uint8(32), buf)
    last, second = before[ends - 1].astype(np.int64), np.where(ends >= 2, before[ends - 2], 32).astype(np.int64)
    words = buf.tobytes().split()
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, (second * 31 + last) % ENDINGS, np.searchsorted(ends, at)


def ending(word: bytes) -> int:
    return ((word[-2] if len(word) > 1 else 32) * 31 + word[-1]) % ENDINGS


def count_training(docs: DataFrame) -> DataFrame:
    """(token, ending, c): counts over all training texts, combined in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.binary()), ("ending", pa.int32()), ("c", pa.int64())])
        held: Counter = Counter()

        def out():
            return record_batch(schema, list(held), [-1 if w == END else ending(w) for w in held], list(held.values()))

        for _, texts in text_blocks(batches, 1 << 20):
            for t in texts:
                held.update((t or b"").lower().split())
            held[END] += len(texts)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return map_arrow(training(docs), run, "token binary, ending int, c long").groupBy("token", "ending").agg(F.sum("c").alias("c"))


def is_held_out():
    """Texts that nothing is learned from; a text without an id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(True))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def training(docs: DataFrame) -> DataFrame:
    return _keyed(docs.where(~is_held_out()))


class LogBilinear:
    """p(class | two classes before) from bilinear scores; all parameters in one float32 vector."""

    def __init__(self, flat: np.ndarray, unigram: np.ndarray):
        self.flat, self.unigram, self.classes = flat, unigram, len(unigram)
        n = self.classes * WIDTH
        self.r1, self.r2, self.q = (flat[k * n : (k + 1) * n].reshape(self.classes, WIDTH) for k in range(3))
        self.b = flat[3 * n :]

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        size = len(unigram)
        flat = (0.1 * np.random.default_rng(5).standard_normal(size * (3 * WIDTH + 1))).astype(np.float32)
        flat[-size:] = np.log(unigram)
        return cls(flat, unigram)

    def train(self, seq: np.ndarray, tokens: np.ndarray, rng: np.random.Generator, state: np.ndarray) -> None:
        """One pass of noise-contrastive steps over the tokens of a class sequence, given by position; state: squared gradients so far."""
        noise_log = np.log(NOISE * self.unigram).astype(np.float32)
        order = rng.permutation(tokens)
        views = LogBilinear(state, self.unigram)
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            t, c1, c2 = seq[at], seq[at - 1], seq[at - 2]
            noise = rng.choice(self.classes, NOISE, p=self.unigram)
            h = self.r1[c1] + self.r2[c2]
            qt, qn = self.q[t], self.q[noise]
            real = np.einsum("ij,ij->i", h, qt) + self.b[t] - noise_log[t]
            fake = h @ qn.T + (self.b[noise] - noise_log[noise])
            et = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # 1 - p(data)
            en = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
            dh = et[:, None] * qt + en @ qn
            for table, sq, rows, grad in (
                (self.r1, views.r1, c1, dh),
                (self.r2, views.r2, c2, dh),
                (self.q, views.q, t, et[:, None] * h),
                (self.q, views.q, noise, en.T @ h),
                (self.b, views.b, t, et),
                (self.b, views.b, noise, en.sum(axis=0)),
            ):
                by = np.argsort(rows, kind="stable")
                sorted_rows = rows[by]
                first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                g, k = np.add.reduceat(grad[by], first, axis=0), sorted_rows[first]
                sq[k] += g * g
                table[k] += np.float32(STEP) * g / np.sqrt(sq[k] + np.float32(1e-2))

    def logs(self, seq: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class from the third on, given the two before it."""
        code = seq[1:-1].astype(np.int64) * self.classes + seq[:-2]
        contexts, which = np.unique(code, return_inverse=True)
        h = self.r1[contexts // self.classes] + self.r2[contexts % self.classes]
        norm = np.empty(len(contexts), np.float32)
        for i in range(0, len(contexts), 4096):
            s = h[i : i + 4096] @ self.q.T
            s += self.b
            top = s.max(axis=1)
            s -= top[:, None]
            norm[i : i + 4096] = top + np.log(np.exp(s, out=s).sum(axis=1))
        out = np.empty(len(code))
        for i in range(0, len(code), 65536):
            w, t = which[i : i + 65536], seq[2 + i : 2 + i + 65536]
            out[i : i + 65536] = np.einsum("ij,ij->i", h[w], self.q[t]) + self.b[t] - norm[w]
        return out


class Vocabulary:
    """Counts of the head, classes of words, and the mass of each ending's class."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, mass: np.ndarray, class_counts: np.ndarray):
        self.words = [w for w, _ in head]
        self.counts = np.array([c for _, c in head], np.int64)
        self.total, self.distinct, self.mass = total, distinct, mass
        self.unigram = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.n_words = len(class_counts) - 1 - ENDINGS  # classes: words, end, endings

    def ready(self) -> Vocabulary:
        """Look-ups, made in each worker: a token's place in the head, its class, its logarithms."""
        if not hasattr(self, "index"):
            self.index = {w: k for k, w in enumerate(self.words)}
            self.classes = np.array([self.class_of(w, k) for k, w in enumerate(self.words)], np.int32).reshape(-1)
            self.logs = np.log10(self.counts + 0.5)
        return self

    def class_of(self, word: bytes, place: int) -> int:
        return self.n_words if word == END else place if place < self.n_words else self.n_words + 1 + ending(word)

    def sequence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(classes with two ends before each text, tokens' positions in them, places in the head or -1, text of each token, words, tokens' word or -1).

        The end of a text is the first of the two ends before the next, so a text's first token never sees another text.
        """
        words, endings, edges = tokens_of(texts)
        get = self.index.get
        place = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        n = np.diff(edges)
        ends = np.cumsum(n + 1) - 1
        total = len(words) + len(texts)
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        places, classes, origin = np.full(total, self.index.get(END, -1)), np.full(total, self.n_words, np.int32), np.full(total, -1)
        places[~is_end] = place
        own = np.where(place >= 0, self.classes[place] if len(self.classes) else 0, self.n_words + 1 + endings)
        classes[~is_end] = own
        origin[~is_end] = np.arange(len(words))
        owner = np.repeat(np.arange(len(texts)), n + 1)
        tokens = np.arange(total) + owner + 2
        seq = np.full(total + len(texts) + 1, self.n_words, np.int32)
        seq[tokens] = classes
        return seq, tokens, places, owner, words, origin


def _vocabulary(counts: DataFrame) -> Vocabulary:
    n_distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    # the least count whose tokens all fit into the head: from a histogram of counts, whose size is bounded
    shape = sorted(counts.groupBy(F.least("c", F.lit(5000)).alias("c")).count().collect(), reverse=True)
    held, least = 0, 5001
    for c, n in shape:
        if held + n > HEAD:
            break
        held, least = held + n, c
    if least > 5000:
        top = counts.orderBy(F.desc("c"), "token").limit(HEAD)
    else:
        top = counts.where(F.col("c") >= least)
    head = sorted(((bytes(t), c) for t, c in top.select("token", "c").collect()), key=lambda x: (-x[1], x[0]))
    n_words = int(WORDS_A_ROOT * n_distinct**0.25)
    words = [x for x in head if x[0] != END][:n_words]
    ends = [x for x in head if x[0] == END]
    head = words + [x for x in head if x[0] != END][n_words:] + ends
    n_end = ends[0][1] if ends else counts.where(F.col("token") == F.lit(b"")).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    mass, used = np.full(ENDINGS, 0.5), np.zeros(ENDINGS)
    for e, m, c in counts.where("ending >= 0").groupBy("ending").agg(F.sum(F.col("c") + 0.5), F.sum("c")).collect():
        mass[e] += m
        used[e] += c
    for w, c in words:
        mass[ending(w)] -= c + 0.5
        used[ending(w)] -= c
    class_counts = np.concatenate([[c for _, c in words], [n_end], used]).astype(np.float64)
    return Vocabulary(head, total, n_distinct, mass, class_counts)


_MODELS = "shard long, flat binary, seen long"


def _trained(texts: DataFrame, vocabulary: Vocabulary, start: np.ndarray, passes: int, most: int | None = None) -> DataFrame:
    """A model for each shard, from rows (shard, text) in order, all from the same start; of each shard at most so many bytes."""
    schema = pa.schema([("shard", pa.int64()), ("flat", pa.binary()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.ready()

        def shards() -> Iterator[tuple[int, Iterator[bytes]]]:
            rows = ((s, t or b"") for batch in batches for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for shard, own in groupby(rows, key=lambda r: r[0]):
                yield shard, (t for _, t in own)

        for shard, own in shards():
            model, state, seen, rng = LogBilinear(start.copy(), v.unigram), np.zeros_like(start), 0, np.random.default_rng([17, shard])
            kept, size = [], 0
            for block in blocks_of(own, 4 << 20):
                size += sum(map(len, block))
                if most is not None and size > most:
                    break
                seq, tokens = v.sequence(block)[:2]
                model.train(seq, tokens, rng, state)
                seen += len(tokens)
                if passes > 1:
                    kept.append((seq, tokens))
            for _ in range(passes - 1):
                for seq, tokens in kept:
                    model.train(seq, tokens, rng, state)
            if seen:
                yield record_batch(schema, [shard], [model.flat.tobytes()], [seen])

    return map_arrow(texts.select("shard", "text"), run, _MODELS)


def blocks_of(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _averaged(models: DataFrame) -> np.ndarray | None:
    """Mean by tokens, level by level in the order of shards, so no task and not the driver meets more than FAN of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for up, own in groupby(rows, key=lambda r: r[0]):
            total, seen = 0.0, 0
            for _, _, flat, n in own:
                total, seen = total + np.frombuffer(flat, np.float32).astype(np.float64) * n, seen + n
            yield record_batch(pa.schema([("shard", pa.int64()), ("flat", pa.binary()), ("seen", pa.int64())]), [up], [(total / seen).astype(np.float32).tobytes()], [seen])

    models = staged(models)
    n = models.count()
    while n > 1:
        grouped = models.select(F.floor(F.col("shard") / FAN).cast("long").alias("up"), "shard", "flat", "seen")
        models = staged(map_arrow(grouped.repartition(-(-n // FAN), "up").sortWithinPartitions("up", "shard"), run, _MODELS))
        n = models.count()
    row = models.first()
    return None if row is None else np.frombuffer(bytes(row.flat), np.float32).copy()


def fit(docs: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """(vocabulary, model parameters, table of all counts) from all training texts."""
    counts = staged(count_training(docs))
    v = _vocabulary(counts)
    flat = LogBilinear.start(v.unigram).flat
    texts = training(docs).select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    chosen = texts.select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(PILOT_TEXTS).select("doc_id")
    pilot = texts.join(F.broadcast(chosen), "doc_id").select(F.lit(0).cast("long").alias("shard"), "text", "h", "doc_id")
    row = _trained(pilot.repartition(1).sortWithinPartitions("h", "doc_id", F.xxhash64("text")), v, flat, PILOT_PASSES, PILOT_BYTES).first()
    flat = flat if row is None else np.frombuffer(bytes(row.flat), np.float32).copy()
    shards = max(1, -(-int(v.total) // SHARD_TOKENS))
    dealt = texts.withColumn("t", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("t", F.lit(shards).cast("long")))
    mean = _averaged(_trained(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "t", "doc_id"), v, flat, 1))
    return v, flat if mean is None else mean, counts


def score_texts(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null texts are empty: one end.  Rows without doc_id are scored, not learned from.  Repeated
    rows give repeated results; with no training text all counts are 0; an empty table gives an
    empty result; other columns are ignored.  Counts of tokens outside the head come by a join on
    the token, a row for each text and such token; nothing that grows with the corpus is broadcast.
    """
    columns = [("rid", pa.int64()), ("doc_id", pa.int64()), ("main", pa.bool_()), ("token", pa.binary()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(columns)
        v = vocabulary.ready()
        model = LogBilinear(flat, v.unigram)
        log_mass = np.log10(v.mass)
        for batch in batches:
            for rows in _blocks(batch):
                keys, ids, texts = zip(*rows)
                seq, tokens, places, owner, words, origin = v.sequence([t or b"" for t in texts])
                logs = model.logs(seq)[tokens - 2] / np.log(10.0)
                cls = seq[tokens]
                rare = cls > v.n_words
                logs[rare] -= log_mass[cls[rare] - v.n_words - 1]
                held = places >= 0
                own = np.where(held, v.logs[places] if len(v.logs) else 0.0, 0.0)
                add = lambda x: np.bincount(owner, x, len(texts))
                base, scored = add(own), add(logs + np.where(rare, own, 0.0))
                known, n = add(held & (v.counts[places] > 0) if len(v.counts) else held), np.bincount(owner, minlength=len(texts))
                tail = Counter((int(owner[k]), words[origin[k]] if origin[k] >= 0 else END) for k in np.flatnonzero(~held))
                m, t = len(texts), len(tail)
                where = [d for d, _ in tail]
                yield record_batch(
                    schema, [*keys, *(keys[d] for d in where)], [*ids, *(ids[d] for d in where)], [True] * m + [False] * t,
                    [b"\x00row" + str(k).encode() for k in keys] + [w for _, w in tail], [0] * m + list(tail.values()),
                    np.concatenate([n, np.zeros(t, np.int64)]), np.concatenate([known.astype(np.int64), np.zeros(t, np.int64)]), np.concatenate([base, np.zeros(t)]), np.concatenate([scored, np.zeros(t)]),
                )

    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = map_arrow(keyed, run, "rid long, doc_id long, main boolean, token binary, tf long, n_tokens long, known long, base double, model double")
    # a row that stands for a whole text carries a token of its own, which no count has: it joins nothing and spreads evenly
    met = rows.join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    extra = F.col("tf") * F.log10(c + 0.5)
    out = met.groupBy("rid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + extra).alias("base"),
        F.sum(F.col("model") + extra).alias("score"),
    )
    scale = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    return out.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score")


def _blocks(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        if held and size + len(row[2] or b"") > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[2] or b"")
    if held:
        yield held


def score_corpus(docs: DataFrame) -> DataFrame:
    """Fit on the training texts of docs and score all of them."""
    v, flat, counts = fit(docs)
    return score_texts(docs, v, flat, counts)


def brute_force_base(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_tokens, n_known, N, base_score) in plain Python, for tests."""
    words = [(k, [*(t or "").encode().lower().split(), END]) for k, t in docs]
    c: Counter = Counter(w for k, ws in words if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(k, len(ws), sum(c[w] > 0 for w in ws), n, sum(float(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))) for w in ws)) for k, ws in words]


def brute_force_score(texts: list[str | None], vocabulary: Vocabulary, flat: np.ndarray, counts: dict[bytes, int]) -> list[float]:
    """log10 probability of each text token by token, with a whole softmax each time, for tests."""
    model, n = LogBilinear(flat.astype(np.float64), vocabulary.unigram), vocabulary.n_words
    own = {w: k for k, w in enumerate(vocabulary.words[:n])}
    out = []
    for t in texts:
        before, total = (n, n), 0.0
        for w in [*(t or "").encode().lower().split(), END]:
            c = n if w == END else own.get(w, n + 1 + ending(w) if w else n)
            s = (model.r1[before[1]] + model.r2[before[0]]) @ model.q.T + model.b
            total += (s[c] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
            if c > n:
                total += np.log10(counts.get(w, 0) + 0.5) - np.log10(vocabulary.mass[c - n - 1])
            before = (before[1], c)
        out.append(total)
    return out
