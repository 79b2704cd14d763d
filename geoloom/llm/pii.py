"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base kinds are fixed patterns with checks.  Beside them, high-recall generators propose
overlapping candidate spans; boosted trees over format and context features score each, and a
threshold calibrated for precision selects what is added.  The trees are fitted on generated,
labelled examples whose features come from the very expressions that score documents, and are
compiled to CASE expressions: scoring never leaves the JVM.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

# Possessive forms of the contract's patterns: nothing follows their greedy runs that could need
# characters back, so they match the same and neither recurse nor rescan a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of the method: e-mail addresses in disguise, phones without a plus, grouped numbers.
DISGUISED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?)[A-Za-z0-9-]{2,63}+){1,4}+"
LOCAL = r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z.])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"

BASE = ["email", "ip", "card", "phone"]
ADDED = ["email_disguised", "phone_local", "iban"]
PATTERNS = dict(zip(BASE + ADDED, [EMAIL, IP, CARD, PHONE, DISGUISED, LOCAL, IBAN]))
#: What a text must hold for a pattern to match at all: a cheap test before the search.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = 32
FEATURES = ["n_digits", "n_chars", "n_seps", "n_kinds_of_sep", "paren", "cue", "anti", "luhn", "upper", "kind"]
#: Generated examples, trees, depth 2 splits, learning rate: bounds of the fit.
EXAMPLES, TREES, RATE = 3000, 40, 0.3
#: The calibrated threshold is the lowest with this precision on held-out examples.
PRECISION = 0.995


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: str) -> Column:
    """Whether the digits in column `digits` have a right check digit; only for short strings."""
    one = f"cast(substr({digits}, length({digits}) + 1 - k, 1) as int)"
    return F.expr(
        f"""length({digits}) between 2 and 32 and aggregate(sequence(1, greatest(1, least(32, length({digits})))), 0, (s, k) ->
        s + case when k > length({digits}) then 0 when k % 2 = 0 then {one} * 2 - if({one} > 4, 9, 0) else {one} end) % 10 = 0"""
    )


def _pieces(text: str) -> list[str]:
    """For each kind an array of its places: how many characters lie before each match since the one before, and what."""
    out = []
    for kind, pattern in PATTERNS.items():
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        need = f"instr({text}, '{NEEDS[kind]}') > 0" if kind in NEEDS else f"{text} rlike '[0-9\\\\[({{<]'"
        out.append(f"case when {need} then arrays_zip(regexp_extract_all({text}, '{quoted}', 0), split({text}, '{quoted}', -1)) else array() end")
    return out


def _exploded(rows: DataFrame) -> DataFrame:
    """rid, doc_id, kind, k, m, gap, before, after, carried: a row for each match, and one for the row itself, which alone carries."""
    for kind, expr in zip(PATTERNS, _pieces("t")):
        rows = rows.withColumn(f"p_{kind}", F.expr(expr))
    carried = "carried" if "carried" in rows.columns else "cast(null as string)"
    own = f"array(struct(cast(null as string) as kind, 0 as k, cast(null as string) as m, 0 as gap, cast(null as string) as before, cast(null as string) as after, {carried} as carried))"
    nothing = f"if(true, null, {carried})"
    structs = [
        f"""transform(filter(p_{kind}, x -> x['0'] is not null), (x, k) -> struct('{kind}' as kind, k as k, x['0'] as m, length(x['1']) as gap,
            right(x['1'], {CONTEXT}) as before, left(p_{kind}[k + 1]['1'], 8) as after, {nothing} as carried))"""
        for kind in PATTERNS
    ]
    return rows.select("rid", "doc_id", F.explode(F.expr(f"concat({own}, {', '.join(structs)})")).alias("x")).select("rid", "doc_id", "x.*")


def features(found: DataFrame) -> DataFrame:
    """Format and context features of candidates (kind, m, before, after)."""
    found = found.withColumn("d", _digits(F.col("m")))
    near = F.lower("before")
    seps = F.regexp_replace("m", r"[0-9A-Za-z@_%]", "")
    has = lambda s: F.col("m").contains(s).cast("int")
    return found.select(
        "*",
        F.length("d").alias("n_digits"),
        F.length("m").alias("n_chars"),
        F.length(seps).alias("n_seps"),
        (has(" ") + has("-") + has(".") + has("/")).alias("n_kinds_of_sep"),
        (has("(") * has(")")).alias("paren"),
        near.rlike(r"(phone|tel|call|fax|mobile|cell|contact|mail|reach|write|iban|account|bank|transfer)[^a-z]{0,8}$").cast("int").alias("cue"),
        near.rlike(r"(version|isbn|serial|part|order|item|date|page|chapter|section|score|lines?|id|no|ratio)[^a-z]{0,4}$").cast("int").alias("anti"),
        _luhn("d").cast("int").alias("luhn"),
        F.length(F.regexp_replace("m", "[^A-Z]", "")).alias("upper"),
        F.when(F.col("kind") == "email_disguised", 0).when(F.col("kind") == "phone_local", 1).otherwise(2).alias("kind_no"),
    )


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """Generated sentences with one candidate each, and whether it is personal data."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        which, good = rng.randrange(3), rng.random() < 0.5
        if which == 0:
            at, dot = rng.choice(["[at]", " (at) ", " [at] ", "{at}"]), rng.choice([".", "[dot]", " [dot] ", " (dot) "])
            if good:
                m, cue = f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", rng.choice(["mail", "contact", "write", filler()])
            else:  # array subscripts and the like
                m, cue = f"{word()[:2]}{at.upper()}{d(1)}{dot}{d(2)}", rng.choice(["index", "version", "line", filler()])
        elif which == 1:
            if good:
                m = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}){d(3)}-{d(4)}"])
                cue = rng.choice(["phone:", "tel", "call", "mobile:", "fax", "contact"])
            else:
                m = rng.choice([f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(2)}-{d(2)}-{d(2)}"])
                cue = rng.choice(["version", "isbn", "date", "order", filler(), filler(), filler()])
        else:
            if good:
                m = rng.choice(["DE", "FR", "ES", "GB", "IT"]) + d(2) + rng.choice(["", " "]).join([""] + [d(4) for _ in range(rng.randint(4, 5))])
                cue = rng.choice(["iban", "account:", "transfer", "bank", "iban:"])
            else:
                m = "".join(rng.choice("ABCDEFGHKLMNPQRSTUVWXYZ") for _ in range(2)) + d(2) + "".join(rng.choice("ABCDEFGHKLMNPQRSTUVWXYZ0123456789") for _ in range(16))
                cue = rng.choice(["serial", "part", "id", filler(), filler()])
        out.append((f"{filler()} {cue} {m} {filler()}", int(good)))
    return out


class Boosted:
    """Logistic boosting of depth-2 trees over small integer features, fitted in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, rate: float):
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = math.log(p / (1 - p))
        self.trees: list = []
        raw = np.full(len(y), self.bias)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            tree = self._grow(x, g, h, np.ones(len(y), bool), 2, rate)
            self.trees.append(tree)
            raw += self._eval(tree, x)

    def _grow(self, x, g, h, rows, depth, rate):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if not depth or rows.sum() < 20:
            return leaf
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        best = max(((gain(rows & (x[:, f] <= t)) + gain(rows & (x[:, f] > t)), f, int(t)) for f in range(x.shape[1]) for t in np.unique(x[rows, f])[:-1]), default=None)
        if best is None or best[0] <= gain(rows) + 1e-9:
            return leaf
        _, f, t = best
        return (f, t, self._grow(x, g, h, rows & (x[:, f] <= t), depth - 1, rate), self._grow(x, g, h, rows & (x[:, f] > t), depth - 1, rate))

    def _eval(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, low, high = tree
        return np.where(x[:, f] <= t, self._eval(low, x), self._eval(high, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._eval(t, x) for t in self.trees)

    def column(self, names: list[str]) -> Column:
        """The same sum as one Catalyst expression."""

        def of(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            f, t, low, high = tree
            return f"if({names[f]} <= {t}, {of(low)}, {of(high)})"

        return F.expr(" + ".join([f"{self.bias!r}D", *(of(t) for t in self.trees)]))


_FITTED: dict[int, tuple[Boosted, float]] = {}
_NAMES = ["n_digits", "n_chars", "n_seps", "n_kinds_of_sep", "paren", "cue", "anti", "luhn", "upper", "kind_no"]


def fitted(spark: SparkSession, seed: int = 11) -> tuple[Boosted, float]:
    """Trees and threshold, once a session: a job of EXAMPLES short rows, whatever the corpus."""
    if seed not in _FITTED:
        made = examples(EXAMPLES, seed)
        values = ",".join(f"({k}L, '{t}', {y})" for k, (t, y) in enumerate(made))
        frame = spark.sql(f"select * from values {values} as e(rid, t, y)")
        found = features(_exploded(frame.select("rid", F.col("y").alias("doc_id"), "t")).where(F.col("kind").isin(ADDED)))
        got = np.array(found.select("rid", "doc_id", *_NAMES).collect(), np.int64).reshape(-1, 2 + len(_NAMES))
        x, y, held = got[:, 2:], got[:, 1], got[:, 0] % 4 == 0
        model = Boosted(x[~held], y[~held], TREES, RATE)
        raw, truth = model.raw(x[held]), y[held]
        order = np.argsort(-raw)
        precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        last = int(np.flatnonzero(precise)[-1]) if precise.any() else 0
        _FITTED[seed] = model, float(raw[order][last])
    return _FITTED[seed]


def _placed(rows: DataFrame) -> DataFrame:
    """Accepted spans of rows (rid, doc_id, t, and maybe carried): rid, doc_id, carried, span or null."""
    model, threshold = fitted(rows.sparkSession)
    found = _exploded(rows)
    parts = F.split("m", r"\.")
    small = reduce(lambda a, b: a & b, (F.length(F.regexp_replace(parts[i], "^0+", "")) <= 3 for i in range(4)))
    octets = reduce(lambda a, b: a & b, (F.expr(f"cast(right(concat('000', split(m, '\\\\.')[{i}]), 3) as int) <= 255") for i in range(4)))
    scored = features(found)
    kind, n = F.col("kind"), F.col("n_digits")
    ok = (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small & octets)
        .when(kind == "card", n.between(14, 19) & (F.col("luhn") == 1))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(model.column(_NAMES) >= threshold)
    )
    score = F.when(kind.isin(BASE), 1.0).when(kind.isNotNull(), 1 / (1 + F.exp(-model.column(_NAMES))))
    at = Window.partitionBy("rid", "kind").orderBy("k")
    order = reduce(lambda c, x: c.when(kind == x[1], x[0]), enumerate(BASE + ADDED), F.when(F.lit(False), 0))
    slim = scored.select("rid", "doc_id", "carried", "kind", "k", "gap", F.length("m").alias("n"), ok.alias("ok"), score.alias("score"), order.alias("order"))
    placed = slim.repartition("rid").withColumn("end", F.sum(F.col("gap") + F.col("n")).over(at))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("n")).alias("start"), "order", "kind", "end", (F.col("order") < len(BASE)).alias("base"), "score"))
    return placed.select("rid", "doc_id", "carried", span.alias("span"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<start, order, kind, end, base, score>> in code points, sorted.

    Matches are exploded next to their document's row and meet again by row, in the one shuffle; a
    running sum of lengths within a row gives places, so a document's matches are what a task holds.
    Null texts are empty; repeated rows give repeated results; overlapping spans of different kinds
    are all reported; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return _placed(rows).groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("doc_id", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span, merged where spans overlap, replaced by its kind in brackets.

    A row's columns travel once, on the row's own line beside its matches, through the one shuffle.
    A null text stays null; rows without doc_id and repeated rows are redacted each by itself; an
    empty table stays empty; other columns, whatever their names and types, are carried.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.struct(*docs.columns).alias("carried"))
    found = _placed(rows).select("rid", "carried", "span.*")
    so_far = Window.partitionBy("rid").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(so_far), F.lit(True)).cast("int")
    islands = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(Window.partitionBy("rid").orderBy("start", "order")))
    one = islands.groupBy("rid", "island").agg(F.expr("any_value(carried, true)").alias("carried"), F.min("start").alias("a"), F.max("end").alias("z"), F.min_by("kind", F.struct("start", "order")).alias("kind"))
    whole = one.groupBy("rid").agg(F.expr("any_value(carried, true)").alias("d"), F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "z", "kind")))).alias("s"))
    cut = """concat(array_join(transform(s, (x, i) -> concat(substring(d.text, int(if(i = 0, 0, s[greatest(i - 1, 0)].z) + 1), int(x.a - if(i = 0, 0, s[greatest(i - 1, 0)].z))), '[', upper(x.kind), ']')), ''),
        substring(d.text, int(s[size(s) - 1].z + 1)))"""
    out = whole.withColumn("cut", F.when(F.size("s") > 0, F.expr(cut)).otherwise(F.col("d.text")))
    new = {"text": F.col("cut"), "n_chars": F.when(F.size("s") > 0, F.length("cut").cast("long")).otherwise(F.col("d.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("cut")}
    return out.select(*(new.get(c, F.col("d")[c]).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    text = lambda s: f"array_join(transform({s}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(text("filter(spans, s -> s.base)")), 256).alias("base_sha256"), F.expr(text("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(load(spark, sf_dir, "documents")))


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """Counts and digest of the base kinds with Python's re, for tests."""
    import hashlib
    import re

    t = text or ""
    out = []
    for no, (kind, pat) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pat, t):
            ds = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(ds))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(ds) <= 19 and luhn, "phone": 10 <= len(ds) <= 15}[kind]
            if good:
                out.append((m.start(), no, kind, m.end()))
    out.sort()
    counts = [sum(o[2] == k for o in out) for k in BASE]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in out).encode()).hexdigest())
