"""Near duplicates, decontamination, license scans, repeats and top-k search against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontamination, induced, license_scan, near_dedup, queries, suffix_dedup, topk_search
from geoloom.llm.common import load, span_hashes

W = [f"w{i}" for i in range(400)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def near_texts(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [rng.choice(W) for _ in range(rng.randint(1, 120))]
        for k in range(9):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 20))):
                x[rng.randrange(len(x))] = rng.choice(W)
            out.append(" ".join(x).upper() if k % 4 == 0 else "\n".join(x))
    return [*out, None, "", "  ", "a", "A", "a b", "a  B", out[3]]


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, num):
    docs = [(i * 3 + 1, t) for i, t in enumerate(near_texts())]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    want = sorted(near_dedup.brute_force(docs, width, num, 100), key=lambda r: tuple(map(str, r)))
    assert rows_of(near_dedup.near_duplicates(df, width, num, 100)) == want


def test_a_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)  # so that groups are split
    rng = random.Random(5)
    base = [rng.choice(W) for _ in range(150)]
    docs = []
    for k in range(150):
        x = list(base)
        for _ in range(rng.randint(0, 8)):
            x[rng.randrange(len(x))] = rng.choice(W)
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df, 3, 85, 100)) == sorted(near_dedup.brute_force(docs, 3, 85, 100), key=lambda r: tuple(map(str, r)))


def test_two_dense_clusters_in_one_bucket(spark):
    """Two clusters that share most of their words meet in many buckets, and only some of their members are linked."""
    rng = random.Random(8)
    base = [rng.choice(W) for _ in range(160)]
    other = base[:140] + [rng.choice(W) for _ in range(24)]
    docs = []
    for k in range(120):
        x = list(base if k % 2 else other)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(len(x))] = rng.choice(W)
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for num in (75, 85):
        assert rows_of(near_dedup.near_duplicates(df, 3, num, 100)) == sorted(near_dedup.brute_force(docs, 3, num, 100), key=lambda r: tuple(map(str, r)))


def test_near_duplicates_query(spark, sf):
    """The query itself, at its own parameters, on its whole table."""
    docs = [tuple(r) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    want = near_dedup.brute_force(docs, 3, 85, 100)
    assert rows_of(queries.op2_near_dedup(spark, sf)) == sorted(want, key=lambda r: tuple(map(str, r)))
    assert sum(not r[3] for r in want) > 0


def test_near_duplicates_shuffle_little(spark):
    """No band keys beside registers, no text, set or difference sent again for a small join (before: 9.7 times the texts)."""
    rng = random.Random(4)
    docs = []
    for g in range(16):
        base = [f"g{g}x{rng.randrange(1 << 40)}" for _ in range(300)]
        other = base[:270] + [f"o{g}x{rng.randrange(1 << 40)}" for _ in range(50)]
        for k in range(12):
            x = list(base if k % 2 else other)
            for _ in range(rng.randint(0, 9)):
                x[rng.randrange(len(x))] = f"y{rng.randrange(1 << 40)}"
            docs.append((len(docs), " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sc = spark.sparkContext._jsc.sc()

    def sent():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        before = sent()
        got = rows_of(near_dedup.near_duplicates(df, 3, 85, 100))
        moved = sent() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(near_dedup.brute_force(docs, 3, 85, 100), key=lambda r: tuple(map(str, r)))
    size = sum(len(t) for _, t in docs)
    assert 0 < moved < 7.5 * size


def test_near_duplicates_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b  c d e"), (8, None)], "doc_id long, text string")
    got = rows_of(near_dedup.near_duplicates(df))
    assert got == sorted([(None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (8, 0, 8, True)], key=lambda r: tuple(map(str, r)))
    kept = near_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "8", "None"]
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_dropped_duplicates_are_judged_by_their_own_text(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(7, a, "x"), (7, b, "x"), (7, a.upper(), "y"), (9, b, "z"), (9, "n o t h i n g", "z"), (None, a, "n"), (None, a, "n"), (3, None, "e"), (3, None, "e"), (4, "", "e"), (5, "n o t  h i n g", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _copy string").withColumn("key", F.create_map("_copy", "text"))
    kept = near_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), " ".join((r.text or "").lower().split())) for r in kept.collect())
    assert got == sorted([("7", a), ("7", b), ("None", a), ("None", a), ("3", ""), ("4", ""), ("5", "n o t h i n g")])
    assert all(r.key == {r._copy: r.text} for r in kept.collect())


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 62, (2, 500)).astype(np.uint64)
    ra, rb = near_dedup.registers_of(a), near_dedup.registers_of(b)
    assert (near_dedup.merge_registers(ra, rb) == near_dedup.registers_of(np.concatenate([a, b]))).all()
    c = np.concatenate([a[:450], b[:50]])
    rc = near_dedup.registers_of(c)
    size = np.array([500.0])
    likely = lambda x, y: bool(near_dedup.likely(size, size, np.array([(x > y).sum()]), np.array([(x < y).sum()]), 0.8)[0])
    assert likely(ra, rc) and not likely(ra, rb)


def test_decontamination(spark):
    rng = random.Random(2)
    mk = lambda n: " ".join(rng.choice(["w%d", "W%d.", "é%d"]) % rng.randrange(4) for _ in range(n))
    docs = [(i, rng.choice([None, "", mk(40), mk(15)])) for i in range(40)] + [(3, "w0 w1 w2")]
    items = [(i, rng.choice([None, "", mk(3), mk(6)])) for i in range(9)] + [(1, mk(4)), (None, "é0 é1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontamination.brute_force(docs, [("null" if k is None else k, t) for k, t in items], 3), key=lambda r: tuple(map(str, r)))
    for block in (1 << 20, 30):  # one block of items, and a chain of blocks
        assert rows_of(decontamination.digest(decontamination.decontaminate(d, b, 3, block))) == want
    clean = decontamination.remove_hits(d, b, 3)
    assert clean.columns == d.columns
    texts = dict(docs[:-1])
    for r in clean.collect():
        assert r.text is None or len(r.text) <= len(texts.get(r.doc_id) or "w0 w1 w2")
    assert decontamination.decontaminate(d.limit(0), b).count() == 0 and decontamination.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_cut_texts_keep_the_rest(spark):
    d = spark.createDataFrame([(1, "Ah, one Two three! é one two three end", "x", 38), (2, "one two", "y", 7)], "doc_id long, text string, lang string, n_chars long")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert rows_of(decontamination.remove_hits(d, b)) == [(1, "Ah, ! é  end", "x", 12), (2, "one two", "y", 7)]


def duck(con, df, sql):
    con.register("documents", df)
    rel = con.sql(sql)
    return sorted((tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()), key=str)


def test_license_scan(spark):
    rng = random.Random(3)
    bits = ["Licensed under the Apache License", "MIT-License", "GNU General Public License v3", "CC BY 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this great software and associated documentation files", "the license", "x", "Éa", "gnu general", "\n"]
    docs = [(i, None if i == 0 else " ".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit(1))
    got = license_scan.digest(license_scan.scan_licenses(df))
    rows = sorted((tuple(r) for r in got.select(sorted(got.columns)).collect()), key=str)
    assert rows == duck(duckdb.connect(), df.toPandas()[["doc_id", "text"]], license_scan.oracle_sql())
    assert any("mit" in r.labels.split(",") and "mit" not in r.base_labels.split(",") for r in got.collect())
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def sorted_suffixes(symbols, sigma, most):
    text, got = induced.Text(), []
    text.append(np.array(symbols))
    induced.order_suffixes(text.mapped(), sigma, lambda at, shared: got.extend(zip(at.tolist(), shared.tolist())), most)
    text.close()
    return got


def naive_suffixes(symbols, most):
    ends = [i for i, x in enumerate(symbols) if not x]
    tail = lambda i: [x + 10**6 for x in symbols[i : next(e for e in ends if e >= i)]] + [next(e for e in ends if e >= i)]
    order = sorted((i for i, x in enumerate(symbols) if x), key=tail, reverse=True)
    share = lambda a, b: min(most, next(k for k, (x, y) in enumerate(zip(tail(a), tail(b))) if x != y or x < 10**6))
    return [(i, share(order[k - 1], i) if k else 0) for k, i in enumerate(order)]


@pytest.mark.parametrize("chunk,queue,base", [(1 << 16, 8 << 20, 1 << 18), (5, 200, 3), (64, 500, 8)])
def test_suffix_order(monkeypatch, chunk, queue, base):
    """Order and shared lengths, with queues on disk and recursion wherever names repeat."""
    monkeypatch.setattr(induced, "CHUNK", chunk)
    monkeypatch.setattr(induced, "QUEUE_BYTES", queue)
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "DIGIT", 4 if base == 3 else 2048)
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = [int(x) for _ in range(rng.integers(1, 8)) for x in [*rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 40)), 0]]
        assert sorted_suffixes(t, 6, 9) == naive_suffixes(t, 9)


def test_a_shard_larger_than_memory(monkeypatch):
    """Queues of 64 kB, 2,048 tuples at once: memory stays far below what the tuples of the text take, and doesn't grow with it."""
    import tracemalloc

    monkeypatch.setattr(induced, "CHUNK", 2048)
    monkeypatch.setattr(induced, "QUEUE_BYTES", 1 << 16)
    monkeypatch.setattr(induced, "BASE", 1 << 10)
    rng = np.random.default_rng(2)
    words = [rng.integers(1, 257, rng.integers(2, 30)) for _ in range(300)]
    text, n = induced.Text(), 0
    while n < 400_000:
        piece = np.concatenate([words[k] for k in rng.integers(0, 300, 40)] + [np.zeros(1, int)])
        text.append(piece)
        n += len(piece)
    whole = text.mapped().symbols[: text.n].tolist()
    seen, last, checked = 0, None, 0
    sorted_suffixes([1, 2, 0], 6, 9)  # so that tables of fixed size are there already
    tracemalloc.start()

    def sink(at, shared):
        nonlocal seen, last, checked
        for i, k in zip(at.tolist(), shared.tolist()):
            if seen % 150 == 1:
                a, b = whole[last : last + 60], whole[i : i + 60]
                same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y or not x), 60)
                assert k == min(50, same) and (same == 60 or a[same] > b[same] or not a[same])
                checked += 1
            seen, last = seen + 1, i

    induced.order_suffixes(text, 257, sink, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(x > 0 for x in whole) and checked > 2000
    assert 3 * peak < 17 * seen, peak  # plain tuples alone take 17 bytes a suffix


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 200))) for _ in range(6)] + ["x" * 300, "é" * 80]
    docs = [(i * 7 % 101, None if i == 5 else "" if i == 6 else "".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(25, 300)] for _ in range(rng.randint(1, 4)))) for i in range(100)]
    docs += docs[:5] + [(None, base[0] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("payload", F.lit("clash")).repartition(4)
    assert rows_of(suffix_dedup.digest(suffix_dedup.remove_repeats(df))) == sorted(suffix_dedup.brute_force(docs), key=lambda r: tuple(map(str, r)))
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_repeats_query(spark, sf):
    docs = [tuple(r) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op10_suffix_dedup(spark, sf)) == sorted(suffix_dedup.brute_force(docs), key=lambda r: tuple(map(str, r)))


def copied_texts(n):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(60, 400))) for _ in range(40)]
    return [(i, rng.choice(base) + "".join(rng.choice("abcd") for _ in range(300)) + rng.choice(base)) for i in range(n)]


@pytest.mark.parametrize("pool", [1, 60000, 32 << 20])
def test_repeats_of_many_parts(spark, monkeypatch, pool):
    """Pools that are sent once a block, now and then and at the end; several parts a task."""
    for name, value in (("BLOCK", 3000), ("POOL", pool), ("PART", 512), ("SHARD", 4096)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = copied_texts(90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(suffix_dedup.digest(suffix_dedup.remove_repeats(df))) == sorted(suffix_dedup.brute_force(docs), key=lambda r: tuple(map(str, r)))


def test_repeats_send_few_rows(monkeypatch):
    """A task sends a row to a bucket, not one for each block of documents or each bucket that it reads."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    parts, shards, docs = 11, 5, [(i, t.encode()) for i, t in copied_texts(200)]

    def run(fn, rows, names):
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 10])], names=names) for i in range(0, len(rows), 10))
        return [r for out in fn(batches) for r in zip(*(c.to_pylist() for c in out.columns))]

    grams = run(suffix_dedup._grams(parts), docs, ["doc_id", "payload"])
    assert len(grams) == 2 * parts  # found by hash, or shared already
    several = [r for a in range(0, 200, 50) for r in run(suffix_dedup._grams(parts), docs[a : a + 50], ["doc_id", "payload"])]
    shared = run(suffix_dedup._shared(parts), sorted(several, key=lambda r: (r[1], r[0])), ["bucket", "known", "h", "d"])
    assert len(shared) == parts
    texts = [(int(suffix_dedup.part_of(np.int64(d), parts)), 1, suffix_dedup.squeeze(t), b"", d, d) for d, t in docs]
    sides = sorted([(p, 0, payload, h, 0, 0) for p, payload, h in shared] + texts, key=lambda r: r[:2])
    cut = run(suffix_dedup._cut(parts, shards), sides, ["part", "side", "payload", "grams", "doc_id", "row"])
    size = sum(int.from_bytes(r[7][:8], "little") for r in cut)
    assert 0 < len(cut) <= 2 * shards + size // 3000
    monkeypatch.setattr(suffix_dedup, "POOL", 1)
    assert len(run(suffix_dedup._grams(parts), docs, ["doc_id", "payload"])) > 10 * parts


@pytest.mark.parametrize("group,asked", [(16384, 65536), (16, 3)])
def test_top_k(spark, monkeypatch, group, asked):
    monkeypatch.setattr(topk_search, "GROUP", group)
    monkeypatch.setattr(topk_search, "ASKED", asked)
    monkeypatch.setattr(topk_search, "BUCKET", min(2048, group // 2))
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 9 else 3) * (10 if i % 5 else 0.1)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf")] * 4), (None, [1.0] * 4), (240, [0.0] * 4), (5, rows[5][1]), (220, []), (20, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 20 = 0"), 5).collect())
    ok = [(k, np.floor(64 * np.array(v))) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for k, q in ok:
        if k % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != k and len(v) == len(q))[:5]
            want += [(k, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), df.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 5.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(big, big.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 1, 1920000000**2 + 64 * 128), (0, 2, 2, -(1920000000**2) + 64 * 320)]
