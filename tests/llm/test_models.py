"""Language model, toxicity, personal data and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import lm_scoring, pii, queries, toxicity
from geoloom.llm.common import load


def test_language_model(spark, sf, monkeypatch):
    docs = load(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(100001, None), (100002, ""), (5, rows_text(docs, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 20_000)  # several shards
    monkeypatch.setattr(lm_scoring, "HEAD", 500)  # so that most words' counts come by the join
    v, flat, counts = lm_scoring.fit(df)
    got = lm_scoring.score_texts(df, v, flat, counts).collect()
    want = sorted(lm_scoring.brute_force_base(rows))
    assert len(got) == len(rows)
    for g, w in zip(sorted(got, key=lambda r: r.doc_id), want):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4] and g.base_score == pytest.approx(w[4], rel=1e-9)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    model = lm_scoring.LogBilinear(flat, v.unigram)
    for a, b in ((3, 5), (v.n_words, v.n_words)):
        p = [np.exp(model.logs(np.array([a, b, t], np.int32))[0]) for t in range(model.classes)]
        assert sum(p) == pytest.approx(1, abs=1e-5)
    some = [r for r in rows if r[0] % 7 == 0 and len(r[1] or "") < 3000] + rows[-3:-1]
    known = {bytes(t): c for t, c in counts.select("token", "c").collect()}
    own = {g.doc_id: g.score for g in got}
    for r, x in zip(some, lm_scoring.brute_force_score([t for _, t in some], v, flat, known)):
        assert own[r[0]] == pytest.approx(x, rel=1e-4, abs=1e-3)
    other = lm_scoring.fit(df.repartition(7))[1]
    assert np.array_equal(flat, other)  # partitions don't matter
    assert lm_scoring.score_corpus(df.limit(0)).collect() == []
    nothing = lm_scoring.score_corpus(df.where("doc_id is null").unionByName(spark.createDataFrame([(None, "a b", "x")], df.schema))).first()
    assert (nothing.n_tokens, nothing.n_known, nothing.train_tokens, nothing.held_out) == (3, 0, 0, True)


def rows_text(docs, key):
    return docs.where(F.col("doc_id") == key).first().text


def test_toxicity_held_out(spark):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.digest(toxicity.score_texts(docs, toxicity.fit(docs, labels))).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right / len(got) > 0.85 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_tolerates_gaps_and_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7)))
    text = lambda bad: " ".join([*(word() for _ in range(20)), *([rng.choice(["idiot", "moron", "stupid"])] if bad else []), word()])
    docs = [(i, text(i % 3 == 0)) for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    odd = [(1, None), (2, ""), (3, "well id.iot there"), (4, "well m o r o n there"), (5, "st-upid"), (6, "nothing to see"), (None, "x")]
    s = {r.doc_id: r for r in toxicity.score_texts(spark.createDataFrame(odd, "doc_id long, text string"), m).collect()}
    assert s[3].predicted == s[4].predicted == s[5].predicted == 1
    assert s[1].predicted == s[2].predicted == s[6].predicted == 0 and s[1].score == s[2].score
    assert s[None].held_out is False
    assert toxicity.score_texts(d.limit(0), m).collect() == []
    assert toxicity.Model.trained([]).scores(["x"], {})[0][0] < 0.5
    kept = toxicity.keep_clean(d, m)
    assert kept.columns == d.columns and kept.where("doc_id % 3 = 0").count() < 20 and kept.where("doc_id % 3 <> 0").count() > 390


def test_word_values_are_a_kernel_expansion():
    """The folded weights give the same as the sum over landmarks of gapped-subsequence kernels, counted place by place."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcid.o") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    marks, alpha = words[:7], [rng.uniform(-1, 1) for _ in range(7)]

    def triples(word):
        sym = [0, *(toxicity._TABLE[ord(c)] for c in word), 0]
        out, norm = {}, 0.0
        for i in range(len(sym)):
            for j in range(i + 1, len(sym)):
                for k in range(j + 1, min(len(sym), i + toxicity.SPAN + 1)):
                    t = (sym[i], sym[j], sym[k])
                    if toxicity.GAP not in t and t[:2] != (0, 0):
                        w = toxicity.DECAY ** (k - i)
                        out[t] = out.get(t, 0.0) + w
                        norm += w * w
        return {t: w / max(norm, 1e-6) ** 0.5 for t, w in out.items()}

    kernel = lambda a, b: sum(w * triples(b).get(t, 0.0) for t, w in triples(a).items())
    weight = (toxicity.word_features(marks) * np.array(alpha, np.float32)[:, None]).sum(axis=0)
    want = [sum(a * kernel(w, m) for a, m in zip(alpha, marks)) + 0.25 for w in words]
    assert np.allclose(toxicity.word_values(words, weight, 0.25), want, atol=1e-4)


def test_personal_data(spark):
    rng = random.Random(3)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "4111111111111111", "4111 1111 1111 1111", "4111-1111", "+1 (555) 555-1234", "+49 30 123456789", "+", "é", "\U0001f600", " ", ".", "-", "12", "_d@e.f.g", "\n"]
    texts = [None, "", "1" * 30000, "1 " * 20000, "a" * 20000 + "@", "a.b@c.d " * 500] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("clash")).repartition(8)
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == pii.brute_force(t), t
    assert pii.find_personal_data(df.limit(0)).collect() == []


def test_personal_data_beyond_the_base(spark):
    df = spark.createDataFrame([(1, "mail bob.smith [at] example [dot] com ok", "x", 3), (2, "call 555-123-4567 now", "x", 3), (3, "iban DE12 1234 1234 1234 1234 12", "x", 3), (4, "version 2020-10-11 of 12.11.2020", "x", 3), (5, None, "x", None), (6, "a@b.cd 1.2.3.4", "x", 3)], "doc_id long, text string, lang string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert spans[1].startswith("email_disguised:") and spans[2].startswith("phone_local:") and "iban:" in spans[3] and spans[4] == "" and spans[5] == ""
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[6].text == "[EMAIL] [IP]" and red[6].n_chars == 12 and red[5].text is None and red[4].text == "version 2020-10-11 of 12.11.2020" and "4567" not in red[2].text


def test_redaction_carries_any_column(spark):
    df = spark.createDataFrame([(1, "a@b.cd and a@b.cd", "x"), (2, None, "y"), (None, "1.2.3.4", "z"), (1, "a@b.cd and a@b.cd", "x")], "doc_id long, text string, carried string")
    df = df.withColumn("m", F.create_map("carried", "doc_id")).withColumn("span", F.array("carried"))
    got = sorted(tuple(map(str, r)) for r in pii.redact(df).collect())
    one = ("1", "[EMAIL] and [EMAIL]", "x", "{'x': 1}", "['x']")
    assert got == sorted([one, one, ("2", "None", "y", "{'y': 2}", "['y']"), ("None", "[IP]", "z", "{'z': None}", "['z']")])
    assert pii.redact(df.limit(0)).collect() == []


def test_pipeline_stages(spark, sf):
    docs = load(spark, sf, "documents")
    seen = {"start": docs.count()}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, sf))
        seen[name] = docs.count()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe_codec"]
    assert seen["start"] >= seen["toxicity"] > seen["near_dedup"] == seen["decontamination"] == seen["pii"] == seen["bpe_codec"] > 0.7 * seen["start"]
    assert queries.pipeline(spark, sf).count() == seen["bpe_codec"]
    empty = load(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.staged(stage(spark, empty, sf))
        assert empty.count() == 0


def test_a_texts_score_does_not_depend_on_the_text_before_it():
    texts = [b"red fish", b"", b"blue", b"red fish", b"blue fish odd", b"", b""]
    head = [(lm_scoring.END, 7), (b"fish", 3), (b"red", 2), (b"blue", 2)]
    v = lm_scoring.Vocabulary(head, 14, 4, np.ones(lm_scoring.ENDINGS), np.ones(3 + 1 + lm_scoring.ENDINGS)).ready()
    model = lm_scoring.LogBilinear.start(v.unigram)

    def scores(block):
        seq, tokens, _, owner, _, _ = v.sequence(block)
        assert len(tokens) == sum(len(t.split()) + 1 for t in block)
        return np.bincount(owner, model.logs(seq)[tokens - 2], len(block))

    got = scores(texts)
    assert np.allclose(got, [scores([t])[0] for t in texts], atol=1e-4)
    assert abs(got[0] - got[3]) < 1e-4 and np.ptp(got[[1, 5, 6]]) < 1e-4
