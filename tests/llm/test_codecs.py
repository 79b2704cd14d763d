"""Token counts and the BPE codec against their libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from geoloom.llm import bpe_codec, queries, token_counts
from geoloom.llm.common import load

ODD = ["'", "s", "t", "re", "'ll", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", " ", "　", "\U0001f600", "中", "'d", "<|endoftext|>", "xyz 123 ", "\n\n"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, " " * 3000, "ab" * 2000, "'" * 90]


@pytest.fixture(scope="module")
def tiktok():
    c = bpe_codec.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_codec_is_the_library(tiktok):
    c = bpe_codec.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    texts = odd_texts(1500)
    pieces, edges = c.encode(texts)
    for k, t in enumerate(texts):
        assert [i for p in pieces[edges[k] : edges[k + 1]] for i in p[0]] == tiktok.encode_ordinary(t), t


def test_codec_query(spark, sf, tiktok):
    texts = dict(load(spark, sf, "documents").select("doc_id", "text").collect())
    for r in queries.op6_bpe_codec(spark, sf).collect():
        ids = tiktok.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_splicing_is_exact():
    tok = token_counts.tokenizer(P.path("byte_bpe_50k.json"))
    encode = lambda s: tok.encode(s, add_special_tokens=False)
    rng = random.Random(4)
    for t in ["".join(rng.choice(ODD) for _ in range(rng.randint(300, 800))) for _ in range(60)] + ["a" * 3000, "é" * 2000, " " * 3000, "ab " * 1500, "<|endoftext|>" * 200]:
        for chunk, overlap in ((400, 100), (301, 65), (1000, 70)):
            n, chunks = token_counts.count_spliced(encode, t, chunk, overlap)
            assert n == len(encode(t).ids) and (chunks > 1) == (len(t) > chunk)


def test_long_unbroken_text_is_encoded_a_few_times():
    tok = token_counts.tokenizer(P.path("byte_bpe_50k.json"))
    seen = []
    encode = lambda s: seen.append(len(s)) or tok.encode(s, add_special_tokens=False)
    for t in ["ab" * 30000, "ab" * 60000, "x y " * 9000 + "ab" * 30000 + " x y" * 9000]:
        seen.clear()
        assert token_counts.count_spliced(encode, t, 4096, 256)[0] == len(tok.encode(t, add_special_tokens=False).ids)
        assert sum(seen) < 10 * len(t)


@pytest.mark.parametrize("run", [lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json"), chunk_chars=200, overlap_chars=80), lambda d: bpe_codec.encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)])
def test_odd_rows(spark, run):
    rows = [(1, None), (2, ""), (3, "x" * 900), (None, "no id"), (3, "x" * 900), (4, "a b " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("spans", F.lit(1))
    got = run(df).collect()
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert len({tuple(map(str, r)) for r in got if r.doc_id == 3}) == 1
    assert run(df.limit(0)).collect() == []


def test_counts_query(spark, sf):
    tok = token_counts.tokenizer(P.path("byte_bpe_50k.json"))
    texts = dict(load(spark, sf, "documents").select("doc_id", "text").collect())
    for r in queries.op1_token_counts(spark, sf).collect():
        n = len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)
