"""Byte-level vocabulary against the library on whole texts, and exact round trips."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from scorewright.llm import byte_bpe
from scorewright.llm.queries import op12_byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = plain()
PARTS = ["'s", "'", "'ll", " ", "  ", "\n", "\t\n ", "a", "word", "é", "日本", "٣", "12", "!", "?!", "　", " ", "😀", "_", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60), st.integers(1, 9))
def test_blocks_don_t_change_ids(text, size):
    assert "".join(byte_bpe.blocks(text, size)) == text
    ids = byte_bpe.encode(PLAIN, text, size)
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert byte_bpe.decode(PLAIN, ids, size) == text.encode()


def test_long_stretches():
    rng = random.Random(5)
    prose = "".join(rng.choice(PARTS[3:]) for _ in range(200_000))
    for text in (prose, "a" * 300_000, " " * 200_000 + "x", "\n" * 200_000, "!" * 100_000 + "'s" * 1000, "ab " * 100_000):
        assert np.frombuffer(byte_bpe.encode(PLAIN, text), "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert max(map(len, byte_bpe.blocks(prose))) < byte_bpe.BLOCK_CHARS + 1000


def test_rows(spark):
    rows = [(1, "it's 12 <|endoftext|>"), (2, None), (3, ""), (None, "é\U0001f600"), (1, "it's 12 <|endoftext|>")]
    docs = spark.createDataFrame(rows, "id long, `a.b` string").withColumn("text", F.lit(9))
    out = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, PATTERN, text_col="a.b"), RANKS, PATTERN).collect()
    assert sorted((repr(r[0]), r[1]) for r in out) == sorted((repr(a), b) for a, b in rows)
    for r in out:
        assert bytes(r["decoded"]).decode() == (r["a.b"] or "")
        assert np.frombuffer(bytes(r["tokens"]), "<u4").tolist() == PLAIN.encode_ordinary(r["a.b"] or "")
        assert r["n_tokens"] == len(r["tokens"]) // 4
    assert byte_bpe.encoded(docs.limit(0), RANKS, PATTERN, text_col="a.b").count() == 0
    with pytest.raises(ValueError, match="tokens"):
        byte_bpe.encoded(docs.withColumn("tokens", F.lit(1)), RANKS, PATTERN)
    broken = docs.limit(1).select(F.expr("cast(X'61FF62' as string)").alias("text"))
    assert bytes(byte_bpe.decoded(byte_bpe.encoded(broken, RANKS, PATTERN), RANKS, PATTERN).first()["decoded"]).decode() == "a�b"


def test_query(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = PLAIN.encode_ordinary(docs[r["doc_id"]])
        want = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
