import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from corpus import SCHEMA, awkward_texts, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm.byte_bpe import LEAF, TreeBPE, concatenated, decode_documents, encode_documents, read_ranks
from fleetscope.llm.queries import op2_byte_bpe

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(open(RANKS_PATH, "rb").read())
CODER = TreeBPE(RANKS, public_tokenizers.PATTERN)
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_tokenizer_and_round_trips(text):
    ids = CODER.encode(text)
    assert ids == EXACT.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "éàü", "=-", " \n"])
def test_long_pieces_join_from_halves(alphabet):
    rng = random.Random(5)
    for n in (1, 7, 64, 1000, 20000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert CODER.encode(text) == EXACT.encode_ordinary(text)


@given(st.binary(max_size=60), st.binary(max_size=60))
@settings(max_examples=300, deadline=None)
def test_join_is_the_encoding_of_the_concatenation(a, b):
    assert CODER.join(CODER.merged(a), CODER.merged(b)) == CODER.merged(a + b)


def test_documents(spark):
    data = rows(awkward_texts())
    df = spark.createDataFrame(data, SCHEMA)
    coded = encode_documents(df, RANKS_PATH, public_tokenizers.PATTERN)
    assert coded.columns == [*df.columns, "token_ids", "decoded"]
    for r in coded.collect():
        assert r.token_ids == EXACT.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    again = decode_documents(coded.drop("decoded"), RANKS_PATH)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())
    assert encode_documents(df.limit(0), RANKS_PATH, public_tokenizers.PATTERN).count() == 0


def test_concatenation_up_the_tree():
    rng = random.Random(4)
    for n in (0, 1, LEAF, LEAF + 1, 5 * LEAF, 1000):
        parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in range(n)]
        assert concatenated(parts) == b"".join(parts)


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_byte_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = EXACT.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
