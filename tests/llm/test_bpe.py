import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.llm.bpe import Encoder, bpe_both, bpe_decode, bpe_encode

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BLOB = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, BLOB.splitlines())}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = Encoder(BLOB, P.PATTERN)


def ids(text):
    return ENC.encode([text])[0].tolist()


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_equals_tiktoken_and_round_trips(text):
    got = ids(text)
    assert got == REFERENCE.encode_ordinary(text)
    out, off = ENC.decode(*ENC.encode([text]))
    assert out.tobytes() == text.encode() and off.tolist() == [0, len(text.encode())]


@pytest.mark.parametrize("text", ["a" * 5000, "abc" * 3000, "é" * 700, "thetherethen" * 40, " \n\t  x", "x" * 257, "0123456789" * 60])
def test_long_pieces(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_long_tree_equals_rows_of_short_ones():
    for word in ("internationalisation", "Donaudampfschiff", "aaaaaaaaaaaaa", "xyzzyxyzzy"):
        assert ENC.merge_one(word.encode()) == ENC.merge_many([word.encode()], 32)[0].tolist()


def test_nulls_empty_repeats_and_other_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello wörld", "c"), (3, "Hello wörld", "c"), (None, " x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = df.withColumn("code", bpe_encode("text", df, PATH, P.PATTERN))
    out = coded.withColumn("back", bpe_decode("code", coded, PATH, P.PATTERN)).collect()
    assert len(out) == 5
    for r in out:
        assert r["code"] == REFERENCE.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == (r["text"] or "").encode()
    both = df.withColumn("b", bpe_both("text", df, PATH, P.PATTERN)).collect()
    assert sorted((r["b"]["ids"], bytes(r["b"]["decoded"])) for r in both) == sorted((r["code"], bytes(r["back"])) for r in out)
    assert df.where(F.lit(False)).withColumn("code", bpe_encode("text", df, PATH, P.PATTERN)).count() == 0
