import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as model

from loomgrid.llm.tokencount import Counter, read_pieces, token_count, zipf_score

PATH = P.path("piece_bpe_32k.model")


def unigram_reading():
    """The library's own unigram tokenizer over the same pieces and scores."""
    proto = model.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        if piece.type == model.ModelProto.SentencePiece.NORMAL:
            piece.score = zipf_score(i)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


REFERENCE, OWN = unigram_reading(), Counter(*read_pieces(PATH))


@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghij thenrs.,\n ▁"), st.characters(exclude_categories=("Cs",), exclude_characters="\x00")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_equals_the_library(text):
    assert OWN.count(text) == len(REFERENCE.encode(text))


@pytest.mark.parametrize("text", ["", " ", "  a  ", "Thorreou haheor with  spaces", "日本語のテキスト", "🙂🙂", "a" * 200, "née être ça\n\nx"])
def test_fixed_texts(text):
    assert OWN.count(text) == len(REFERENCE.encode(text))


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "the end", 7), (3, "the end", 7)], "doc_id long, text string, n_tokens long")
    rows = df.withColumn("count", token_count("text", df, PATH)).collect()
    assert [r["count"] for r in rows] == [0, 0, len(REFERENCE.encode("the end")), len(REFERENCE.encode("the end"))]
