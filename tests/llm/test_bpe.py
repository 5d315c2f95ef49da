import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm.bpe import Codec, Vocabulary, default_path, encode_documents, merge_word

CODEC, LIBRARY = Codec(Vocabulary.load(default_path())), Tokenizer.from_file(default_path())


def ids(packed):
    return np.frombuffer(packed, np.uint32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'abst1.é漢 \x85"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_same_as_library_and_round_trip(text):
    packed = CODEC.encode(text)
    assert ids(packed) == LIBRARY.encode(text, add_special_tokens=False).ids and CODEC.decode(packed).decode() == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 20_000, "ab " * 5_000, " \n \n", "don't  stop\n\nnow "])
def test_edges(text):
    assert ids(CODEC.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_merges_take_rank_then_place():
    merges = {0 << 32 | 1: (0, 2), 2 << 32 | 0: (1, 3)}
    assert merge_word(bytes([0, 1, 0, 1, 0]), list(range(256)), merges) == [2, 3]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (2, "", None), (None, "a b", "y")], "doc_id long, text string, n_tokens string")
    rows = encode_documents(docs, with_ids=True, with_text=True).collect()
    assert [r["n_tokens"] for r in rows] == [2, 0, 0, 2] and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[0]["decoded"] == "a b" and rows[0]["decoded_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert encode_documents(docs.limit(0)).count() == 0
