import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import tokens as K

if not os.path.exists(K.DEFAULT_VOCABULARY):
    pytest.skip("no vocabulary files here", allow_module_level=True)

TEXTS = ["Hello world", "<|endoftext|> is text", "", None, "ἐν τῶι 木簡 🏀", "a" * 30_000, "x\r\n\ty  ", "Hello world"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    flat, sizes, _ = K._encode([text], K.DEFAULT_VOCABULARY, False)
    assert K.decode_ids(flat.tolist()) == text and len(flat) == sizes[0]


def test_corpus(spark):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in K.encode_corpus(df, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and got[0] == got[7] and 50256 not in got[1]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(TEXTS) if x)
    back = {r["doc_id"]: r["text"] for r in K.decode_corpus(K.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    n = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert K.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_offsets_cover_split_characters(spark):
    text = "ἐν 🏀 ab"
    r = K.encode_corpus(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", offsets=True).first()
    covered = set()
    for a, b in zip(r["starts"], r["ends"]):
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))
    cut = K.decode_ids(r["ids"][:1])
    assert cut == "�" or text.startswith(cut)


def test_byte_table_is_a_bijection():
    table = K.byte_characters()
    assert sorted(table) == list(range(256)) and len(set(table.values())) == 256


def test_counting_agrees_with_encoding():
    texts = ["", "a b  c\n\n", "Größe 12 κόσμος", "x" * 5000, "a b  c\n\n", "<|endoftext|>"]
    sizes, counts = K.count_and_fold(texts, K.DEFAULT_RANKS, 64)
    assert sizes.tolist() == [len(K._encode([x], K.DEFAULT_VOCABULARY, False)[0]) for x in texts] == counts.sum(axis=1).astype(int).tolist()
