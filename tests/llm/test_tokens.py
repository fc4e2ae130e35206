import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.llm import tokens as T

PATH = f"{T.TOKENIZERS}/{T.BYTE_BPE_50K}"


@pytest.fixture(scope="module")
def enc():
    return T.encoding(PATH)


@pytest.fixture(scope="module")
def other():
    """Another implementation with the same vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_every_token_encodes_to_itself(enc):
    # what the exactness of the joins rests on
    for t in range(enc.n_vocab - 1):
        assert enc._core_bpe.encode_single_piece(enc.decode_single_token_bytes(t)) == [t]


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_is_exact(enc, seed):
    r = random.Random(seed)
    alphabet = ["abcdefgh", "etaoinshr", "人口普查名单图幅", "=-_", "aA", "éèàü"][seed]
    for n in (1, 7, 50, 3000):
        word = "".join(r.choice(alphabet) for _ in range(n)) + "the" * (n // 10)
        whole = enc._core_bpe.encode_single_piece(word.encode())
        for limit in (1, 3, 17, 400):
            parts = [np.asarray(enc._core_bpe.encode_single_piece(p.encode()), np.uint32) for p in T._halves(word, limit)]
            for window in (1, 8):
                assert T.join_all(enc, parts, window).tolist() == whole


def joined(enc, text, limit):
    parts = T.segments(text, limit)
    assert "".join(p for _, p in parts) == text
    return T.join_parts(enc, [(k, T.encode_part(enc, k, p)) for k, p in parts]).tolist()


def test_segments_keep_the_text_and_the_words(enc):
    text = "It's 1870's  big\n\n\n   map " * 50 + "x" * 500 + " 人口普查名单" * 40 + "!!!'s"
    for limit in (1, 5, 40, 10_000):
        assert joined(enc, text, limit) == enc.encode_ordinary(text)


GAPS = ["\n\n", "\r\n\r\n", "\n\n\n", "\t", "\t\t", " \t ", "\xa0", "\xa0\xa0", "  ", "   \n", "\n ", "\u3000", "\u2028\n", "\x85\x85", "\x1c\x1c", " " * 60, "\n" * 45, ""]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_in_any_white_space_are_exact(enc, seed):
    r = random.Random(seed)
    words = ["map", "L'été", "1870", "人口普查", "!!", "…", "'s", "don't", "a" * 30, "=" * 25, "7" * 40, "\u0301", "ß", "😀"]
    text = "".join(r.choice(words) + r.choice(GAPS) for _ in range(150))
    whole = enc.encode_ordinary(text)
    for limit in (1, 2, 3, 4, 5, 7, 10, 16, 24, 33, 64, 200):
        assert joined(enc, text, limit) == whole


@pytest.mark.parametrize("gap", ["\n\n", "\r\n\r\n", "\n\n\n", "\t", "\xa0"])
def test_text_over_a_million_characters(spark, enc, gap):
    r = random.Random(gap)
    text = "".join(" ".join("map river 1870 council, é".split()[r.randrange(5)] + str(r.randrange(99)) for _ in range(30)) + gap for _ in range(6_000))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert T.encode(df, "text", "ids").first()["ids"] == enc.encode_ordinary(text)


def test_every_row_through_the_long_path(spark, sf):
    from stratamesh.llm.queries import p7_ids, p7_joined

    ids = lambda q: {r.doc_id: r.ids for r in q(spark, sf).collect()}
    assert ids(p7_joined) == ids(p7_ids)


def test_encode_frame(spark, other):
    texts = [None, "", " ", "<|endoftext|> is text", "naïve café 人口", "tab\tand \xa0 space", "a" * 5000, "word " * 3000 + "z" * 4000, "word " * 3000 + "z" * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, text string, ids string")
    got = {r.id: r.ids for r in T.encode(df, "text", "ids", long_chars=1000, segment_chars=300).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (other(t) if t else [])
    n = {r.id: r.n for r in T.encode(df, "text", "n", count_only=True, long_chars=1000, segment_chars=300).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_encode_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    out = T.encode(df, "text", "ids")
    assert out.dtypes == [("id", "bigint"), ("text", "string"), ("ids", "array<int>")] and out.count() == 0


def test_corpus_against_the_other_implementation(spark, sf, other):
    from stratamesh.llm.queries import p7_ids

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in p7_ids(spark, sf).collect()}
    assert got == {k: other(t) if t else [] for k, t in docs.items()}
