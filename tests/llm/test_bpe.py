import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from arggraph_spark.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, PATH)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


WHITE = ["a  b", "a \n b", " a", "  a", "a\n\n b", "a \nb", "a\t b ", " \n ", "a　 b", "x \x1f y", "a\x85 b", "a b\n", "foo  \n  bar  "]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("block, fold", [(32 << 20, 1024), (40, 1024), (2000, 8)])
def test_against_the_library(spark, documents, odd_texts, ranks, library, block, fold):
    texts = [*odd_texts, *WHITE, *(["the same words again and again "] * 8), "y" * 3000 + " z" * 300]
    coded = bpe.encode(documents(texts, extra=True), ranks, PATTERN, block_bytes=block, fold_bytes=fold)
    got = {r.doc_id: r for r in bpe.decode_ids(coded, ranks).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or ""), t
        assert bytes(got[i].bytes) == (t or "").encode()


def test_ids_may_be_null_repeated_or_text(documents, ranks, library):
    docs = documents(["a b", "a b", "c"], ids=[1, 1, None]).selectExpr("cast(doc_id as string) as doc_id", "text", "1 as _key", "2 as _text", "3 as block")
    got = bpe.encode(docs, ranks, PATTERN).collect()
    assert sorted((r.doc_id or "", r.ids) for r in got) == [("", library.encode_ordinary("c")), *[("1", library.encode_ordinary("a b"))] * 2]


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        codes = (2 ** rng.uniform(0, 31, n)).astype(np.int64) - 1
        assert (bpe.unpacked(bpe.packed(codes)) == codes).all()


def test_native_fold_and_decoding(spark, ranks, library):
    words = ["", None, "a", " the", "Thntblere", " Großbritannien", "ü", "🎉", "日本語", "aaaaaaaaaaa", " zzzzqqq", "éàü" * 5]
    words += ["".join(random.Random(i).choice("aeinrst ") for _ in range(12)).strip() or "x" for i in range(40)]
    df = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks)
    rows = bpe.decode_ids(df, ranks).collect()
    assert len(rows) == len(words)
    for r in rows:

        assert r.ids == bpe.fold((r.word or "").encode(), ranks)
        assert bytes(r.bytes) == (r.word or "").encode()


@pytest.mark.parametrize("n", [2, 30, 64, 65, 200, 3000])
def test_fold_against_the_library(ranks, library, n):
    rng = random.Random(n)
    for alphabet in ("ab", "etaoin", "x"):
        word = "".join(rng.choice(alphabet) for _ in range(n))
        assert bpe.fold(word.encode(), ranks) == library.encode_ordinary(word)


def test_query_over_the_small_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, sf).collect():
        assert tuple(r)[1:] == expected(library, texts[r.doc_id])


def test_empty_table(spark, documents, ranks):
    assert bpe.encode(documents(["x"]).filter("false"), ranks, PATTERN).collect() == []
