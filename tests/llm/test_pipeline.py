"""The pipeline against its stages written out in plain Python."""

import random

import numpy as np
import public_tokenizers
import pytest
from test_exact import norm
from test_minhash import brute as near
from test_substring import brute as repeated
from test_tokens_packing import check_packed, pieces_of

import corpus_pipeline

WORD = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "und", "é", "ch", "a"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    base = text(60)
    texts = [text(rng.randrange(5, 200)) for _ in range(25)]
    texts += [text(10) + " " + passage + " é " + text(9), text(3) + passage + text(5), passage]
    texts += [base, base + " more", base.upper(), base.replace(" a", " b", 1), texts[0], texts[1].upper()]
    return [*texts, None, "", "123 !!!", "x", "X", "é" * 150 + "z" + "é" * 150]


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    texts = corpus()
    documents(texts, langs=[("en", "de", None)[i % 3] for i in range(len(texts))], extra=True).write.parquet(f"{path}/documents.parquet")
    return path, texts


def expected(texts):
    docs = {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    last = {norm(t): i for i, t in docs.items()}
    docs = {i: docs[i] for i in sorted(last.values())}
    docs = {i: docs[i] for i, (_, c) in near(docs, 5).items() if c == i}
    raw = [t.encode() for t in docs.values()]
    gone = repeated(raw, 200)
    return {i: np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for i, b, g in zip(docs, raw, gone, strict=True)}


def test_stages_and_result(spark, folder):
    from tokenizers import Tokenizer

    path, texts = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    want = expected(texts)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path))
        assert docs.columns == columns
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    tokenizer = Tokenizer.from_file(WORD)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, *p) for i, t in want.items() for p in pieces_of(tokenizer, t, 2048))
    check_packed(rows, 2048)


def test_empty(spark, documents, tmp_path):
    documents(["x"]).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
