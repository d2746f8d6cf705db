import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents(texts, ids=None, extra=False): a table of documents; extra adds columns with clashing names."""

    def make(texts, ids=None, langs=None, extra=False):
        ids = ids if ids is not None else range(len(texts))
        langs = langs if langs is not None else [None] * len(texts)
        rows = [(i, t, g, None, len(t) if t is not None else None) for i, t, g in zip(ids, texts, langs, strict=True)]
        schema = SCHEMA
        if extra:
            schema += ", kept boolean, length string, digest int, n_tokens string, sequence_id string"
            rows = [(*r, True, "x", 1, "y", None) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


ODD_TEXTS = [None, "", " ", "a", "A", "a b  c ", "  two  leading", "tab\tand\nlines\r\n\n end", "ünïcödé ﬁ é ß Ω İ 日本語 🎉", "<|endoftext|> <s> </s> ▁x ▁ y", "same text", "same text", "x" * 5000, "word " * 4000, "don't they'll 12 345 !!!  　  x\x1f y\x0bz", "́combining ́", "ΑΣ ΣΑΣ"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
