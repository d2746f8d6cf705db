import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from arggraph_spark.llm import fmindex, queries, suffixes, windows
from arggraph_spark.llm.substring import remove_repeated_bytes, remove_repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """For each sequence of symbols, which of them a repeated window covers."""
    count = Counter(tuple(t[i : i + window]) if not isinstance(t, bytes) else t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window]) if not isinstance(t, bytes) else t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def edges(gone):
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    passages = [[word() for _ in range(rng.randrange(20, 60))] for _ in range(4)]
    texts = []
    for _ in range(40):
        t = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            s = rng.randrange(len(p))
            t += p[s : s + rng.randrange(60)] + [word() for _ in range(rng.randrange(9))]
        texts.append(rng.choice([" ", "\n"]).join(t))
    return [*texts, texts[0], texts[0], "a b " * 40, "x" * 300, "xy" * 100]


@pytest.mark.parametrize("hot_runs, shard", [(2048, 1 << 20), (1, 1 << 20), (2048, 50)])
def test_words(spark, documents, odd_texts, hot_runs, shard):
    texts = [*corpus(1), *odd_texts]
    want = [WORD.findall(t or "") for t in texts]
    gone = brute(want, 9)
    got = {r.doc_id: r for r in remove_repeated_words(documents(texts, extra=True), 9, gram=3, hot_runs=hot_runs, shard_symbols=shard).collect()}
    assert sum(g.sum() for g in gone) > 300
    for i, (w, g) in enumerate(zip(want, gone, strict=True)):
        assert (got[i].n_words, got[i].n_removed, got[i].removed) == (len(w), g.sum(), edges(g))
        assert got[i].kept_text == " ".join(x for x, y in zip(w, g, strict=True) if not y)


@pytest.mark.parametrize("hot_runs, shard", [(2048, 1 << 20), (1, 1 << 20), (2048, 100)])
def test_bytes(spark, documents, odd_texts, hot_runs, shard):
    texts = [*corpus(2), *odd_texts]
    want = [(t or "").encode() for t in texts]
    gone = brute(want, 40)
    got = {r.doc_id: r for r in remove_repeated_bytes(documents(texts, extra=True), 40, gram=8, hot_runs=hot_runs, shard_symbols=shard).collect()}
    assert sum(g.sum() for g in gone) > 300
    for i, (w, g) in enumerate(zip(want, gone, strict=True)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].removed) == (len(w), g.sum(), edges(g))
        assert bytes(got[i].kept_bytes) == bytes(x for x, y in zip(w, g, strict=True) if not y)


def test_repeated_rows_null_ids_and_empty(spark, documents):
    t = " ".join(f"w{i}" for i in range(50))
    docs = documents([t, t, t + "x", "short"], ids=[1, 1, None, None])
    rows = remove_repeated_words(docs, 9).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(1, 0), (50, 49), (50, 50), (50, 50)]
    for f in (remove_repeated_words, remove_repeated_bytes):
        assert f(documents(["x"]).filter("false"), 9).collect() == []
        assert len(f(documents(["x", None]), 9).collect()) == 2


@pytest.mark.parametrize("kernel", [fmindex.repeats, suffixes.repeats])
def test_kernels(kernel, monkeypatch):
    for seed in range(40):
        rng = random.Random(seed)
        monkeypatch.setattr(suffixes, "BATCH_BYTES", rng.choice([7, 20, 1000]))
        window = rng.choice([8, 9, 16, 20])
        base = [rng.randrange(4) for _ in range(60)]
        texts = []
        for _ in range(rng.randrange(1, 8)):
            s = rng.randrange(40)
            texts.append(tuple([rng.randrange(200) for _ in range(rng.randrange(1, 5))] + base[s : s + rng.randrange(60)] + [rng.randrange(3) for _ in range(rng.randrange(30))]))
        count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
        want = [count[t[i : i + window]] > 1 for t in texts for i in range(len(t) - window + 1)]
        got = kernel(np.array([x for t in texts for x in t], np.uint64), np.append(0, np.cumsum([len(t) for t in texts])), window)
        assert got.tolist() == want


def test_leftmost_least():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 7, 8, 9):
        v = rng.integers(0, 9, 60).astype(np.uint32)
        assert windows.leftmost_least(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(60 - width + 1)]


def test_queries_over_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = [WORD.findall(t) for t in texts.values()]
    want = {}
    for i, w, g in zip(texts, words, brute(words, 35), strict=True):
        want[i] = (i, len(w), int(g.sum()), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest())
    assert {r.doc_id: tuple(r) for r in queries.op6_substring_dedup(spark, sf).collect()} == want
    raw = [t.encode() for t in texts.values()]
    want = {}
    for i, w, g in zip(texts, raw, brute(raw, 200), strict=True):
        want[i] = (i, len(w), int(g.sum()), len(edges(g)) // 2, hashlib.sha256(np.frombuffer(w, np.uint8)[~g].tobytes()).hexdigest())
    assert {r.doc_id: tuple(r) for r in queries.op9_suffix_array_dedup(spark, sf).collect()} == want


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_contents_whose_polynomial_hashes_agree(documents):
    # Sums over places modulo 2**64 can't tell these apart, whatever the base: as words, as runs of words and as bytes.
    w = [f"w{i}" for i in range(8)]
    texts = [" ".join([*w, thue_morse(1024, *x)]) for x in ("ab", "ba")]
    assert [r.n_removed for r in remove_repeated_words(documents(texts), 9, gram=3).collect()] == [0, 0]
    texts = [" ".join(thue_morse(1024, *x)) for x in ("ab", "ba")]
    got = {r.doc_id: r for r in remove_repeated_words(documents(texts), 9, gram=3).collect()}
    for i, g in enumerate(brute([t.split() for t in texts], 9)):
        assert got[i].removed == edges(g)
    texts = [thue_morse(2048, *x) for x in ("ab", "ba")]
    for hot_runs in (2048, 1):
        got = {r.doc_id: r for r in remove_repeated_bytes(documents(texts), 700, gram=24, hot_runs=hot_runs).collect()}
        for i, g in enumerate(brute([t.encode() for t in texts], 700)):
            assert got[i].removed == edges(g)


def test_long_texts_are_taken_in_parts(documents):
    rng = random.Random(8)
    long_ = " ".join(str(rng.randrange(10**9)) for _ in range(400_000))  # about 4 MB
    passage = long_[1_048_400:1_048_900]
    got = {r.doc_id: r for r in remove_repeated_bytes(documents([long_, "before " + passage + " after", "x" * 3_000_000]), 200).select("doc_id", "n_removed", "removed").collect()}
    at = long_.index(passage)
    assert got[0].removed[0] in range(at - 9, at + 1) and got[0].n_removed in range(500, 520) and len(got[0].removed) == 2
    assert got[2].n_removed == 3_000_000


@pytest.mark.parametrize("unit", ["x", "ab", "-=", "abcdefghij", "".join(chr(33 + i) for i in range(90)), "".join(chr(33 + i % 94) for i in range(170)) + "\n"])
def test_periodic_texts_make_few_runs(unit):
    text = np.frombuffer((unit * (3_000_000 // len(unit) + 1)).encode()[:3_000_000], np.uint8)
    n = windows.runs(text, np.array([0, len(text)]), 200, 24)
    assert len(n[0]) <= len(text) // 200
    assert n[2].sum() == len(text) - 199


def test_periodic_texts(documents):
    """Texts of a short period, cut at other places, with something between; equal to brute force."""
    texts = ["x" * 5000, "xy" * 2500, "y" + "xy" * 1300, "=" * 79 + "\n" + "=" * 2300, "abc" * 20 + "d" + "abc" * 900, "q" + "0" * 3000 + "q", "xyz " * 700, "".join("ab"[bin(i).count("1") % 2] for i in range(4096)), "z" * 41]
    for run_windows in (1024, 50):
        windows.RUN_WINDOWS, before = run_windows, windows.RUN_WINDOWS
        try:
            for hot_runs in (2048, 1):
                got = {r.doc_id: r for r in remove_repeated_bytes(documents(texts), 40, gram=8, hot_runs=hot_runs).collect()}
                for i, g in enumerate(brute([t.encode() for t in texts], 40)):
                    assert got[i].removed == edges(g)
        finally:
            windows.RUN_WINDOWS = before
    got = {r.doc_id: r for r in remove_repeated_words(documents([" ".join(t) for t in texts]), 12, gram=3).collect()}
    for i, g in enumerate(brute([tuple(t.split()) for t in (" ".join(t) for t in texts)], 12)):
        assert got[i].removed == edges(g)


def test_any_names_of_columns(documents):
    docs = documents([None, "a b c " * 30]).selectExpr("*", "'i' as _id", "'t' as _tx", "'x' as _text", "'s' as spans")
    got = remove_repeated_bytes(docs, 20, columns=["doc_id", "_id", "_tx", "_text", "spans"], gram=8).collect()
    assert sorted((r.doc_id, r._id, r._tx, r._text, r.spans, r.n_removed) for r in got) == [(0, "i", "t", "x", "s", 0), (1, "i", "t", "x", "s", 180)]
