import random
import re
from collections import Counter

import numpy as np
import pytest

from arggraph_spark.llm import minhash, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(texts, size, percent=80):
    """{id: (set size, least id reachable)} by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x in range(len(ids)):
        a = sets[ids[x]]
        for y in range(x):
            b = sets[ids[y]]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                r, s = sorted((root(ids[x]), root(ids[y])))
                parent[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(seed, n=60):
    """Chains of edits, so that a group's ends are not alike themselves, and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(5):
        t = [rng.choice(words) for _ in range(rng.randrange(4, 120))]
        for _ in range(n // 5):
            t = list(t)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t) if rng.random() < 0.8 else " ".join(t).upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 5), (3, 2)])
def test_against_all_pairs(spark, documents, odd_texts, seed, size):
    texts = [*variants(seed), *odd_texts, "one two", "One  Two", "x"]
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(texts, extra=True), size).collect()}
    want = brute(dict(enumerate(texts)), size)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == r.first == (r.component_id == i) for i, r in got.items())
    assert Counter(Counter(v[1] for v in want.values()).values())[1] < len(texts)


def test_many_in_one_bucket_not_alike(spark, documents, monkeypatch):
    # All texts share every bucket of the first bands, which aren't alike; one star alone would lose links.
    real = minhash.bands
    monkeypatch.setattr(minhash, "bands", lambda sets, count=minhash.BANDS, *more: real(sets, count, *more) if more else np.zeros((len(sets), count), np.uint64))
    texts = variants(7, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(texts), 4).collect()}
    assert got == brute(dict(enumerate(texts)), 4)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_texts_are_hashed_once_a_round(documents, monkeypatch):
    plans, real = [], minhash.shared_buckets
    monkeypatch.setattr(minhash, "shared_buckets", lambda members: plans.append(members._jdf.queryExecution().optimizedPlan().toString()) or real(members))
    texts = [f"{' '.join(f'w{k}' for k in range(40))} {' '.join(f'x{i}y{k}' for k in range(20))}" for i in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(texts), size=4).collect()}
    assert got == {i: i for i in range(60)}
    assert len(plans) > 1 and not any("MapInArrow" in p for p in plans)  # buckets are read twice, what makes them only once


def test_words_whose_polynomial_hashes_agree(documents):
    # Sums over places modulo 2**64 can't tell these two words apart, whatever the base.
    rows = minhash.near_duplicates(documents([thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(1024)], ids=[1, 2, 3]), 4).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (3, 1)]
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join([thue_morse(1024, *x), *w[:3]]) for x in ("ab", "ba")]
    assert all(r.kept for r in minhash.near_duplicates(documents(texts), 4).collect())


def test_a_large_group_of_near_copies_and_its_neighbours(documents):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(texts), 4).collect()}
    want = brute(dict(enumerate(texts)), 4)
    assert got == want and len(set(want.values())) > 1


def test_columns_with_the_names_used_inside(spark, documents):
    t = " ".join(f"w{i}" for i in range(30))
    docs = documents([t, t + " x", None]).selectExpr("*", "'mine' as _id", "1 as _tx", "true as _first", "2 as _n", "3 as w")
    kept = minhash.keep_documents(docs, 4).collect()
    assert [(r.doc_id, r._id, r._tx, r._first, r._n, r.w) for r in sorted(kept, key=lambda r: r.doc_id)] == [(0, "mine", 1, True, 2, 3), (2, "mine", 1, True, 2, 3)]


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 40, 1000):
        hits = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 2**63, n * 6 // 5).astype(np.uint64) * np.uint64(2))
            a, b = np.sort(u[rng.permutation(len(u))[: len(u) * 10 // 11]]), u
            h = minhash.bands([a, b])
            hits.append((h[0] == h[1]).mean())
        assert abs(np.mean(hits) - (len(a) / len(u)) ** minhash.ROWS) < 0.12


def test_repeated_rows_null_ids_and_empty(spark, documents):
    t = " ".join(f"w{i}" for i in range(30))
    docs = documents([t, t, t + " x", None, "", t], ids=[1, 1, None, None, 2, None])
    rows = minhash.near_duplicates(docs, 4).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in rows) == [(0, -1), (0, 2), (27, 1), (27, 1), (27, 1), (28, 1)]
    kept = minhash.keep_documents(docs, 4).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (1, t), (2, "")]
    empty = documents(["x"]).filter("false")
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_documents(empty).collect() == []


def test_query_over_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(texts, 4)
    got = {r.doc_id: tuple(r) for r in queries.op5_minhash_near_dedup(spark, sf).collect()}
    assert got == {i: (i, n, c, c == i) for i, (n, c) in want.items()}


def test_similarities_that_the_bands_miss_are_refused(documents):
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents(["a b c"]), percent=79)
