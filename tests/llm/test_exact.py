import hashlib
from collections import defaultdict

import numpy as np
import pytest

from arggraph_spark.llm import fuse
from arggraph_spark.llm.exact import exact_dedup, keep_documents


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_against_brute_force(spark, documents, odd_texts, batches):
    texts = [*odd_texts, *odd_texts[3:9], "SAME text", "é", "É", None]
    docs = documents(texts, extra=True)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, batches=batches).collect()}
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in enumerate(texts) for g in [groups[norm(t)]]}
    assert sorted(r.doc_id for r in keep_documents(docs).collect()) == sorted(max(g) for g in groups.values())


def test_repeated_rows_and_null_ids(spark, documents):
    docs = documents(["t", "t", "T", "u", "u", "v"], ids=[1, 1, 1, None, None, None])
    rows = exact_dedup(docs).collect()
    assert len(rows) == 6
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, 1, True), (-1, 2, False), (-1, 2, True), (1, 3, False), (1, 3, False), (1, 3, True)]
    kept = keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == ["t", "u", "v"]


def test_empty_table(spark, documents):
    empty = documents(["x"]).filter("false")
    assert exact_dedup(empty).collect() == []
    assert keep_documents(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_filters_hold_all_their_keys(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, 50_000).astype(np.uint64)
    f = fuse.build(keys)
    assert fuse.probe(f, keys).all()
    assert fuse.probe(f, others).mean() < 0.01
