"""Packing and names of long documents against folds in Python."""

import random

import pytest
from pyspark.sql import functions as F

from arggraph_spark.operators import extraction, sequences


def packed(items, budget):
    number, used = -1, 0
    for _, t, turn in items:
        if number < 0 or used + t > budget or (turn and used * 2 >= budget):
            number, used = number + 1, 0
        used += t
        yield number


@pytest.mark.parametrize("local", [0, 20, 200_000])
@pytest.mark.parametrize("budget, most", [(1, 3), (7, 9), (50, 12), (64, 300)])
def test_chunk_numbers_equal_the_fold(spark, monkeypatch, budget, most, local):
    monkeypatch.setattr(sequences, "BLOCK", 16)
    monkeypatch.setattr(sequences, "LOCAL", local)
    rng = random.Random(budget)
    docs = {d: [(i, rng.randint(1, most), rng.random() < p) for i in range(n)] for d, (n, p) in enumerate([(1, 0.5), (2, 1.0), (150, 0.0), (150, 0.2), (90, 1.0), (40, 0.01)])}
    rows = spark.createDataFrame([(d, *x) for d, items in docs.items() for x in items], "doc_id long, i long, t long, turn boolean")
    got = {(r.doc_id, r.i): r.chunk for r in sequences.chunk_numbers(rows, budget).collect()}
    assert got == {(d, i): n for d, items in docs.items() for i, n in enumerate(packed(items, budget))}
    assert sequences.chunk_numbers(rows.filter("false"), budget).collect() == []


def test_chunks_of_long_documents_go_to_joins(spark, monkeypatch):
    text = "\n\n".join(x for i in range(60) for x in ([f"# H{i}"] if i % 7 == 0 else []) + ["word " * (1 + i * 5 % 17)])
    docs = spark.createDataFrame([(1, text), (2, "a\n\nb"), (3, None)], "doc_id long, text string")
    paragraphs = extraction.paragraphs(docs)
    folded = sorted(extraction.chunks(paragraphs, 40).collect())
    monkeypatch.setattr(extraction, "LONG", 10)
    assert sorted(extraction.chunks(paragraphs, 40).collect()) == folded and len(folded) > 5


def test_chunks_of_a_document_of_a_hundred_thousand_paragraphs(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("i"), (F.col("id") * 7919 % 90 + 1).alias("t"), (F.col("id") % 37 == 0).alias("turn"))
    got = [r.chunk for r in sequences.chunk_numbers(rows, 600).orderBy("i").collect()]
    assert got == list(packed(((i, i * 7919 % 90 + 1, i % 37 == 0) for i in range(n)), 600))


def test_unique_names_equal_the_walk(spark):
    rng = random.Random(5)
    pool = ["a", "a-2", "a-2-2", "a-3", "b", "b-1", "c-2", "", "-2", "d", "a-02", "e-10"]
    docs = {d: [rng.choice(pool[: rng.randint(1, 12)]) for _ in range(n)] for d, n in enumerate((1, 5, 40, 60, 12))}
    docs[9] = ["x"] * 30_000
    rows = spark.createDataFrame([(d, i, x) for d, names in docs.items() for i, x in enumerate(names)], "doc_id long, seq long, name string")

    def walked(names):
        taken = set()
        for base in names:
            name, n = base, 1
            while name in taken:
                n += 1
                name = f"{base}-{n}"
            taken.add(name)
            yield name

    got = {(r.doc_id, r.seq): r.unique for r in extraction.unique_names(rows, "name", ["seq"]).collect()}
    assert all(got[d, i] == x for d, names in docs.items() if d < 9 for i, x in enumerate(walked(names)))
    assert [got[9, i] for i in range(30_000)] == ["x", *(f"x-{i}" for i in range(2, 30_001))]


def test_chains_of_merges_end_in_few_rounds(spark):
    links = [("d", f"s{i}", f"s{i + 1}") for i in range(300)]
    links += [("e", "x", "a"), ("e", "a", "b"), ("e", "b", "a"), ("e", "y", "z"), ("e", "s3", "q"), ("e", "o", "o")]
    got = {(r.doc_id, r.ref): r.end for r in extraction.chain_ends(spark.createDataFrame(links, "doc_id string, dropped string, kept string")).collect()}
    want = {("d", f"s{i}"): "s300" for i in range(300)}
    assert got == want | {("e", "x"): "a", ("e", "a"): "a", ("e", "b"): "b", ("e", "y"): "z", ("e", "s3"): "q", ("e", "o"): "o"}
