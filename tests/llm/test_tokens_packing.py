import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from arggraph_spark.llm import packing, queries
from arggraph_spark.llm.tokens import count_tokens, token_pieces

SP = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys(spark, documents, odd_texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {r[0]: (r[1], r[2]) for r in count_tokens(documents(odd_texts, extra=True), SP).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(odd_texts)}


def test_counts_over_the_small_table(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, sf).collect():
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len(texts[r.doc_id].encode()))


def pieces_of(tokenizer, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(p, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]


def test_pieces_are_the_librarys(spark, documents, odd_texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    got = defaultdict(list)
    for r in token_pieces(documents(odd_texts, extra=True), WORD, 64, with_ids=True).collect():
        assert len(r.ids) == r.length
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {i: pieces_of(tokenizer, t, 64) for i, t in enumerate(odd_texts)}


def test_chunks_of_letters_and_marks(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    texts = ["Éire, ÀÉÎõü!! straße. Þorn;", "a,b c.. d|e |", "ÿÀ× ÷x ªº µm", "it's don't! 'tis", "WORD, word word! Word?", "x1 1x ,,x e\u0301a", "\u2028a\u2003b\x85c", "<|endoftext|>, <|startoftext|>x"]
    got = defaultdict(list)
    for r in token_pieces(documents(texts), WORD, 64).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert dict(got) == {i: pieces_of(tokenizer, t, 64) for i, t in enumerate(texts)}


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_best_fit_packing(spark, sf).collect()
    want = sorted((i, *p) for i, t in texts.items() for p in pieces_of(tokenizer, t, 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_packed(rows, 2048) == -(-sum(w[3] for w in want) // 2048)


def exhaustive(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plans_against_exhaustive_search(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
    made = packing.plan(Counter(items), 20)
    assert all(sum(p) <= 20 for _, p in made)
    assert Counter(s for t, p in made for s in p for _ in range(t)) == Counter(items)
    assert sum(t for t, _ in made) == exhaustive(items, 20)


@pytest.mark.parametrize("seed", range(4))
def test_planted_optimum_of_many_sizes(seed):
    """Triples that fill 2048 exactly: only plans without any waste are best."""
    rng = random.Random(seed)
    items = []
    while len(items) < 60:
        a, b = rng.randint(520, 1000), rng.randint(520, 1000)
        if 520 <= 2048 - a - b <= 1000:
            items += [a, b, 2048 - a - b]
    histogram = Counter(items)
    assert len(histogram) > 48
    made = packing.plan(histogram, 2048)
    assert all(sum(p) <= 2048 for _, p in made)
    assert Counter(s for t, p in made for s in p for _ in range(t)) == histogram
    assert sum(t for t, _ in made) == 20


def test_pack_ties_repeats_and_empty(spark):
    same = spark.createDataFrame([(1, 0, 7)] * 50 + [(None, 0, 3)] * 50, "doc_id long, piece int, length long").repartition(5)
    rows = packing.pack(same, 10).collect()
    assert len(rows) == 100 and check_packed(rows, 10) == 50
    assert packing.pack(same.filter("false"), 10).collect() == []
    with pytest.raises(ValueError):
        packing.pack(same, 5)


def test_empty_tables(spark, documents):
    empty = documents(["x"]).filter("false")
    assert count_tokens(empty, SP).count() == 0
    assert token_pieces(empty, WORD, 8).count() == 0
