"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib

import pytest

from arggraph_spark.llm import spelling


def counted(rows, least_length, least, every):
    n = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least_length=6, least=5, every=199, times=5):
    n = counted(rows, least_length, least, every)
    form, number = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        number[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], number[w], n[form[w]] if form[w] else None))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, documents, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abé") for _ in range(r.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(r.choices(words, weights=[1.5 ** (i % 25) for i in range(60)], k=300)) for _ in range(12)]
    rows = list(enumerate(texts))
    got = spelling.variants(documents(texts, extra=True), least_length=2, least=1, every=5, times=2)
    assert result(got) == plain(rows, 2, 1, 5, 2)


def test_chains_of_forms(spark, documents):
    """A way of several steps: each word has five times the occurrences of the one before."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    text = " ".join(" ".join([w] * 5**i) for i, w in enumerate(chain))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(documents([text]), least=1, every=10**9).collect()}
    assert got == {w: (chain[i + 1] if i + 1 < len(chain) else None, chain[-1]) for i, w in enumerate(chain)}


def test_odd_texts(spark, documents, odd_texts):
    texts = [*odd_texts, None, "", "ÀÉÎöü×÷ß Àéîöü×÷ß STRASSE straße Straße", "abcdefg" * 200_000, "abcdef " * 300_000, "letter " * 7 + "lettre " * 3 + "Lettér " * 40] * 2
    ids = [*range(len(texts) - 1), None]
    rows = list(zip(ids, texts, strict=True))
    assert result(spelling.variants(documents(texts, ids=ids, extra=True), least_length=3, least=2)) == plain(rows, 3, 2)


def test_ties_and_doubled_letters(spark, documents):
    """Deleting either of two equal letters gives one word, so it is near once; of equal counts the smaller word wins."""
    text = "hello " * 2 + "helo " * 10 + "hallo " * 10 + "hell " * 10 + "helloo " * 3
    assert result(spelling.variants(documents([text]), least_length=4, least=1, every=10**9)) == plain([(0, text)], 4, 1, 10**9)


def test_empty_table(spark, documents):
    assert result(spelling.variants(documents(["a"]).limit(0))) == []


def test_counts_are_handed_on_in_parts(spark, documents, monkeypatch):
    texts = [" ".join(f"wort{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(500))] * 4
    want = plain(list(enumerate(texts)), 4, 1)
    assert result(spelling.variants(documents(texts), least_length=4, least=1)) == want
