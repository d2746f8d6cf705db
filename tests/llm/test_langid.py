import numpy as np
import pyarrow as pa

from arggraph_spark.llm import langid, queries
from arggraph_spark.llm.common import buffers

EN = "the quick thinking of those with that which they have there and then the other things were thought through "
DE = "und nicht schlecht auch eine schöne straße zwischen den häusern für die menschen über das gebirge wäre "


def brute_em(like, rounds):
    """One text's proportions and log-likelihood, word by word."""
    share = [1 / len(like[0])] * len(like[0])
    for _ in range(rounds):
        sums = [0.0] * len(share)
        for w in like:
            p = [a * b for a, b in zip(w, share, strict=True)]
            for k, x in enumerate(p):
                sums[k] += x / sum(p)
        share = [s / len(like) for s in sums]
    return share, sum(np.log(sum(a * b for a, b in zip(w, share, strict=True))) for w in like)


def test_em_against_brute_force():
    rng = np.random.default_rng(1)
    like = rng.random((30, 3))
    n = np.array([10, 15, 5])
    first = np.cumsum(n) - n
    share, fit = langid._em(like, np.repeat(np.arange(3), n), first, n, np.ones((3, 3)), 8)
    for d in range(3):
        want = brute_em(like[first[d] : first[d] + n[d]].tolist(), 8)
        assert np.allclose(share[d], want[0]) and np.isclose(fit[d], want[1])


def test_mixture_and_odd_texts(spark, documents, odd_texts):
    train = documents([EN, DE] * 4, langs=["en", "de"] * 4)
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    texts = [EN * 3, DE * 3, EN * 6 + DE * 3, None, "", "123 !!! …🎉", *odd_texts]
    rows = {r.doc_id: r for r in langid.predict(documents(texts, extra=True), model, ["doc_id"]).collect()}
    assert (rows[0].lang_pred, rows[1].lang_pred, rows[2].lang_pred) == ("en", "de", "en")
    assert rows[0].mixture.startswith("en:1") and " de:" in rows[2].mixture and 0.6 < rows[2].score < 0.75
    for i, t in enumerate(texts):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= rows[i].score <= 1
    kept = langid.keep_languages(documents(texts, extra=True), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.lang_pred != "und" and r.known >= langid.KNOWN_SHARE}
    assert kept.columns == documents(texts, extra=True).columns


def test_texts_do_not_influence_each_other(spark, documents):
    model = langid.fit(documents([EN, DE], langs=["en", "de"]))
    texts = [EN, "", DE * 2, "x", EN + DE, "a", None, DE + EN * 2]
    data, offs = buffers(pa.array(texts, pa.string()))
    together, _ = langid.mixtures(data, offs, model)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], langid.mixtures(*buffers(pa.array([t], pa.string())), model)[0][0], atol=1e-5)


def test_nothing_learned_and_empty(spark, documents):
    none = langid.fit(documents(["x", "y"]))
    assert [r.lang_pred for r in langid.predict(documents(["abc"]), none, ["doc_id"]).collect()] == ["und"]
    assert langid.predict(documents(["abc"]).filter("false"), none, ["doc_id"]).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op3_language_mixture(spark, sf).collect() if r.held_out]
    assert len(rows) > 150
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97


def test_text_in_no_learned_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "'x' as _lang_pred", "1 as _lang_known")
    model = langid.fit(docs.filter(~langid.held_out()))
    some = [r.text for r in docs.filter("lang is not null").orderBy("doc_id").limit(20).collect()]
    odd = [None, "", "123 --- 45", "Это совсем другой язык, его никто не учил", "日本語の文章です。これは学習されていません。", "qxzj wvkq zzxq jjqx vvwq xkcd qqzx"]
    rows = [(i, t, None, "x", 1) for i, t in enumerate(some + odd + some[:1])]
    kept = langid.keep_languages(spark.createDataFrame(rows, docs.schema), model).collect()
    assert sorted(r.doc_id for r in kept) == [*range(20), 26] and kept[0]._lang_pred == "x"


def test_only_the_commonest_languages_are_learned(documents, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    model = langid.fit(documents(["one two"] * 3 + ["un deux"] * 2 + ["eins zwei"], langs=["en"] * 3 + ["fr"] * 2 + ["de"]))
    assert model.languages == ["en", "fr"]
