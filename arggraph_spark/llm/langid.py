"""Language mixtures of documents: expectation-maximisation over words, each with its n-gram likelihood in every language.

A word's likelihood in a language is the product of smoothed byte trigram probabilities. A document's proportions
maximise the likelihood of its words under a mixture of languages; the set of languages is the one whose likelihood,
less a penalty that grows with the number of languages and the log of the number of words, is largest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, free_names, mapped, slices

#: Trigrams are hashed into so many buckets, the last 2**BITS numbers of a product.
BITS = 15
#: The model is fitted on at most about so many labelled rows, drawn by a hash of their id.
FIT_ROWS = 20_000
#: The commonest languages of the labelled rows, so many at most, are learned; this bounds the model's size.
MOST_LANGUAGES = 256
#: A document goes if fewer of its words than this share are likelier in some language than as noise (equal chances for all trigrams).
KNOWN_SHARE = 0.1

#: Letters in lower case; every other ASCII byte separates words.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages, float32


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a word the bucket of the trigram that ends there; the start of each word among them; words before each text."""
    c = np.full(len(data) + 2 * len(offs), 32, np.uint8)
    n = np.diff(offs)
    shift = np.repeat(np.arange(len(n), dtype=np.int64) * 2 + 2, n)
    c[np.arange(len(data)) + shift] = _CLASS[data]
    edges = offs + 2 * np.arange(len(offs))
    inside = c != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A word's trigrams end at its letters and at the separator after it.
    ends = inside.copy()
    ends[1:] |= inside[:-1]
    at = np.flatnonzero(ends)
    at = at[at >= 2]
    gram = (c[at - 2].astype(np.uint32) << 16) | (c[at - 1].astype(np.uint32) << 8) | c[at]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    starts = np.searchsorted(at, np.flatnonzero(first))
    return bucket, starts, np.searchsorted(np.flatnonzero(first), edges)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Counts trigrams of labelled rows (lang not null); of more than ``fit_rows`` such rows, of about that many.

    Rows without text or language teach nothing; an empty table gives a model without languages. At most
    ``MOST_LANGUAGES`` languages are learned, the commonest (of equally common ones the first in the alphabet). Long
    texts are taken whole. Only the three columns are read.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    by = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"))
    n = by.agg(F.sum("n")).first()[0] or 0
    languages = sorted(r[0] for r in by.orderBy(F.desc("n"), "_lang").limit(MOST_LANGUAGES).collect())
    if n > fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), "_key"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    rows = rows.filter(F.col("_lang").isin(languages))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "_text"):
            data, offs = buffers(b.column("_text"))
            bucket, starts, words = _trigrams(data, offs)
            edge = np.append(starts, len(bucket))[words]
            for i, lang in enumerate(b.column("_lang").to_pylist()):
                got = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                got += np.bincount(bucket[edge[i] : edge[i + 1]], minlength=1 << BITS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    def dense(t: pa.Table) -> pa.Table:
        counts = np.full(1 << BITS, 0.5)
        counts[t["bucket"].to_numpy()] += t["n"].to_numpy()
        logs = np.log(counts / counts.sum()).astype(np.float32)
        return pa.table({"lang": t["lang"].slice(0, 1), "logp": pa.array([logs.tobytes()], pa.binary())})

    counts = mapped(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    learned = dict(counts.groupBy("lang").applyInArrow(dense, "lang string, logp binary").collect())  # a row for each language
    # A language of which the drawn rows have no word is as good as unknown: all trigrams are equally likely.
    blank = np.full(1 << BITS, -BITS * np.log(2), np.float32).tobytes()
    logs = [np.frombuffer(learned.get(g, blank), np.float32) for g in languages]
    return Model(languages, np.stack(logs, axis=1) if logs else np.zeros((1 << BITS, 0), np.float32))


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihood of each text, of likelihoods (words x languages) that are scaled by word."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * share[doc]
        r /= r.sum(axis=1, keepdims=True)
        share = np.add.reduceat(r, first, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((like * share[doc]).sum(axis=1)), first)


def mixtures(data: np.ndarray, offs: np.ndarray, model: Model, rounds: int = 8, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's languages (texts x languages, float64), and its share of words likelier in some language
    than as noise; zeros for texts without words."""
    bucket, starts, words = _trigrams(data, offs)
    k = len(model.languages)
    out = np.zeros((len(offs) - 1, k))
    n = np.diff(words)
    some = np.flatnonzero(n)
    known = np.zeros(len(n))
    if not k or not len(some):
        return out, known
    logs = np.add.reduceat(model.logp[bucket], starts, axis=0)
    likely = logs.max(axis=1) > -BITS * np.log(2) * np.diff(np.append(starts, len(bucket)))
    known[some] = np.add.reduceat(likely.astype(np.float64), words[:-1][some]) / n[some]
    # No word is impossible in any language: the floor keeps one odd word from deciding a text.
    like = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True), dtype=np.float32), 1e-6)
    n, first = n[some], words[:-1][some]
    doc = np.repeat(np.arange(len(some)), n)
    share, _ = _em(like, doc, first, n, np.ones((len(some), k), np.float32), rounds)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best = np.full(len(some), -np.inf)
    chosen = np.zeros((len(some), k))
    at = np.arange(len(some))  # texts in play; going: those of them for which one more language paid
    going = at
    for size in range(1, k + 1):
        if len(going) < len(n):
            words_of = np.isin(doc, going)
            like, n = like[words_of], n[going]
            first = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(going)), n)
            rank = rank[going]
            at = at[going]
        got, fit_ = _em(like, doc, first, n, (rank < size).astype(np.float32), rounds if size > 1 else 1)
        worth = fit_ - penalty * size * np.log(n + 1.0)
        going = np.flatnonzero(worth > best[at])
        best[at[going]], chosen[at[going]] = worth[going], got[going]
        if not len(going):
            break
    out[some] = chosen
    return out, known


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "mixture", "known")) -> DataFrame:
    """``keep`` columns of every row, with its main language, that language's share (0 to 1), the mixture as "en:0.75 fr:0.25"
    and the share of words that are likelier in some language than as noise.

    A null text and one without a letter give ``und``, 0, an empty mixture and 0, as does a model that learned nothing.
    Of equal shares the language first in the alphabet wins. Repeated rows give repeated results; an empty table gives
    an empty one. Names of ``keep`` may be any but ``names``. A long text is a batch of its own, and takes about 20
    bytes and 8 for each language by byte of its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES x 2**BITS numbers
    inner = [f"c{i}" for i in range(len(keep))]
    text = inner[keep.index(text_col)] if text_col in keep else "text"

    def run(batches):
        m = shared.value
        for b in slices(batches, text, min(1 << 19, (32 << 20) // max(4 * len(m.languages), 1))):
            data, offs = buffers(b.column(text))
            share, known = mixtures(data, offs, m)
            letter = np.add.reduceat(np.append(((data | 32) - 97 < 26) & (data < 128), 0).astype(np.int64), offs[:-1]) * (np.diff(offs) > 0) > 0
            for i in np.flatnonzero(~letter & (np.diff(offs) > 0)):
                letter[i] = any(map(str.isalpha, b.column(text)[int(i)].as_py()))
            share[~letter], known[~letter] = 0, 0
            top = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), np.int64)
            best = share.max(axis=1) if share.shape[1] else np.zeros(len(share))
            pred = [m.languages[t] if s > 0 else "und" for t, s in zip(top.tolist(), best.tolist(), strict=True)]
            mixed = [" ".join(f"{m.languages[j]}:{row[j]:.4f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in share]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(np.minimum(best, 1.0), pa.float64()), pa.array(mixed, pa.string()), pa.array(known, pa.float64())], [*keep, *names])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    fields += [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.StringType(), T.DoubleType()), strict=True)]
    read = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)] + ([] if text_col in keep else [F.col(text_col).alias(text)])
    return mapped(docs.select(*read), run, T.StructType(fields))


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4) == 2


def keep_languages(docs: DataFrame, model: Model, text_col: str = "text", known_share: float = KNOWN_SHARE) -> DataFrame:
    """The rows of ``docs`` in which a language was recognised, with all their columns.

    Those without a letter go (null and empty texts among them), and those of which less than ``known_share`` of the
    words are likelier in some learned language than as noise: text in no learned language. Repeated rows fare alike; an
    empty table stays empty; no name of a column can clash; for long texts see ``predict``.
    """
    names = tuple(free_names(docs.columns, "_lang_pred", "_lang_score", "_lang_mixture", "_lang_known"))
    return predict(docs, model, docs.columns, text_col, names).filter((F.col(names[0]) != "und") & (F.col(names[3]) >= known_share)).drop(*names)
