"""Windows of a fixed number of symbols that occur more than once in a corpus.

Comparing every text with an index of every other text grows with the square of a corpus. Here a window goes to one
shard only, chosen by its content: its anchor is the gram of least hash in it (the leftmost of equals), so all
occurrences of a window have one anchor. Neighbouring windows of a text whose anchors are equal in content form a run,
which is handled as one piece of text; in a periodic text the anchor moves on from one period to the next, and a run is
cut after a number of windows. Anchors that occur at one place only can't hold a repeated window. Runs that are equal as a whole are counted
where they are read and stand for each other, so copies of whole texts cost one run. What is left - different runs
under one anchor - is settled by an index over the runs of a shard, which the caller brings as ``kernel``. Anchors with
very many different runs would load one shard; their windows are spread by their own digests and counted. Runs and
windows that stand for each other are equal in 128 bits of BLAKE2 over their whole content; shorter hashes only route.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, buffers, digests, mapped, materialize, slices, window_hash, words_of

#: Different runs of one anchor beyond which its windows are spread by their own hashes.
HOT_RUNS = 2048
#: Parts in which equal runs are counted.
SALTS = 64
#: Symbols of one index.
SHARD_SYMBOLS = 1 << 20
#: Windows of a run, however far its anchor's content goes on.
RUN_WINDOWS = 1024
#: Symbols of a long text that are handled at once.
SPLIT_BYTES = 1 << 20

#: A column of texts -> symbols (bytes, or rows of 128-bit hashes of words) and the offsets of the texts among them.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: (symbols of the runs, offsets, window) -> for each run's window, in order, whether it occurs in another place
Kernel = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost least of values[i : i + width] (as far as there are so many)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    v, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span * 2 <= width:
        take = v[span:] < v[:-span]
        at = np.where(take, at[span:], at[:-span])
        v = np.where(take, v[span:], v[:-span])
        span *= 2
    rest = width - span
    if rest:
        take = v[rest:] < v[:-rest]
        at = np.where(take, at[rest:], at[:-rest])
    return at[:n]


def octets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return buffers(col)


def words(known: WordHashes) -> Symbols:
    return lambda col: known.rows(words_of(col))


def first_lane(symbols: np.ndarray) -> np.ndarray:
    return symbols[:, 0].copy() if symbols.ndim > 1 else symbols.astype(np.uint64)


def runs(symbols: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start within the text, windows, anchor hash, anchor places, content digest (n x 2)) of every run."""
    none = np.zeros(0, np.int64)
    n = np.maximum(np.diff(offs) - window + 1, 0)  # windows of each text
    if not n.sum():
        return none, none, none, none, none, none.reshape(0, 2)
    h = window_hash(first_lane(symbols), gram)
    at = leftmost_least((h >> np.uint64(32)).astype(np.uint32), window - gram + 1)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    start = np.arange(len(text)) + np.repeat(offs[:-1] - first, n)
    anchor = at[start]
    gram_of = h[anchor]
    new = np.empty(len(text), bool)
    new[0] = True
    new[1:] = (gram_of[1:] != gram_of[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(new)
    length = np.diff(np.append(lead, len(text)))
    if length.max() > RUN_WINDOWS:
        pieces = -(-length // RUN_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lead = np.repeat(lead, pieces) + nth * RUN_WINDOWS
    count = np.diff(np.append(lead, len(text)))
    moved = np.append(0, anchor[1:] != anchor[:-1])
    moved[lead] = 1
    s = start[lead]
    return text[lead], s - offs[text[lead]], count, gram_of[lead].view(np.int64), np.add.reduceat(moved, lead), digests(symbols, s, s + count + window - 1)


def parts_of(b: pa.RecordBatch, symbols: Symbols, window: int, size: int = SPLIT_BYTES) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """The rows with their symbols and offsets; a text of more than ``size`` bytes in parts that share window - 1 symbols.

    Yields (rows, symbols before the part in its text, symbols, offsets). The parts of a text hold every window once.
    A run that a cut divides becomes two, with one anchor; both are settled by content, so results don't depend on it.
    """
    if b.num_rows > 1 or b.column("_text")[0].as_py() is None or len(b.column("_text")[0].as_buffer()) <= size:
        yield (b, 0, *symbols(b.column("_text")))
        return
    values, offs = symbols(b.column("_text"))
    step = max(size, 2 * window)
    for at in range(0, max(int(offs[-1]) - window + 1, 1), step):
        part = values[at : at + step + window - 1]
        yield b, at, part, np.array([0, len(part)])


def _taken(values: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans [s, s + n) of ``values`` one after another, and their offsets."""
    offs = np.append(0, np.cumsum(n))
    return values[np.repeat(s - offs[:-1], n) + np.arange(offs[-1])], offs


def _ranges(flags: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Maximal runs of true within each part, as a list of alternating start and end."""
    f = np.zeros(len(flags) + 2, np.int8)
    f[1:-1] = flags
    inner = offs[1:-1]
    up = (f[1:-1] == 1) & (f[:-2] == 0)
    down = (f[1:-1] == 1) & (f[2:] == 0)
    inner = inner[(inner > 0) & (inner < len(flags))]
    up[inner] |= flags[inner]
    down[inner - 1] |= flags[inner - 1]
    a, b = np.flatnonzero(up), np.flatnonzero(down) + 1
    part = np.searchsorted(offs, a, side="right") - 1
    pairs = np.stack([a - offs[part], b - offs[part]], axis=1).ravel().astype(np.int32)
    lists = np.append(0, np.cumsum(np.bincount(part, minlength=len(offs) - 1))) * 2
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(pairs, pa.int32()))


def _met(right: DataFrame) -> DataFrame:
    """All these sides grow with the corpus, so they are shuffled at every size."""
    return right.hint("merge")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _tx, text): rows equal in both keys have equal texts, and get equal results."""
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), F.xxhash64(text_col).alias("_tx"), F.col(text_col).alias("_text"))


def repeated_windows(docs: DataFrame, symbols: Callable[[], Symbols], kernel: Kernel, window: int, gram: int, width: int, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(_id, _tx, spans): for each text that has repeated windows the ranges [s0, e0, s1, e1, ...] of their starts.

    ``width``: bytes of a symbol in which runs are sent to their shard (1 or 8). Materialized; keys as in ``keyed``.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = symbols()
        for rows_ in slices(batches, "_text", 1 << 18):
            for b, before, values, offs in parts_of(rows_, cut_up, window):
                text, s, n, a, p, h = runs(values, offs, window, gram)
                if len(text):
                    t = pa.array(text, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("_id").take(t), b.column("_tx").take(t), pa.array(a, pa.int64()), *(pa.array(h[:, k].copy(), pa.int64()) for k in (0, 1)), pa.array(s + before, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.int32())], ["_id", "_tx", "a", "h", "k", "s", "n", "p"])

    found = materialize(mapped(rows, find, "_id string, _tx long, a long, h long, k long, s int, n int, p int"))
    again = materialize(found.groupBy("a").agg(F.sum("p").alias("p")).filter("p > 1").select("a"))
    # Dealt anew by their content and a salt, so that the join may split an anchor of very many runs and equal runs of
    # very many copies are counted in parts.
    some = found.join(_met(again), "a", "left_semi").withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).repartition("h", "k", "salt")
    counted = some.groupBy("a", "h", "k", "salt").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_id", "_tx", "s", "n", "p")).alias("at"))
    groups = materialize(counted.groupBy("a", "h", "k").agg(F.sum("c").alias("c"), F.min("at").alias("at")))
    # A run over several places of its anchor may repeat a window by itself.
    kinds = materialize(groups.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.max("at.p").alias("p")).filter("d > 1 or p > 1").select("a", "d"))
    several = groups.join(_met(kinds), "a").select("a", "h", "k", F.col("d") > hot_runs, *(f"at.{c}" for c in ("_id", "_tx", "s", "n"))).toDF("a", "h", "k", "hot", "_id", "_tx", "s", "n")
    by_text = materialize(several.groupBy("_id", "_tx").agg(F.collect_list(F.struct("a", "h", "k", "hot", "s", "n")).alias("runs")))
    n_symbols = by_text.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: x + r["n"] + window - 1))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = symbols()
        for b in slices(batches, "_text", 1 << 18):
            values, starts = cut_up(b.column("_text"))
            values = first_lane(values) if width > 1 else values
            held = b.column("runs")
            text = np.repeat(np.arange(len(held)), np.diff(np.asarray(held.offsets)))
            r = held.flatten()
            s = np.asarray(r.field("s")).astype(np.int64) + starts[text]
            n = np.asarray(r.field("n")).astype(np.int64) + window - 1
            for i in range(0, len(s), 2048):
                part, at = _taken(values, s[i : i + 2048], n[i : i + 2048])
                content = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part))])
                yield pa.RecordBatch.from_arrays([*(r.field(k)[i : i + 2048] for k in ("a", "h", "k", "hot")), content], ["a", "h", "k", "hot", "content"])

    texts = mapped(rows.join(_met(by_text), ["_id", "_tx"]), cut, "a long, h long, k long, hot boolean, content binary")
    shards = max(spark.sparkContext.defaultParallelism, -(-(n_symbols or 0) // (4 * shard_symbols)))

    def flat(content: list) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(c) for c in content], np.int64) // width
        return np.frombuffer(b"".join(content), np.uint8 if width == 1 else np.uint64), np.append(0, np.cumsum(size))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            values, offs = flat([x[3] for x in held])
            n = np.diff(offs) - window + 1
            flags = kernel(values, offs, window)
            return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in held], pa.int64()) for k in range(3)), _ranges(flags, np.append(0, np.cumsum(n)))], ["a", "h", "k", "spans"])

        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in ("a", "h", "k", "content")), strict=True):
                if size >= shard_symbols and x[0] != held[-1][0]:
                    yield settle()
                    held, size = [], 0
                held.append(x)
                size += len(x[3]) // width
        if held:
            yield settle()

    parted = materialize(texts)
    settled = mapped(parted.filter("not hot").select("a", "h", "k", "content").repartition(shards, "a").sortWithinPartitions("a"), index, "a long, h long, k long, spans array<int>")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                values, offs = flat(part.column("content").to_pylist())
                n = np.diff(offs) - window + 1
                text = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                s = nth + offs[:-1][text]
                two = digests(values, s, s + window)
                t = pa.array(text)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(t) for c in ("a", "h", "k")), pa.array(nth, pa.int32()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["a", "h", "k", "nth", "w", "v"])

    hot = mapped(parted.filter("hot").select("a", "h", "k", "content"), spread, "a long, h long, k long, nth int, w long, v long")
    if kinds.filter(F.col("d") > hot_runs).limit(1).count():
        hot = materialize(hot)
        twice = materialize(hot.groupBy("w", "v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w", "v"))
        nths = hot.join(_met(twice), ["w", "v"], "left_semi").groupBy("a", "h", "k").agg(F.flatten(F.collect_list(F.array(F.col("nth"), F.col("nth") + 1))).alias("spans"))
        settled = settled.unionByName(nths)
    same = groups.filter("c > 1").select("a", "h", "k", F.array(F.lit(0), F.col("at.n")).alias("spans"))
    # A run that is repeated as a whole needs no more than that.
    partly = settled.filter(F.size("spans") > 0).join(same.select("a", "h", "k").hint("merge"), ["a", "h", "k"], "left_anti")
    spans = materialize(same.unionByName(partly))
    back = found.join(_met(spans), ["a", "h", "k"]).select("_id", "_tx", F.transform("spans", lambda x: x + F.col("s")).alias("spans"))
    return materialize(back.groupBy("_id", "_tx").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``columns`` of every row, as c0, c1, ..., with _text and the spans of its repeated windows (null if it has none)."""
    names = [f"c{i}" for i in range(len(columns))]  # the caller's names could clash with those used here
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), F.xxhash64(text_col).alias("_tx"), F.col(text_col).alias("_text"))
    return rows.join(_met(spans), ["_id", "_tx"], "left").select(*names, "_text", "spans")


def covered(spans: pa.Array, offs: np.ndarray, window: int) -> np.ndarray:
    """Which symbols a repeated window covers, of texts whose symbols start at ``offs``."""
    delta = np.zeros(offs[-1] + 1, np.int32)
    lists = spans.fill_null([]) if spans.null_count else spans
    text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)) // 2)
    pairs = np.asarray(lists.flatten()).reshape(-1, 2).astype(np.int64)
    np.add.at(delta, pairs[:, 0] + offs[text], 1)
    np.add.at(delta, pairs[:, 1] + window - 1 + offs[text], -1)
    return np.cumsum(delta)[:-1] > 0
