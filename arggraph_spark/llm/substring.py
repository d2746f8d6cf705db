"""Removal of long repeated substrings: of words by an FM-index, of bytes by a logarithmic family of suffix arrays."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import fmindex, suffixes
from .common import WordHashes, buffers, mapped, slices, words_of
from .windows import HOT_RUNS, SHARD_SYMBOLS, covered, octets, repeated_windows, with_spans, words


def _ranges(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def remove_repeated_words(docs: DataFrame, window: int = 35, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", gram: int = 6, hot_runs: int = HOT_RUNS, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """``columns`` of every row with n_words, n_removed, kept_text and the removed word ranges [s0, e0, ...].

    Words are ``[^\\x20\\x09-\\x0D]+``; a word goes if a window of ``window`` words that covers it occurs in another
    place too, in the same text or another; windows are those of the input. Null and empty texts have no words.
    Repeated rows are texts like any others. Kept words are joined by one space. An empty table gives an empty one.
    Names of ``columns`` may be any but those of the results; other columns aren't read. Long texts are taken in parts
    that overlap by a window; what takes memory is a list of their words, about 60 bytes each.
    """
    columns = columns or [id_col]
    spans = repeated_windows(docs, lambda: words(WordHashes()), fmindex.repeats, window, gram, 8, id_col, text_col, hot_runs, shard_symbols)

    def run(batches):
        for b in slices(batches, "_text", 1 << 19):
            texts = words_of(b.column("_text"))
            at = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
            gone = covered(b.column("spans"), at, window)
            out = {k: [] for k in ("n", "r", "text", "ranges")}
            for i, t in enumerate(texts):
                g = gone[at[i] : at[i + 1]]
                kept = list(compress(t, (~g).tolist())) if g.any() else t
                out["n"].append(len(t))
                out["r"].append(len(t) - len(kept))
                out["text"].append(b" ".join(kept).decode())
                out["ranges"].append(_ranges(g).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out["n"], pa.int64()), pa.array(out["r"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["ranges"], pa.list_(pa.int32()))], names)

    fields = [*(docs.schema[c] for c in columns), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.IntegerType()))]
    names = [f.name for f in fields]
    return mapped(with_spans(docs, spans, columns, id_col, text_col), run, T.StructType(fields))


def remove_repeated_bytes(docs: DataFrame, window: int = 200, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", gram: int = 24, hot_runs: int = HOT_RUNS, shard_symbols: int = SHARD_SYMBOLS, names: tuple[str, ...] = ("n_bytes", "n_removed", "kept_bytes", "removed"), as_text: bool = False) -> DataFrame:
    """``columns`` of every row with the byte count, the number removed, the remaining bytes and the removed ranges [s0, e0, ...].

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it starts in another place too, in the
    same text or another; strings are those of the input. Null counts as empty. Repeated rows are texts like any
    others. What remains may cut a character; ``as_text`` gives a string without such fragments instead of binary. An
    empty table gives an empty one. Names of ``columns`` may be any but ``names``; other columns aren't read. Long texts
    are taken in parts that overlap by a window, so a text takes few times its own size.
    """
    columns = columns or [id_col]
    spans = repeated_windows(docs, lambda: octets, suffixes.repeats, window, gram, 1, id_col, text_col, hot_runs, shard_symbols)

    def run(batches):
        for b in slices(batches, "_text", 1 << 19):
            data, offs = buffers(b.column("_text"))
            gone = covered(b.column("spans"), offs, window)
            out = {k: [] for k in ("n", "r", "bytes", "ranges")}
            for i in range(len(offs) - 1):
                g = gone[offs[i] : offs[i + 1]]
                kept = data[offs[i] : offs[i + 1]][~g]
                out["n"].append(len(g))
                out["r"].append(len(g) - len(kept))
                out["bytes"].append(kept.tobytes().decode("utf-8", "ignore") if as_text else kept.tobytes())
                out["ranges"].append(_ranges(g).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out["n"], pa.int64()), pa.array(out["r"], pa.int64()), pa.array(out["bytes"], pa.string() if as_text else pa.binary()), pa.array(out["ranges"], pa.list_(pa.int32()))], [*columns, *names])

    fields = [*(docs.schema[c] for c in columns), *(T.StructField(k, t) for k, t in zip(names, (T.LongType(), T.LongType(), T.StringType() if as_text else T.BinaryType(), T.ArrayType(T.IntegerType())), strict=True))]
    return mapped(with_spans(docs, spans, columns, id_col, text_col), run, T.StructType(fields))
