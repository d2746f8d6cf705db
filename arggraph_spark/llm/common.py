"""Shared parts of the training-data operators: scratch tables, byte-balanced Arrow slices, size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this size; beyond it the same join shuffles.
BROADCAST_BYTES = 24 << 20

#: (path, weak reference to the file index of the frame that reads it)
_SCRATCH: list[tuple] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if not got.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arggraph-"))
        got = sc._jsc.sc().getCheckpointDir()
    return got.get()


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores put before each until it clashes with no column (names are compared without case)."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession, everything: bool = False) -> None:
    """Deletes scratch tables that no JVM plan refers to any more."""
    if spark.sparkContext._jsc is None:
        _SCRATCH.clear()
        return
    for entry in list(_SCRATCH):
        path, ref = entry
        if everything or ref.get() is None:
            _SCRATCH.remove(entry)
            _delete(spark, path)


@atexit.register
def _sweep_all() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _SCRATCH:
            sweep(spark, everything=True)
    except Exception:  # the JVM may be gone at exit
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared scratch folder and reads it again.

    This cuts lineage and survives lost executors. The files live for as long as any plan on the JVM side
    refers to them and are removed by a later call, or at exit.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _SCRATCH.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


def scratch_folder(df: DataFrame) -> str | None:
    """The folder of a frame that ``materialize`` gave; None of any other."""
    plan = df._jdf.queryExecution().analyzed()
    for path, ref in _SCRATCH:
        if plan.getClass().getSimpleName() == "LogicalRelation" and ref.get() is not None and ref.get().equals(plan.relation().location()):
            return path
    return None


def discard(df: DataFrame) -> None:
    """Deletes at once the files of a materialized frame that nothing will read again; other frames are left alone."""
    path = scratch_folder(df)
    if path is not None:
        _SCRATCH[:] = [e for e in _SCRATCH if e[0] != path]
        _delete(df.sparkSession, path)


def keep_with(df: DataFrame, folder: str) -> None:
    """From now on ``folder`` is deleted when the materialized ``df`` is."""
    path = scratch_folder(df)
    _SCRATCH.append((folder, next(ref for p, ref in _SCRATCH if p == path)))


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Joins with a materialized ``right``: broadcast where its counted rows stay under BROADCAST_BYTES, else shuffled."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    else:
        right = right.hint("merge")
    return left.join(right, on, how)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into row slices of at most ``limit`` text bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


# Hashes. Those that decide a result are 128 bits of BLAKE2; 64-bit mixes only route, band and sort.


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hash(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``length`` neighbouring values: halves are mixed like a tree, so no sum over places can cancel out."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    left, right = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    part, span, out, done = mix(values ^ mix(np.array([seed], np.uint64) + left)), 1, None, 0
    while True:
        if length & span:
            here = part[done : done + n]
            out = here if out is None else mix(out * left + here)
            done += span
        if span * 2 > length:
            return out
        part = mix(part[:-span] * right + part[span:])
        span *= 2


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests (n x 2, int64) of the rows [start, end) of ``data``."""
    view = memoryview(np.ascontiguousarray(data)).cast("B") if data.size else memoryview(b"")
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    hashed = [blake2b(view[s:e], digest_size=16).digest() for s, e in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)]
    return np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)


class WordHashes(dict):
    """Words by number, each with 128 bits of BLAKE2; emptied by ``rows`` when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most, self.held, self.table = most, [], np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.held.append(blake2b(word, digest_size=16).digest())
        n = self[word] = len(self)
        return n

    def rows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes (words x 2) of texts given as words, and the number of words before each text."""
        if len(self) > self.most:
            self.clear()
            self.held, self.table = [], np.zeros((0, 2), np.uint64)
        at = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(at[-1]))
        if self.held:
            self.table = np.concatenate([self.table, np.frombuffer(b"".join(self.held), np.uint64).reshape(-1, 2)])
            self.held = []
        return self.table[codes], at


def words_of(col: pa.Array, lower: bool = False) -> list[list[bytes]]:
    """Each text's words ``[^\\x20\\x09-\\x0D]+`` (bytes.split cuts at just these), A-Z lower-cased on demand; null has none."""
    return [(t.lower() if lower else t).split() if t else [] for t in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def frugal(run):
    """Wraps a function of record batches: what a task of it held goes back to the system when it ends."""

    @wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


#: Rows of an Arrow batch. Rows hold whole texts here, so Spark's default of 10,000 would make batches of 30 MB and more.
BATCH_ROWS, _BATCH_ROWS_KEY = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` of a ``frugal`` function; the session's batches are made smaller if their size is Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS_KEY) == "10000":
        conf.set(_BATCH_ROWS_KEY, str(BATCH_ROWS))
    return df.mapInArrow(frugal(run), schema)


def release() -> None:
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
