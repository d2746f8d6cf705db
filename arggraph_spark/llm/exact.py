"""Exact de-duplication against immutable snapshots screened by static binary-fuse filters.

A corpus arrives in batches. The digests of a batch are grouped among themselves; one row for each distinct digest is
then screened by the filter of every earlier snapshot, and only what passes is joined with that snapshot's exact
buckets. Texts move between machines only for digests that more than one row has, to be compared byte by byte.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import free_names, join_bounded, materialize

#: Distinct digests that a bucket, with its filter, is meant for.
BUCKET_KEYS = 1 << 19


def normal(text_col: str):
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(_key, digest[, norm]) where norm is the normal text and digest its SHA-256."""
    digest = F.unhex(F.sha2(normal(text_col), 256)).alias("digest")
    return docs.select(F.col(id_col).alias("_key"), digest, *([normal(text_col).alias("norm")] if with_text else []))


def _bucket(buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys(digest: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The second eight bytes of each digest; the bucket is taken from the first four."""
    return np.frombuffer(b"".join(d[8:16] for d in digest.to_pylist()), np.uint64)


class Snapshot:
    """One immutable set of digests: exact buckets (digest, bucket, n, keep) and a filter for each bucket."""

    def __init__(self, groups: DataFrame):
        n = groups.count()
        self.buckets = max(1, -(-n // BUCKET_KEYS))
        self.exact = groups.withColumn("bucket", _bucket(self.buckets))

        def build(t: pa.Table) -> pa.Table:
            return pa.table({"bucket": pa.array(t["bucket"].to_pylist()[:1], pa.int32()), "filter": pa.array([fuse.build(_keys(t["digest"]))], pa.binary())})

        self.filters = materialize(self.exact.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary"))

    def screen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one for each digest) that the filters let pass; a bucket's filter meets the bucket's digests only."""

        def test(mine: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not mine.num_rows:
                return mine.slice(0, 0)
            return mine.filter(pa.array(fuse.probe(filters["filter"][0].as_py(), _keys(mine["digest"]))))

        mine = groups.select("digest").withColumn("bucket", _bucket(self.buckets))
        return mine.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInArrow(test, mine.schema)

    def matches(self, groups: DataFrame) -> DataFrame:
        """Digests of ``groups`` that this snapshot holds: screened, then joined with the exact buckets."""
        return self.screen(groups).join(self.exact.select("bucket", "digest"), ["bucket", "digest"]).select("digest")


def _grouped(rows: DataFrame, *more) -> DataFrame:
    return rows.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"), *more)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row of the largest
    id stays (null ids are smallest; of rows equal in id too, exactly one). ``batches``: as how many arrivals, dealt by
    a hash of the id, the table is taken in; the result doesn't depend on it. Groups of copies are counted where they
    are read before they are shuffled, so one group may hold any share of the rows. An empty table gives an empty one.
    Other columns aren't read, so their names can't clash. A text is whole in one row, however long.
    """
    arrival = F.pmod(F.xxhash64("_key"), F.lit(batches)).cast("int")
    rows = materialize(digest_rows(docs, id_col, text_col).withColumn("_batch", arrival).withColumn("_uid", F.monotonically_increasing_id()))
    single = rows.select("digest", "_batch", F.lit(1).cast("long").alias("n"), F.struct(F.col("_key").alias("id"), F.col("_uid").alias("uid")).alias("keep"))
    snapshots: list[Snapshot] = []
    matched: list[DataFrame] = []
    parts: list[DataFrame] = []
    for i in range(batches):
        groups = materialize(_grouped(single.filter(F.col("_batch") == i)))
        matched += [s.matches(groups) for s in snapshots]
        parts.append(groups)
        if i + 1 < batches:
            snapshots.append(Snapshot(groups))
    met = reduce(DataFrame.unionByName, [*matched, *(g.filter("n > 1").select("digest") for g in parts)])
    met = materialize(met.distinct())
    every = reduce(DataFrame.unionByName, parts)
    classes = materialize(_grouped(join_bounded(every, met, ["digest"], "left_semi", 64)))
    # Byte checks: the texts of digests met more than once, one of each kept where they are read.
    texts = join_bounded(digest_rows(docs, id_col, text_col, True).select("digest", "norm"), met, ["digest"], "left_semi", 64)
    differ = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if differ.limit(1).count():
        raise RuntimeError("different texts have one SHA-256")
    out = join_bounded(rows, classes, ["digest"], "left", 96)
    keep = F.coalesce(F.col("keep"), F.struct(F.col("_key").alias("id"), F.col("_uid").alias("uid")))
    return out.select(
        F.col("_key").alias(id_col),
        keep["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keep["uid"] == F.col("_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of rows equal in id and text, one.

    Null and empty texts are equal; an empty table stays empty; no name of a column can clash; texts may be of any length.
    """
    id_, sha, keep, n = free_names(docs.columns, "_id", "_sha", "_kept", "_n")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    found = exact_dedup(docs, id_col, text_col).select(key.alias(id_), F.col("text_sha256").alias(sha), "kept")
    odd = materialize(found.groupBy(id_, sha).agg(F.max("kept").alias(keep), F.count(F.lit(1)).alias(n)).filter(f"not {keep} or {n} > 1"))
    marked = join_bounded(docs.withColumns({id_: key, sha: F.sha2(normal(text_col), 256)}), odd, [id_, sha], "left", 128)
    kept = marked.filter(F.col(keep).isNull())
    if odd.filter(keep).limit(1).count():
        kept = kept.unionByName(marked.filter(keep).dropDuplicates([id_, sha]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
