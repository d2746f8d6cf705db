"""Long sequences of one document without a row that holds it: running aggregates, packing by doubling, free names.

Rows are keyed by (doc_id, order), the order dense from 0. Nothing here gathers a document in one row; windows run over
blocks of ``BLOCK`` rows, over spans of one budget, or over one row a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut, some

#: Rows of a document whose running aggregate is made by one window.
BLOCK = 4096
#: Jumps of a document that one task follows.
LOCAL = 200_000


def running(rows: DataFrame, order: str, value: str, name: str, most: bool = False) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in ``order``, itself included; with ``most`` the largest."""
    how = F.max if most else F.sum
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = rows.groupBy("doc_id", "_block").agg(how(value).alias("_of"))
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("doc_id", "_block", how("_of").over(earlier).alias("_before"))
    inside = how(value).over(Window.partitionBy("doc_id", "_block").orderBy(order))
    both = rows.withColumn("_inside", inside).join(blocks, ["doc_id", "_block"])
    whole = F.greatest("_before", "_inside") if most else F.coalesce("_before", F.lit(0)) + F.col("_inside")
    return both.withColumn(name, whole).drop("_block", "_inside", "_before")


def _met(points: DataFrame, asked: DataFrame, last: bool) -> DataFrame:
    """(doc_id, i, bucket, at, found): for each (doc_id, bucket, at, i) of ``asked`` the point (bucket, at, found) of its bucket
    that is the last at most ``at``, or else the first at least ``at``; null without one."""
    kinds = points.select("doc_id", "bucket", "at", F.lit(None).cast("long").alias("i"), "found").unionByName(asked.withColumn("found", F.lit(None).cast(points.schema["found"].dataType)))
    rank = F.col("i").isNotNull()  # a point comes before a question of the same place, seen from either side
    order = [F.col("at") if last else F.col("at").desc(), rank]
    near = F.last("found", True).over(Window.partitionBy("doc_id", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kinds.withColumn("found", near).filter(rank)


def next_starts(rows: DataFrame, budget: int) -> DataFrame:
    """(doc_id, i, next): where the following chunk starts if one starts at ``i``, for all i; rows (doc_id, i, t, turn), t at least 1.

    Places on the running sums are looked up in spans of one budget, which hold at most a budget's number of rows.
    """
    rows = cut(running(rows, "i", "t", "upto").withColumn("start", F.col("upto") - F.col("t")))
    span = lambda c: F.floor(c / budget)
    covered = F.sequence(span(F.col("start")), span(F.col("upto") - 1))
    points = rows.select("doc_id", F.explode(covered).alias("bucket"), F.col("start").alias("at"), F.struct("i", "upto").alias("found"))
    ask = lambda at: rows.select("doc_id", span(at).alias("bucket"), at.alias("at"), "i")
    full = _met(points, ask(F.col("start") + budget), last=True).filter(F.col("found.upto") > F.col("at"))
    full = full.select("doc_id", "i", F.greatest(F.col("i") + 1, F.col("found.i")).alias("full"))
    # A chunk that is half full ends at a change of heading: of this span, or the first of the next one; beyond it is full.
    turns = rows.filter("turn").select("doc_id", span(F.col("start")).alias("bucket"), F.col("start").alias("at"), F.col("i").alias("found"))
    half = _met(turns, ask(F.col("start") + (budget + 1) // 2), last=False)
    later = turns.groupBy("doc_id", (F.col("bucket") - 1).alias("bucket")).agg(F.min("found").alias("later"))
    half = half.join(later, ["doc_id", "bucket"], "left").select("doc_id", "i", F.coalesce("found", "later").alias("half"))
    out = rows.select("doc_id", "i").join(full, ["doc_id", "i"], "left").join(half, ["doc_id", "i"], "left")
    last = rows.groupBy("doc_id").agg(F.max("i").alias("last"))
    return out.join(last, "doc_id").withColumn("next", F.least("full", "half")).filter(F.col("next") <= F.col("last")).select("doc_id", "i", "next")


def _followed(jumps: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, i, chunk) of the starts after 0 of one document, by its jumps."""
    to = dict(zip(jumps["i"], jumps["next"], strict=True))
    met, at = [], 0
    while (at := to.get(at)) is not None:
        met.append(at)
    return pd.DataFrame({"doc_id": jumps["doc_id"].iloc[[0] * len(met)].to_numpy(), "i": met, "chunk": range(1, len(met) + 1)})


def _doubled(jump: DataFrame) -> DataFrame:
    """The same by doubling, in rounds as the logarithm of the number of chunks."""
    starts = jump.filter("i = 0").select("doc_id", "i", F.lit(0).cast("long").alias("chunk"))
    step = 1
    while True:
        more = cut(starts.join(jump, ["doc_id", "i"]).select("doc_id", F.col("next").alias("i"), (F.col("chunk") + step).alias("chunk")))
        if not some(more):
            return starts.filter("i > 0")
        starts = cut(starts.unionByName(more))
        onward = jump.select("doc_id", F.col("i").alias("next"), F.col("next").alias("after"))
        jump = cut(jump.join(onward, ["doc_id", "next"]).select("doc_id", "i", F.col("after").alias("next")))
        step *= 2


def chunk_numbers(rows: DataFrame, budget: int) -> DataFrame:
    """(doc_id, i, chunk) of rows (doc_id, i, t, turn) packed in order: the chain of starts from 0, by doubling or, where no
    more than ``LOCAL`` jumps of a document are left, in one task."""
    rows = cut(rows)
    jump = cut(next_starts(rows, budget))
    # Of the jumps only those matter that start at 0 or where another one ends.
    ends = jump.select("doc_id", F.col("next").alias("i")).distinct()
    jump = cut(jump.join(ends, ["doc_id", "i"], "left_semi").unionByName(jump.filter("i = 0")))
    many = cut(jump.groupBy("doc_id").count().filter(F.col("count") > LOCAL).select("doc_id"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, i long, chunk long"
    starts = rows.filter("i = 0").select("doc_id", "i", F.lit(0).cast("long").alias("chunk"))
    starts = starts.unionByName(jump.join(many, "doc_id", "left_anti").groupBy("doc_id").applyInPandas(_followed, schema))
    if some(many):
        starts = starts.unionByName(_doubled(cut(jump.join(many, "doc_id", "left_semi"))))
    marked = cut(rows.select("doc_id", "i").join(starts, ["doc_id", "i"], "left"))
    return running(marked, "i", "chunk", "number", most=True).select("doc_id", "i", F.col("number").alias("chunk"))


# Free names.


def free_names(bases: Iterable[str], joint: str) -> Iterator[str]:
    """Each base, or the first of base-2, base-3, ... that no earlier one has."""
    taken: set[str] = set()
    tried: dict[str, int] = {}  # numbers below are taken, as names are never given back
    for base in bases:
        n = tried.get(base, 1)
        while (name := base if n == 1 else f"{base}{joint}{n}") in taken:
            n += 1
        tried[base] = n
        taken.add(name)
        yield name


def stem(name: Column, joint: str) -> Column:
    """What is left without numbers at the end: names of different stems never come into each other's way."""
    return F.regexp_replace(name, f"(?:{re.escape(joint)}(?:[2-9]|[1-9][0-9]+))+\\z", "")
