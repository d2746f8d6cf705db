"""Groups of spelling variants: words one replaced, inserted or deleted code point apart, without pairs of them."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, slices

#: Different words a task counts before it hands their counts on.
COUNTED = 200_000
#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def planted(word: str, h: int, every: int) -> str:
    """The word without its code point ``h`` % length if ``every`` divides ``h``."""
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased; words of ``least_length`` code points and ``least`` occurrences.

    Where ``every`` divides the unsigned crc32 of UTF-8 ``<doc_id>:<run>`` (a null id counts as "null") the run loses its
    code point crc32 % length. Null and empty texts have no words. Counts are summed where they are read, so what is
    shuffled is a row a word and task, however often a word occurs; a task holds at most ``COUNTED`` words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in slices(batches, "_text", 1 << 20):
            texts = b.column("_text").cast(pa.large_binary() if pa.types.is_large_string(b.column("_text").type) else pa.binary()).to_pylist()
            for doc, text in zip(b.column("_id").to_pylist(), texts, strict=True):
                if not text:
                    continue
                mine: dict[bytes, int] = {}
                for w in RUN.findall(text.lower()):  # bytes.lower changes A-Z only
                    mine[w] = mine.get(w, 0) + 1
                before = zlib.crc32(f"{doc}:".encode())
                for w, n in mine.items():
                    if len(w) < least_length:
                        continue
                    h = zlib.crc32(w, before)
                    if not h % every:
                        w = planted(w.decode(), h, every).encode()
                    held[w] = held.get(w, 0) + n
                if len(held) >= COUNTED:
                    yield out()
                    held = {}
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), F.col(text_col).alias("_text"))
    counts = mapped(rows, count, "word string, n long").filter(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def ranked(words: DataFrame) -> DataFrame:
    """(r, word, n) of words (word, n): of two words that with more occurrences, or the smaller by code points, has the lesser r."""
    # Numbers grow with the partition first, and a sort's partitions are in order.
    return materialize(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n"))


def _prefix_digests(points: list[bytes]) -> list[bytes]:
    """128-bit digests of the first 0, 1, ... code points; each goes on from the last, so long words take linear time."""
    h = blake2b(digest_size=16)
    out = [h.digest()]
    for p in points:
        h.update(p)
        out.append(h.copy().digest())
    return out


def places(word: str) -> Iterator[tuple[bytes, bool, bool]]:
    """(group, whether the word has a code point at the place, whether deleting there is the first way to that result)."""
    points = [c.encode() for c in word]
    before, after, n = _prefix_digests(points), _prefix_digests(points[::-1]), len(points)
    for i in range(n):
        yield before[i] + after[n - i - 1], True, not i or points[i] != points[i - 1]
    for i in range(n + 1):
        yield before[i] + after[n - i], False, False


def neighbours(words: DataFrame) -> DataFrame:
    """(r, n_near, best): of ``ranked`` words, how many others are one code point away, and the least r of them.

    A group is a place in a word: its position, what stands before and what stands after (as 128-bit digests). Words
    with a code point there differ by a replacement, and two words that differ so share that group and no other: its
    size and its first two words say how many neighbours each has there and which is the best. A word that has nothing
    there is what the others become by deletion: it sees their number and best, and they see it, each by the first of
    the places where deletion gives the same. So no pair is made. A group has as many words as there are different code
    points, which bounds it; rows are twice the words' lengths, with numbers for words, so that long words stay linear.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(blake2b(h[1], digest_size=16).digest() for h in held), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[2] for h in held]), pa.array([h[3] for h in held])], ["a", "b", "r", "letter", "lead"])

        held: list[tuple] = []
        for batch in batches:
            for r, word in zip(batch.column("r").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for place in places(word):
                    held.append((r, *place))
                    if len(held) == 50_000:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    rows = mapped(words.select("r", "word"), cut, "a long, b long, r long, letter boolean, lead boolean")
    group = Window.partitionBy("a", "b").orderBy(F.desc("letter"), "r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c: c.over(group)
    lead = F.when(F.col("lead"), F.col("r"))
    met = rows.select("r", "letter", "lead", over(F.count_if("letter")).alias("size"), over(F.first("r")).alias("first"), over(F.nth_value("r", 2)).alias("second"), over(F.min(F.when(~F.col("letter"), F.col("r")))).alias("without"), over(F.count(lead)).alias("n_lead"), over(F.min(lead)).alias("best_lead"), over(F.count(F.lit(1))).alias("all"))
    met = met.filter(F.col("all") > 1)
    other = F.when(F.col("size") > 1, F.when(F.col("first") == F.col("r"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(F.col("lead"), F.col("without"))
    c = F.when(F.col("letter"), F.col("size") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("n_lead"))
    best = F.when(F.col("letter"), F.least(other, shorter)).otherwise(F.col("best_lead"))
    return met.select("r", c.alias("c"), best.alias("best")).filter("c > 0").groupBy("r").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``word_counts``.

    Two words are near if they differ by one inserted, deleted or replaced code point. ``form`` is the near word of most
    occurrences (ties: the smallest by code points) if it has ``times`` times as many, else null; ``root`` is the last
    word on the way from form to form, the word itself if it has none. Occurrences grow by ``times`` a step, so ways are
    short, and they are followed by doubling. Repeated rows of ``docs`` count each. An empty table gives an empty one.
    Only the id and the text are read, so other columns can't clash; long texts are read once, in one piece.
    """
    words = ranked(word_counts(docs, least_length, least, every, id_col, text_col))
    near = neighbours(words)
    named = words.select(F.col("r").alias("best"), F.col("word").alias("w"), F.col("n").alias("m"))
    formed = words.join(near.hint("merge"), "r", "left").join(named.hint("merge"), "best", "left").withColumn("ok", F.coalesce(F.col("m") >= times * F.col("n"), F.lit(False)))
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("w")).alias("form"), F.when(F.col("ok"), F.col("m")).alias("form_n")))
    discard(words)
    most = formed.agg(F.max("n")).first()[0] or 0
    longest = int(math.log(max(most / least, 1), times)) + 1 if times > 1 else most  # steps of a way
    ways = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(longest - 1, 0).bit_length()):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = materialize(ways.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = formed.join(ways.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
