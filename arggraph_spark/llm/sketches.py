"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

The k least distinct hashes of a text's shingles. Sketches of parts merge into that of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_bounded, materialize

K, SIZE = 128, 5
_BLANK = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, out: str, size: int = SIZE, k: int = K) -> DataFrame:
    """``df`` with the sketch (array<long>, ascending) of a text column.

    A text of fewer than ``size`` words has one shingle, all its words; null and blank texts have none. The hashes of
    words and then of shingles are columns of their own, so that each is computed once.
    """
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANK))
    df = df.withColumn("_w", F.transform(F.split(bare, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))).withColumn("_blank", bare == "")
    shingle = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - size + 1, F.lit(1))),
        lambda w, i: F.xxhash64(w, *(F.get("_w", i + j) for j in range(1, size))),
    )
    df = df.withColumn("_s", F.array_distinct(shingle))
    least = F.slice(F.sort_array("_s"), 1, k)
    return df.withColumn(out, F.when(F.col("_blank"), F.array().cast("array<long>")).otherwise(least)).drop("_w", "_blank", "_s")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes; else from the k-th least hash's place in the range of 64-bit numbers."""
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's sketch that both have; 1 for two empty sketches."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too (0 to 1); 1 if a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def merge_parts(parts: DataFrame, group: list[str], sketch: str = "sketch", k: int = K, salts: int = 16) -> DataFrame:
    """(group, sketch): the sketches of each group's parts merged. A large group is cut to k hashes by salt before they meet."""
    rows = parts.select(*group, F.explode(sketch).alias("_h")).dropDuplicates([*group, "_h"]).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    for by in ([*group, "_salt"], group):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).filter(F.col("_n") <= k)
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def text_of(sketch: str) -> Column:
    """A sketch as base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(F.col(sketch), lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def ordered_next(docs: DataFrame, id_col: str, text_col: str, block: int = 1024) -> DataFrame:
    """(_id, _tx, _rank, _last): a dense rank of the distinct (id, text) by id, then text hash; null ids first.

    Ids are dealt by range; only their counts by part, and no ids, meet in one place.
    """
    ids = docs.select(F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_tx")).distinct()
    parts = materialize(ids.repartitionByRange(F.col("_key").asc_nulls_first(), F.col("_tx")).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "_tx")) - 1
    ranked = parts.withColumn("_nth", nth).join(F.broadcast(sizes), "_part")  # a row for each part
    key = F.coalesce(F.col("_key").cast("string"), F.lit("null")).alias("_id")
    return materialize(ranked.select(key, "_tx", (F.col("_nth") + F.col("_before")).alias("_rank"), F.col("_total").alias("_total")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K, block: int = 1024) -> DataFrame:
    """Each text's sketch, and that of its text edited with the next document's.

    Columns: id, n_chars, edited_text, sketch, edited_sketch, next_sketch. The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, by ascending id;
    after the last comes the first. Null counts as empty; null ids come first; rows equal in id are in the order of
    their text's hash, and rows equal in both count as one document in that order. An empty table gives an empty one.
    """
    ranks = ordered_next(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_tx"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_id", F.coalesce(F.col("_key").cast("string"), F.lit("null")))
    rows = with_sketch(join_bounded(rows, ranks, ["_id", "_tx"], "inner", 64), "_text", "_sketch", size, k).drop("_id", "_tx")
    # Blocks of ranks; a block's first document also stands at the end of the block before it, and the first of all after the last.
    own = F.struct(F.floor(F.col("_rank") / block).alias("block"), F.col("_rank").alias("rank"), F.lit(True).alias("own"))
    before = F.struct(F.floor((F.col("_rank") - 1) / block).alias("block"), F.col("_rank").alias("rank"), F.lit(False).alias("own"))
    after = F.struct(F.floor((F.col("_total") - 1) / block).alias("block"), F.col("_total").alias("rank"), F.lit(False).alias("own"))
    places = F.filter(F.array(own, F.when((F.col("_rank") > 0) & (F.col("_rank") % block == 0), before), F.when(F.col("_rank") == 0, after)), lambda p: p.isNotNull())
    rows = rows.withColumn("_at", F.explode(places)).select("_key", "_text", "_sketch", "_at.*")
    following = Window.partitionBy("block").orderBy("rank").rangeBetween(1, 1)
    rows = rows.withColumn("_next", F.first(F.struct("_text", "_sketch")).over(following)).filter("own")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half)))
    rows = rows.select(F.col("_key").alias(id_col), n.cast("long").alias("n_chars"), F.col("_edited").alias("edited_text"), F.col("_sketch").alias("sketch"), F.col("_next._sketch").alias("next_sketch"))
    return with_sketch(rows, "edited_text", "edited_sketch", size, k)
