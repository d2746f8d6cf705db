"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

Texts with equal sets of shingles form one class. A class is hashed once, each hash falling into one bin; empty bins
borrow from bins picked by a universal hash. Runs of bins are bands, and classes with an equal band share a bucket. A
bucket gives a star: its members are compared with one hub, not with each other, so pairs are as many as members. The
hub is the member that shares most buckets with others: the text that copies were made from comes before its copies.

Members of a bucket that still lie in different components are bucketed again, under longer bands of an independent
permutation, in which only texts that are much alike meet; there the hub is of the smallest component. This is repeated
under new permutations until it joins no components any more. Links are confirmed on the words of both texts.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, free_names, join_bounded, mapped, materialize, mix, slices, window_hash, words_of

#: Bands and bins of each: a pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8**5)**36, under one in a million.
BANDS, ROWS = 36, 5
#: Those under which what stars left apart is bucketed again: a pair at 0.8 shares none with a chance of 0.03, one at 0.65 with 0.88.
LONG_BANDS, LONG_ROWS = 128, 16
#: Shingles of confirmed texts that a task keeps.
KEPT_SHINGLES = 1 << 18


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, size: int, texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text the distinct shingles' 128-bit hashes (n x 2), ascending; a text of fewer than ``size`` words is one shingle."""
    pairs = np.stack([window_hash(hashes[:, k].copy(), size, k + 1) for k in (0, 1)], axis=1) if len(hashes) >= size else np.zeros((0, 2), np.uint64)
    out = []
    for i, w in enumerate(texts):
        if len(w) >= size:
            own = pairs[at[i] : at[i + 1] - size + 1]
            out.append(own[np.unique(own[:, 0], return_index=True)[1]])
        else:
            out.append(np.frombuffer(blake2b(b" ".join(w), digest_size=16, key=b"short").digest(), np.uint64).reshape(1, 2) if w else np.zeros((0, 2), np.uint64))
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins' lower edges, and for each bin the bins it borrows from, in order of attempts."""
    if bins not in _TABLES:
        edges = np.array([-(-(b << 64) // bins) for b in range(bins)], np.uint64)
        donors = mix(np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix(np.arange(1, 513, dtype=np.uint64))[None, :])
        _TABLES[bins] = edges, (donors % np.uint64(bins)).astype(np.int32)
    return _TABLES[bins]


def bands(sets: list[np.ndarray], count: int = BANDS, rows: int = ROWS, seed: int = 0) -> np.ndarray:
    """Band hashes (sets x count) of non-empty sets of 64-bit hashes, under the permutation that ``seed`` names."""
    bins = count * rows
    edges, donors = _tables(bins)
    values = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for i, u in enumerate(sets):
        u = np.sort(mix(u ^ mix(np.array([seed], np.uint64)))) if seed else u
        at = np.searchsorted(u, edges)
        # The least hash of a bin is the first from its edge on, unless that lies beyond the bin.
        filled[i] = np.append(at[1:], len(u)) > at
        values[i] = u[np.minimum(at, len(u) - 1)]
    row, col = np.nonzero(~filled)
    for attempt in range(donors.shape[1]):
        if not len(row):
            break
        donor = donors[col, attempt]
        ok = filled[row, donor]
        values[row[ok], col[ok]] = values[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    values[row, col] = values[row, filled[row].argmax(axis=1)]  # no donor met within the table
    h = np.arange(1, count + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        h = mix(h ^ values[:, k::rows])
    return h


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(_key, _tx, n_shingles, f, g, bands) of every row; f and g name its set by 128 bits, bands is null if that is empty."""

    def run(batches):
        known = WordHashes()
        for b in slices(batches, "_text", 1 << 19):
            texts = words_of(b.column("_text"), lower=True)
            sets = shingle_hashes(*known.rows(texts), size, texts)
            some = [i for i, u in enumerate(sets) if len(u)]
            hashes = bands([sets[i][:, 0] for i in some]) if some else np.zeros((0, BANDS), np.uint64)
            at = dict(zip(some, range(len(some)), strict=True))
            names_of = np.frombuffer(b"".join(blake2b(u.tobytes(), digest_size=16).digest() for u in sets), np.int64).reshape(-1, 2)
            listed = [hashes[at[i]].view(np.int64) if i in at else None for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_tx"), pa.array([len(u) for u in sets], pa.int64()), *(pa.array(names_of[:, k].copy()) for k in (0, 1)), pa.array(listed, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_tx"), F.col(text_col).alias("_text"))
    fields = [T.StructField("_key", docs.schema[id_col].dataType), *(T.StructField(k, T.LongType()) for k in ("_tx", "n_shingles", "f", "g")), T.StructField("bands", T.ArrayType(T.LongType()))]
    names = [f.name for f in fields]
    return mapped(rows, run, T.StructType(fields))


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b): the least node of each component; labels spread and are followed until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("comp").alias("heard")).withColumnRenamed("b", "node")
        near = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        # Following: the label of the label.
        next_ = near.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp").select("node", "old", F.least("comp", "further").alias("comp"))
        next_ = materialize(next_)
        if not next_.filter("comp <> old").limit(1).count():
            return next_.select("node", "comp")
        labels = next_.select("node", "comp")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after new ``links`` (a, b): only the components that these join are labelled anew."""
    if labels is None:
        return connected(links)
    ends = [F.coalesce(F.col(f"l{e}.comp"), F.col(e)).alias(e) for e in ("a", "b")]
    between = links.join(labels.alias("la"), F.col("a") == F.col("la.node"), "left").join(labels.alias("lb"), F.col("b") == F.col("lb.node"), "left").select(*ends)
    joined = connected(between.filter("a <> b")).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    old = labels.join(joined, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    # A component that had no label was a single node.
    new = joined.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("into").alias("comp"))
    return materialize(old.unionByName(new))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose texts (node, text) are linked, compared word for word."""

    def run(batches):
        held: dict[int, set] = {}
        total = 0
        for b in slices(batches, "y", 1 << 20):
            ok = []
            for nodes in zip(*(b.column(k).to_pylist() for k in ("a", "b", "x", "y")), strict=True):
                if total > KEPT_SHINGLES:
                    held.clear()
                    total = 0
                for node, text in zip(nodes[:2], nodes[2:], strict=True):
                    if node not in held:
                        w = text.encode().lower().split()
                        held[node] = set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}  # noqa: B905
                        total += len(held[node])
                x, y = held[nodes[0]], held[nodes[1]]
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    return materialize(mapped(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y"), run, "a long, b long"))


def stars(members: DataFrame, hub, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's hub, the greatest by ``hub``, with its members (band, node, n, comp) of other components."""
    hubs = members.groupBy("band").agg(F.max(F.struct(hub.alias("by"), F.negative("node").alias("last"), "n", "comp")).alias("hub"))
    pairs = members.join(hubs, "band").withColumn("other", F.negative("hub.last"))
    pairs = pairs.filter("node <> other and comp <> hub.comp and 100 * least(n, hub.n) >= %d * greatest(n, hub.n)" % percent)
    return materialize(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


def shared_buckets(members: DataFrame) -> DataFrame:
    """``members`` of buckets that hold more than one, with their number as c; materialized."""
    counts = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    return materialize(join_bounded(members, counts, ["band"], "inner", 40))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, first, text_hash) for every row.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles, A-Z
    lower-cased. component_id is the least id that links reach, the row's own included; kept says whether it is the
    row's own; first whether the row is the one of least id and text of its component. Null and empty texts and those
    without words have an empty set and are linked with nothing. Repeated rows are linked with each other. Null ids
    are never a component_id unless the component has no other. An empty table gives an empty one; other columns
    aren't read, so their names can't clash. A text of any length is one row of a batch, and takes about 100 bytes a
    word. ``percent`` must be 80 to 100, as the bands miss pairs of less similarity.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    rows = materialize(signatures(docs, size, id_col, text_col))
    sets = rows.filter("n_shingles > 0").groupBy("f", "g").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_tx").alias("tx"))).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))
    members = shared_buckets(classes.select("node", "n", F.explode("bands").alias("band")))
    wanted = materialize(members.select("node").distinct().join(classes.select("node", "rep"), "node").select(F.coalesce(F.col("rep.key").cast("string"), F.lit("null")).alias("_id"), F.col("rep.tx").alias("_tx"), "node"))
    rows_of = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), F.xxhash64(text_col).alias("_tx"), F.col(text_col).alias("_text"))
    texts = materialize(join_bounded(rows_of, wanted, ["_id", "_tx"], "inner", 48).select("node", "_text").dropDuplicates(["node"]))

    popular = members.groupBy("node").agg(F.sum("c").alias("met"))
    pairs = stars(members.join(popular, "node").withColumn("comp", F.col("node")), F.col("met"), percent)
    links = confirmed(pairs, texts, size, percent)
    labels = connected(links) if links.limit(1).count() else None
    seed = 0
    while True:
        seed += 1
        apart = members.select("band", "node", "n")
        apart = materialize(apart.withColumn("comp", F.col("node")) if labels is None else apart.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        open_ = materialize(apart.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band"))
        left = materialize(join_bounded(apart, open_, ["band"], "left_semi", 24).select("node", "n", "comp").distinct())
        if not left.limit(1).count():
            break

        def again(batches, seed=seed):
            known = WordHashes()
            for b in slices(batches, "_text", 1 << 19):
                words = words_of(b.column("_text"), lower=True)
                got = bands([u[:, 0] for u in shingle_hashes(*known.rows(words), size, words)], LONG_BANDS, LONG_ROWS, seed)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(list(got.view(np.int64)), pa.list_(pa.int64()))], ["node", "bands"])

        # Written, as buckets are read for their numbers and for their members: texts are hashed once a round.
        longer = materialize(mapped(texts.join(left.select("node"), "node", "left_semi").select("node", "_text"), again, "node long, bands array<long>"))
        meeting = shared_buckets(longer.select("node", F.explode("bands").alias("band")))
        sizes = left.groupBy("comp").agg(F.count(F.lit(1)).alias("of"))
        meeting = meeting.join(left.join(sizes, "comp"), "node")
        links = confirmed(stars(meeting, F.negative("of"), percent), texts, size, percent)
        if not links.limit(1).count():
            break
        labels = merged(labels, links)
    comps = classes.select("f", "g", "node", "copies", "rep")
    comps = comps.withColumn("comp", F.col("node")) if labels is None else comps.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = comps.groupBy("comp").agg(F.min("rep").alias("least"), F.sum("copies").alias("size")).filter("size > 1")
    named = materialize(comps.join(least, "comp").select("f", "g", "least"))
    out = join_bounded(rows.drop("bands"), named, ["f", "g"], "left", 80)
    own = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_tx").alias("tx"))
    least_id = F.when(F.col("least").isNull(), F.col("_key")).otherwise(F.col("least.key"))
    return out.select(
        F.col("_key").alias(id_col),
        "n_shingles",
        least_id.alias("component_id"),
        least_id.eqNullSafe(F.col("_key")).alias("kept"),
        (F.col("least").isNull() | F.col("least").eqNullSafe(own)).alias("first"),
        F.col("_tx").alias("text_hash"),
    )


def keep_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each component keeps one (least id, then text), all columns; of rows equal in id and text, one.

    Null and empty texts and those without words all stay, repeated rows of them too; an empty table stays empty; no
    name of a column can clash.
    """
    found = near_duplicates(docs, size, percent, id_col, text_col)
    key, tx, first, n = free_names(docs.columns, "_id", "_tx", "_first", "_n")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    odd = found.groupBy(name.alias(key), F.col("text_hash").alias(tx)).agg(F.max("first").alias(first), F.count(F.lit(1)).alias(n), F.max("n_shingles").alias("w")).filter(f"not {first} or ({n} > 1 and w > 0)").drop("w")
    odd = materialize(odd)
    marked = docs.withColumns({key: name, tx: F.xxhash64(text_col)})
    marked = join_bounded(marked, odd, [key, tx], "left", 48)
    kept = marked.filter(F.col(first).isNull())
    if odd.filter(first).limit(1).count():
        kept = kept.unionByName(marked.filter(first).dropDuplicates([key, tx]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
