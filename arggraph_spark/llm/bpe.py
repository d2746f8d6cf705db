"""Byte-level BPE: ranked merges folded over the bytes of distinct words with higher-order functions.

A text is cut into words by the tokenizer's pattern; what a word becomes doesn't depend on its surroundings. Texts are
taken in blocks, each with a dictionary of its own words, and become numbers in it. The words of all dictionaries meet
by parts, packed; each distinct word of a part is encoded once by the fold below, and the ids go back, packed, to the
blocks that have it, where they take the place of the numbers. So neither driver nor any task holds the words of the
corpus, and no text moves. Decoding concatenates the binary pieces of the ids, in the plan.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, free_names, mapped, release, slices
from .tokens import Numbers, taken

#: Bytes of text in a block.
BLOCK_BYTES = 20 << 20
#: Longer words are folded with a heap outside the plan: the fold over an array takes time by the square of its length.
FOLD_BYTES = 1024
#: Words put together at once.
STEP = 1 << 17
#: Parts of a block's words, by hash; a block's commonest words that are numbered first.
PARTS, COMMON = 512, 16384
#: The literal rank map is a perfect hash with so many buckets and places; a pair's are sums of its ids by these factors.
BUCKETS, PLACES = 65521, 262139
BUCKET, PLACE = (40503, 1), (130363, 271)

#: A token never holds a space that stands after a visible character, other than at its start.
_SAFE = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"\s[ ]|[ ]\s")
#: Ids and ranks are under this.
_NONE = 1 << 21


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def literal(value, kind: str) -> Column:
    """A nested list as a literal, which the optimizer makes from JSON once."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: the id of each byte by ``crc32(byte) % size(singles)``, and a perfect hash of the pairs of
    pieces that make a token, each as ``left << 42 | right << 21 | rank`` at the place of its bucket's shift.

    A token's id is its rank; a byte that isn't a token gets a number after all ranks.
    """
    top = max(ranks.values(), default=-1) + 1
    if top + 256 > _NONE:
        raise ValueError(f"ranks must be under {_NONE - 256}")
    ids = {bytes([b]): ranks.get(bytes([b]), top + b) for b in range(256)} | ranks
    size = next(m for m in range(256, 1 << 16) if len({zlib.crc32(bytes([b])) % m for b in range(256)}) == 256)
    singles = [0] * size
    for b in range(256):
        singles[zlib.crc32(bytes([b])) % size] = ids[bytes([b])]
    buckets: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if (left := ids.get(piece[:i])) is not None and (right := ids.get(piece[i:])) is not None:
                buckets.setdefault((left * BUCKET[0] + right * BUCKET[1]) % BUCKETS, []).append(((left * PLACE[0] + right * PLACE[1]) % PLACES, left << 42 | right << 21 | rank))
    if sum(map(len, buckets.values())) > PLACES * 3 // 4:
        raise ValueError(f"the rank map holds {PLACES * 3 // 4} pairs")
    shifts, table, free = [0] * BUCKETS, [0] * PLACES, bytearray(b"\1" * PLACES)
    for at, pairs in sorted(buckets.items(), key=lambda x: -len(x[1])):
        if len({p for p, _ in pairs}) < len(pairs):
            raise ValueError("two pairs of this vocabulary have one place and bucket")
        shifts[at] = shift = next(s for s in range(PLACES) if all(free[(p + s) % PLACES] for p, _ in pairs))
        for p, entry in pairs:
            table[(p + shift) % PLACES], free[(p + shift) % PLACES] = entry, 0
    if free[shifts[0]]:
        table[shifts[0]] = 1 << 62  # a free place is 0, which differs from all pairs but that of two ids 0, whose place this is
    return literal({"singles": singles, "shifts": shifts, "table": table}, "singles array<bigint>, shifts array<int>, table array<bigint>")


def unlike_merges(ranks: dict[bytes, int]) -> dict[str, int]:
    """The tokens, as hex, that the merges of their bytes don't give: a word that is one of them is that token."""
    return {piece.hex().upper(): rank for piece, rank in ranks.items() if len(piece) > 1 and merged(piece, ranks) != [rank]}


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is a value computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fold_sql(word: str, unlike: bool) -> str:
    """SQL of the token ids of the binary ``word``, with the rank map as ``maps`` and the tokens unlike their merges as
    ``maps.unlike``.

    Pieces are held as ids ``p``, with ``r``, the rank of what each neighbouring pair makes. Each step of the fold merges
    the leftmost pair of lowest rank, held in ``at``, and looks up the two pairs that this makes. (Arrays are made by
    ``transform``: ``concat`` of arrays costs several times as much.)
    """

    def rank(left: str, right: str) -> str:
        shift = f"get(maps.shifts, cast(({left} * {BUCKET[0]} + {right} * {BUCKET[1]}) % {BUCKETS} as int))"
        entry = f"get(maps.table, cast(({left} * {PLACE[0]} + {right} * {PLACE[1]} + {shift}) % {PLACES} as int))"
        return f"least({entry} ^ shiftleft({left}, 42) ^ shiftleft({right}, 21), {_NONE}L)"

    def state(p: str, r: str) -> str:
        lowest = f"coalesce(array_min(transform({r}, (x, i) -> shiftleft(x, 32) | i)), {_NONE << 32}L)"
        at = let("k", lowest, "named_struct('made', shiftright(k, 32), 'place', cast(k & 2147483647 as int))")
        return f"named_struct('p', {p}, 'r', {r}, 'at', {at})"

    made, at = "s.at.made", "s.at.place"
    pieces = f"transform(s.r, (x, i) -> if(i = {at}, {made}, if(i < {at}, s.p[i], s.p[i + 1])))"
    left, right = rank(f"s.p[{at} - 1]", made), rank(made, f"s.p[{at} + 2]")
    ranks = f"transform(slice(s.r, 2, size(s.r)), (x, i) -> if(i > {at}, x, if(i = {at}, {right}, if(i = {at} - 1, {left}, s.r[i]))))"
    step = f"if({made} < {_NONE}L, {let('n', ranks, state(pieces, 'n'))}, s)"
    first = let("r", f"transform(slice(p, 2, size(p)), (x, i) -> {rank('p[i]', 'x')})", state("p", "r"))
    ids = f"transform(sequence(1, length({word})), i -> get(maps.singles, cast(crc32(substring({word}, i, 1)) % size(maps.singles) as int)))"
    folded = let("p", ids, f"aggregate(slice(p, 2, size(p)), {first}, (s, _) -> {step}, s -> cast(s.p as array<int>))")
    if unlike:
        folded = f"coalesce(array_repeat(element_at(maps.unlike, hex({word})), if(map_contains_key(maps.unlike, hex({word})), 1, null)), {folded})"
    return f"if(length({word}) = 0, cast(array() as array<int>), {folded})"


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", many: bool = False) -> DataFrame:
    """``words`` with ids array<int>: each word's token ids, or with ``many`` those of each word of an array, in
    DataFrame functions alone.

    A null or empty word gets no ids; a word that is a token is that token, whatever the merges would give.
    """
    (maps,) = free_names([*words.columns, "ids"], "maps")
    unlike = unlike_merges(ranks)
    table = F.struct(rank_map(ranks).alias("map"), literal(unlike, "map<string,int>").alias("unlike")) if unlike else F.struct(rank_map(ranks).alias("map"))
    word = "cast(coalesce({}, '') as binary)"
    one = let("w", word.format("v" if many else f"`{word_col}`"), fold_sql("w", bool(unlike)))
    every = f"transform(`{word_col}`, v -> {one})" if many else one
    fields = "named_struct('singles', t.map.singles, 'shifts', t.map.shifts, 'table', t.map.table" + (", 'unlike', t.unlike)" if unlike else ")")
    return words.withColumn(maps, table).withColumn("ids", F.expr(let("t", f"`{maps}`", let("maps", fields, every)))).drop(maps)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The binary pieces of the ids, one after another."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    table = F.from_json(F.lit(json.dumps(pieces)), T.ArrayType(T.StringType()))
    return F.get(F.transform(F.array(table), lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))), 0)


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``rows`` with bytes binary: what the ids decode to."""
    return rows.withColumn("bytes", decoded(F.col(ids_col), ranks))


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one word; a heap keeps long words near linear."""
    return [ranks[word]] if word in ranks else merged(word, ranks)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    if n <= 64:
        p = [word[i : i + 1] for i in range(n)]
        r = [ranks.get(word[i : i + 2], _NONE) for i in range(n - 1)]
        while r:
            best = min(r)
            if best == _NONE:
                break
            i = r.index(best)
            p[i : i + 2] = [p[i] + p[i + 1]]
            del r[i]
            if i:
                r[i - 1] = ranks.get(p[i - 1] + p[i], _NONE)
            if i < len(r):
                r[i] = ranks.get(p[i] + p[i + 1], _NONE)
        return [ranks[x] for x in p]
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            if (x := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (x, i, end[to]))
        if (b := before[i]) >= 0 and (x := ranks.get(word[b:to])) is not None:
            heapq.heappush(heap, (x, b, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


#: A chunk that the pattern cuts into one run of letters and one of other marks.
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")


def words_of(chunk: str, find) -> list[str]:
    if m := _SIMPLE.fullmatch(chunk):
        return [m[1], m[2]] if m[2] else [m[1]]
    return find(chunk)


def chunks_of(text: str) -> list:
    """Cuts a text where no word of the pattern crosses. The first chunk is a tuple; the space before others is left out."""
    cut: list = _SAFE.split(text) if _ODD.search(text) or text[:1].isspace() else text.split(" ")
    cut[0] = (cut[0],)
    return cut


def packed(codes: np.ndarray) -> bytes:
    """Numbers in as few bytes as each needs, seven bits a byte, the highest first and the last byte below 128; compressed."""
    parts = []
    for s in range(0, len(codes), STEP):
        some = codes[s : s + STEP]
        size = 1 + sum((some >= 1 << 7 * k for k in range(1, 5)), np.zeros(len(some), np.int64))
        last = np.cumsum(size) - 1
        out = np.zeros(int(last[-1]) + 1, np.uint8)
        for k in range(5):
            long_ = size > k
            out[last[long_] - k] = some[long_] >> 7 * k & 127 | (128 if k else 0)
        parts.append(out)
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return len(out).to_bytes(8, "little") + pa.compress(out, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    out, parts, s = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8), [], 0
    while s < len(out):
        e = min(s + STEP, len(out))
        while out[e - 1] >= 128:
            e -= 1
        some = out[s:e]
        last = np.flatnonzero(some < 128)
        size = np.diff(last, prepend=-1)
        codes = some[last].astype(np.int32)
        for k in range(1, int(size.max())):
            long_ = size > k
            codes[long_] |= (some[last[long_] - k].astype(np.int32) & 127) << 7 * k
        parts.append(codes)
        s = e
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Block:
    """Texts as numbers of the block's own words."""

    def __init__(self, find, simple: bool):
        self.find, self.simple = find, simple
        self.chunks, self.words = Numbers(), Numbers()  # in words, 0 is the empty string
        self.chunks.clear()
        self.flat, self.lengths = [], []
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.bytes = 0

    def add(self, keys: pa.Array, texts: list) -> None:
        split = [chunks_of(t) if t else [] for t in texts]
        self.codes.append(np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int32))
        self.sizes.append(np.array([len(s) for s in split], np.int64))
        self.keys.append(keys)
        self.bytes += sum(len(t) for t in texts if t)
        new, self.chunks.new = self.chunks.new, []
        for c in new:
            c = c[0] if type(c) is tuple else " " + c
            found = words_of(c, self.find) if self.simple else self.find(c)
            self.lengths.append(len(found))
            self.flat.extend(map(self.words.__getitem__, found))

    def row(self, block: int) -> pa.RecordBatch:
        """The block's row; what it was made from is given up on the way."""
        lengths, flat = np.array(self.lengths, np.int32), np.array(self.flat, np.int32)
        self.chunks, self.flat, self.lengths = Numbers(), [], []
        chunks, offs = np.concatenate(self.codes), np.append(0, np.cumsum(lengths, dtype=np.int64))
        self.codes = []
        ends = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(lengths[chunks], out=ends[1:])
        codes = np.empty(int(ends[-1]), np.int32)
        for s in range(0, len(chunks), STEP):
            codes[ends[s] : ends[min(s + STEP, len(chunks))]] = taken(flat, offs, chunks[s : s + STEP])[0]
        n = np.diff(ends[np.append(0, np.cumsum(np.concatenate(self.sizes)))])
        del ends, chunks, flat
        part = np.fromiter((zlib.crc32(w.encode()) % PARTS for w in self.words if w), np.int32, len(self.words) - 1)
        words = pa.array((w for w in self.words if w), pa.string())
        self.words = Numbers()
        order = np.asarray(pc.sort_indices(pa.table([part, words], ["part", "word"]), sort_keys=[("part", "ascending"), ("word", "ascending")])).astype(np.int64)
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        words = words.take(pa.array(order))
        parts = [packed_strings(words.slice(s, e - s)) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        # The commonest words get the least numbers; ``common`` has their places among the sorted words.
        pieces = [codes[s : s + STEP] for s in range(0, len(codes), STEP)]
        count = sum((np.bincount(c, minlength=len(order) + 1) for c in pieces), np.zeros(len(order) + 1, np.int64))[1:][order]
        common = np.argsort(-count, kind="stable")[:COMMON]
        number = np.empty(len(order), np.int32)
        number[order] = np.argsort(places(common, len(order)))
        for c in pieces:
            c[:] = number[c - 1]
        keys = pa.concat_arrays(self.keys)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (keys, pa.array(n, pa.int64()), pa.array(parts, pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists[0], lists[1], pa.array([packed(codes)], pa.binary()), pa.array([packed(common)], pa.binary()), lists[2]], ["block", "keys", "n", "codes", "common", "parts"])


def places(common: np.ndarray, n: int) -> np.ndarray:
    """The place among ``n`` sorted words of each numbered one: first those of ``common``, then the others in order."""
    rest = np.ones(n, bool)
    rest[common] = False
    return np.concatenate([common, np.flatnonzero(rest)])


def packed_strings(strings: pa.Array) -> bytes:
    data, offs = buffers(strings)
    lengths = packed(np.diff(offs))
    return len(lengths).to_bytes(4, "little") + lengths + len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def unpacked_strings(blob: bytes) -> pa.Array:
    n = 4 + int.from_bytes(blob[:4], "little")
    lengths = unpacked(blob[4:n])
    data = pa.decompress(blob[n + 8 :], int.from_bytes(blob[n : n + 8], "little"), codec="zstd", asbytes=True)
    offs = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offs), pa.py_buffer(data))


def packed_lists(lists: pa.Array) -> bytes:
    """Lists of ids as their lengths and the ids."""
    lengths, flat = packed(np.asarray(pc.list_value_length(lists)).astype(np.int64)), np.asarray(lists.flatten()).astype(np.uint32)
    wide = int(flat.max(initial=0)) >> 16 > 0
    data = (flat if wide else flat.astype(np.uint16)).tobytes()
    return len(lengths).to_bytes(4, "little") + lengths + bytes([wide]) + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked_lists(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths)."""
    n = 4 + int.from_bytes(blob[:4], "little")
    data = pa.decompress(blob[n + 9 :], int.from_bytes(blob[n + 1 : n + 9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(data, np.uint32 if blob[n] else np.uint16).astype(np.int32), unpacked(blob[4:n])


def blocks_of(docs: DataFrame, pattern: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """(block, keys, n, codes, common, parts): for each block of texts their ids, their numbers of words, the words'
    numbers, the places of the commonest words, and the sorted words, packed by part."""
    from public_tokenizers import PATTERN as public_pattern  # the one for which words_of and chunks_of have shortcuts

    simple = pattern == public_pattern

    def run(batches):
        import regex
        from pyspark import TaskContext

        find, part, nth, block = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0, None
        for b in slices(batches, "_text", 1 << 20):
            block = block or Block(find, simple)
            block.add(b.column("_key"), b.column("_text").to_pylist())
            if block.bytes >= size:
                yield block.row(part << 32 | nth)
                nth, block = nth + 1, None
        if block:
            yield block.row(part << 32 | nth)

    key = T.ArrayType(docs.schema[id_col].dataType)
    fields = [T.StructField("block", T.LongType()), T.StructField("keys", key), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()), T.StructField("common", T.BinaryType()), T.StructField("parts", T.ArrayType(T.BinaryType()))]
    blocks = mapped(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")), run, T.StructType(fields))
    # Both uses read all columns, so that they share this exchange and the blocks are written once.
    return blocks.repartition("block")


def dictionaries(blocks: DataFrame, ranks: dict[bytes, int], fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """(block, part, ids): the token ids, packed, of the words of each block and part; each distinct word is encoded once.

    Words of a part, which their hash gives, meet from the blocks of 256 tasks, which bounds the row that they make.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    rows = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("blocks", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("at", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("long_ids", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def distinct(table: pa.Table) -> pa.Table:
        lists = [unpacked_strings(b.as_py()) for b in table.column("words")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        n = np.array([len(x) for x in lists], np.int64)
        # Words beyond the fold's length go last, and stand there as their ids.
        long_ = np.asarray(pc.binary_length(coded.dictionary)) > fold_bytes
        order = np.argsort(long_, kind="stable")
        at = np.argsort(order)[np.asarray(coded.indices)]
        words, m = coded.dictionary.take(pa.array(order)), int((~long_).sum())
        long_ids = pa.array([fold(w.encode(), shared.value) for w in words.slice(m).to_pylist()], pa.list_(pa.int32()))
        one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (table.column("block").combine_chunks(), pa.array(n), words.slice(0, m), long_ids)]
        return pa.table([table.column("part").combine_chunks().slice(0, 1), one[0], one[1], pa.array([packed(at)], pa.binary()), one[2], one[3]], rows.names)

    def spread(batches):
        for b in batches:
            for i in range(b.num_rows):
                lists = pa.concat_arrays([b.column("ids").slice(i, 1).flatten(), b.column("long_ids").slice(i, 1).flatten()])
                at, blocks_, n = unpacked(b.column("at")[i].as_py()), b.column("blocks").slice(i, 1).flatten(), np.asarray(b.column("n").slice(i, 1).flatten())
                ends = np.cumsum(n)
                blobs = [packed_lists(lists.take(pa.array(at[e - k : e]))) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([blocks_, pa.array([b.column("part")[i].as_py()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["block", "part", "ids"])

    # Read by a condition that always holds, so that no column is pruned and the exchange of the blocks is reused.
    whole = F.length("codes") + F.length("common") + F.size("keys") + F.size("n") >= 0
    at = blocks.select("block", F.posexplode(F.when(whole, F.col("parts"))).alias("part", "words"))
    words = at.groupBy(F.shiftright("block", 40), "part").applyInArrow(distinct, rows)
    folded = encode_words(words, ranks, "words", many=True).select("part", "blocks", "n", "at", "ids", "long_ids")
    return mapped(folded, spread, T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """(id, ids) of every whole text.

    Each match of ``pattern`` is encoded on its own; special tokens aren't known. Null and empty texts have no tokens.
    Other columns aren't read, so their names can't clash; repeated rows give repeated results; an empty table gives an
    empty one. A text is whole in one block, however long, and takes about ten times its size there.
    """
    blocks = blocks_of(docs, pattern, id_col, text_col, block_bytes)
    key = docs.schema[id_col].dataType

    def assemble(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        out = []
        blobs = dict(zip(dictionary.column("part").to_pylist(), dictionary.column("ids"), strict=True))
        lists = [unpacked_lists(blobs[i].as_py()) for i in sorted(blobs)]
        sorted_flat, lengths = (np.concatenate([x[k] for x in lists]) if lists else np.zeros(0, np.int64) for k in (0, 1))
        sorted_offs = np.append(0, np.cumsum(lengths))
        for keys, n, codes, common in zip(*(block.column(c) for c in ("keys", "n", "codes", "common")), strict=True):
            flat, offs = taken(sorted_flat, sorted_offs, places(unpacked(common.as_py()), len(lengths)))
            codes, ends = unpacked(codes.as_py()), np.append(0, np.cumsum(np.asarray(n.values)))
            s = 0
            while s < len(ends) - 1:
                e = max(s + 1, int(np.searchsorted(ends, ends[s] + STEP, side="right")) - 1)
                ids, at = taken(flat, offs, codes[ends[s] : ends[e]])
                rows = pa.ListArray.from_arrays(pa.array(at[ends[s : e + 1] - ends[s]], pa.int32()), pa.array(ids, pa.int32()))
                out.append(pa.RecordBatch.from_arrays([keys.values.slice(s, e - s), rows], ["key", "ids"]))
                s = e
        release()
        return pa.Table.from_batches(out)

    schema = T.StructType([T.StructField("key", key), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    coded = dictionaries(blocks, ranks, fold_bytes)
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, schema).select(F.col("key").alias(id_col), "ids")
