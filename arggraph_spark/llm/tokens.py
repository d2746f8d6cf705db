"""Token counts, and token ids cut into pieces, in Arrow functions.

Both work on distinct chunks of text that no token crosses. A chunk's encoding is kept for the life of a task in a
table that is emptied when it holds ``CACHE_CHUNKS`` chunks, so that memory stays bounded whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, slices

#: Chunks whose encoding a task holds at once.
CACHE_CHUNKS = 300_000
#: Bytes of text handed to the tokenizer library in one call.
CALL_BYTES = 1 << 18

#: The one boundary inside a text that no sentencepiece token crosses: a space after something else. The next chunk
#: gets that space back as the encoder's own prefix.
_SAFE = re.compile(r"(?<=[^ ]) ")
#: Where letters meet a run of marks before white space: no token of the word tokenizer crosses that boundary.
_MARKS, _CUT = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?|]+)$", "\\1 \\2"
#: White space that the word tokenizer drops; no token crosses it.
_BLANK = "[ \\t\\n\\r]+"
#: Letters that are NFC already.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def calls(chunks: list[str], limit: int = CALL_BYTES):
    """Groups of chunks of about ``limit`` UTF-8 bytes each."""
    group, size = [], 0
    for c in chunks:
        group.append(c)
        size += len(c if c.isascii() else c.encode()) + 8
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, as the sentencepiece model counts it, without added tokens.

    Texts are split where no token can cross (a space after another character), the distinct chunks of about 1 MB of
    text are encoded together, in calls of about ``CALL_BYTES``, and only lengths are kept. Null and empty texts give
    0 bytes and 0 tokens; repeated rows give repeated results; an empty table gives an empty one; other columns aren't
    read, so their names can't clash. Executors read the model at the path ``model``.
    """

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for piece in (sp.id_to_piece(i) for i in range(sp.get_piece_size())):
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"a token of this model crosses a space: {piece!r}")
        known: dict[str, int] = {}
        for b in slices(batches, text_col, 1 << 19):
            texts = [t.replace("▁", " ") if t else "" for t in b.column(text_col).to_pylist()]
            split = [t.split(" ") if "  " not in t and t[:1] != " " else _SAFE.split(t) for t in texts]
            if len(known) > CACHE_CHUNKS:
                known.clear()
            new = [c for c in set().union(*split) if c not in known]
            for group in calls(new):
                known.update(zip(group, map(len, sp.encode(group, num_threads=1)), strict=True))
            known[""] = 1  # only the space itself, at a text's end
            n = [sum(map(known.__getitem__, s)) if t else 0 for t, s in zip(texts, split, strict=True)]
            size = pc.fill_null(pc.binary_length(b.column(text_col)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(id_col), size, pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return mapped(docs.select(id_col, text_col), run, schema)


def taken(flat: np.ndarray, offs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat`` that the codes name, one after another, and their offsets."""
    n = offs[codes + 1] - offs[codes]
    ends = np.append(0, np.cumsum(n))
    return flat[np.repeat(offs[codes] - ends[:-1], n) + np.arange(ends[-1])], ends


def coded(cut: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A list of strings as numbers of distinct strings, these, and the lists' offsets."""
    got = cut.flatten().dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False), got.dictionary, np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()


def chunked(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut at white space and before final marks: the chunks as numbers, the distinct chunks, and the texts' offsets."""
    words, distinct, offs = coded(pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=_BLANK, replacement=" "), " "))
    parts, chunks, at = coded(pc.split_pattern(pc.replace_substring_regex(distinct, pattern=_MARKS, replacement=_CUT), " "))
    codes, ends = taken(parts, at, words)
    return codes, chunks.to_pylist(), ends[offs]


class Numbers(dict):
    """Numbers chunks as they are met; ``new`` has those not encoded yet, in order."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


class ChunkIds:
    """Token ids of chunks, held flat; ``gather`` gives the ids of many chunks in order.

    The tokenizer drops white space, lower-cases, cuts letters from other marks and encodes each by itself. So chunks of
    letters alone, which most are, go straight to the BPE model; others go through the whole tokenizer. Chunk 0 is
    empty, chunk -1 ends a text.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.bytes: dict[int, str] = {}  # the byte-level spelling of letters beyond ASCII
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat, self.lengths = np.array([self.end_id], np.uint32), np.array([0, 1])
        self.starts = np.array([1, 0])

    def letters(self, word: str) -> list[int]:
        word = word.lower()
        if not word.isascii():
            for c in word:
                if ord(c) not in self.bytes:
                    self.bytes[ord(c)] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
            word = word.translate(self.bytes)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def codes(self, distinct: list[str]) -> np.ndarray:
        """The numbers of chunks; new ones are encoded."""
        known = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        chunks, self.number.new = self.number.new, []
        if not chunks:
            return known
        letters, match = self.letters, _LETTERS.fullmatch
        got = [letters(c) if match(c) else None for c in chunks]
        whole = [i for i, ids in enumerate(got) if ids is None]
        for group in calls([chunks[i] for i in whole]):
            for i, e in zip(whole[: len(group)], self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                got[i] = e.ids
            whole = whole[len(group) :]
        n = np.fromiter(map(len, got), np.int64, len(got))
        starts = len(self.flat) + np.cumsum(n) - n
        # The last entry stays that of the end, which chunk -1 names.
        self.lengths = np.concatenate([self.lengths[:-1], n, [1]])
        self.starts = np.concatenate([self.starts[:-1], starts, [0]])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32)])
        return known

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[codes]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], ends


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's token ids and then ``end_id``, cut into pieces of ``capacity``.

    Only sequences of more than ``capacity`` ids are cut; the last piece may be shorter. ``ids_crc32`` is that of the
    ids as little-endian unsigned 32-bit numbers. A null or empty text is the one id ``end_id``; repeated rows give
    repeated pieces; an empty table gives an empty one; other columns aren't read, so their names can't clash. A long
    text is a batch of its own, cut at white space, which no token crosses.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        vocab = ChunkIds(Tokenizer.from_file(tokenizer), end_id)
        for b in slices(batches, text_col, 1 << 21):
            if len(vocab.number) > CACHE_CHUNKS:
                vocab.clear()
            indices, distinct, offs = chunked(b.column(text_col))
            ids, ends = vocab.gather(np.insert(vocab.codes(distinct)[indices], offs[1:], -1))
            doc_ends = ends[offs[1:] + np.arange(len(offs) - 1)]
            rows = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            s = 0
            for r, e in enumerate(doc_ends.tolist()):
                for p, at in enumerate(range(s, e, capacity)):
                    cut = ids[at : min(e, at + capacity)]
                    for k, v in (("row", r), ("piece", p), ("start", at - s), ("length", len(cut)), ("crc", zlib.crc32(cut.astype("<u4").tobytes()))):
                        rows[k].append(v)
                    if with_ids:
                        rows["ids"].append(cut.astype(np.int32))
                s = e
            cols = [b.column(id_col).take(pa.array(rows["row"])), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
            cols += [pa.array(rows["ids"], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names)

    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    names = [f.name for f in fields]
    return mapped(docs.select(id_col, text_col), run, T.StructType(fields))
