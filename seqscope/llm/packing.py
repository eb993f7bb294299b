"""Best-fit packing of tokenized documents, planned on the histogram of piece lengths."""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, save, text_of
from .pretoken import SPECIAL, VOCABULARY, path, pieces

CAPACITY = 2048
#: Pre-tokens whose ids a worker keeps; it starts anew beyond.
CACHE = 200_000
#: Rows that one window group of the ranks has, about.
GROUP_ROWS = 1_000


class Encoder:
    """Ids of texts as the vocabulary's own library gives them, as little-endian unsigned 32-bit bytes.

    Pre-tokens don't depend on each other, so each different one is encoded once (by the rank form
    of the same vocabulary). Texts that hold the special string go through the library as a whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encode = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._vocabulary = vocabulary
        self._library = None
        self._known: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path(f"{self._vocabulary}.json"))
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words, counts = pieces([t if SPECIAL not in t else "" for t in texts])
        known = self._known
        if len(known) > CACHE:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = array("I", self._encode(word)).tobytes()
        at = 0
        for text, n in zip(texts, counts, strict=True):
            yield self.library(text) if SPECIAL in text else b"".join([known[w] for w in words[at : at + n]])
            at += n


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces.

    A document's ids are those of its whole text and a closing 0, so an empty or null text is one
    piece with the id 0. Documents longer than capacity are cut into pieces of capacity ids, of which
    the first has what is over. ids are little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for part in by_size(batch, 1):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    at, piece = 0, 0
                    stop = n % capacity or capacity
                    while at < n:
                        own = ids[4 * at : 4 * stop]
                        rows.append((doc, piece, at, stop - at, zlib.crc32(own), *[own] * with_ids))
                        at, stop, piece = stop, stop + capacity, piece + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, per bin, first bin, offset).

    The pieces of a length with ranks from first to end fill bins from first bin on, `per bin` in each,
    from the offset on. A piece takes the fullest bin that holds it; as bins of equal room are alike,
    they are ranges of numbers and a step serves a whole range, so the work follows the number of
    different lengths (capacity at most) and not the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, bins = [], 0

    def put(left: int, low: int, high: int) -> None:
        if left and low < high:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((low, high))

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                fresh = -(-(end - rank) // (capacity // length))
                put(capacity, bins, bins + fresh)
                bins += fresh
                continue
            left = sizes[k]
            low, high = room[left].pop()
            if not room[left]:
                del room[left]
                sizes.pop(k)
            per = left // length
            full = min(high - low, (end - rank) // per)
            if not full:
                per, full = end - rank, 1
            out.append((length, rank, rank + per * full, per, low, capacity - left))
            rank += per * full
            put(left - per * length, low, low + full)
            put(left, low + full, high)
    return np.array(out, np.int64).reshape(-1, 6)


def place(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: each takes the planned slot of its rank within its length.

    Only the histogram (capacity entries at most) and the plan reach the driver. Pieces of a length that
    has more than GROUP_ROWS are ranked in groups, by sums of the groups' counts and ranks within a group, so a length that
    most pieces have isn't one task's; other lengths are a group each. Equal rows may swap their places. No pieces give no sequences.
    """
    histogram = {r[0]: r[1] for r in pieces_.groupBy("length").count().collect()}
    steps = plan(histogram, capacity)
    groups = pieces_.sparkSession.createDataFrame([(n, -(-k // GROUP_ROWS)) for n, k in histogram.items()], "__l long, __n long")
    rows = pieces_.join(F.broadcast(groups), F.col("length") == F.col("__l")).withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__n")))
    counts = rows.where("__n > 1").groupBy("length", "__group").count()
    past = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("__bl"), F.col("__group").alias("__bg"), F.coalesce(F.sum("count").over(past), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.join(base, (F.col("length") == F.col("__bl")) & (F.col("__group") == F.col("__bg")), "left")
    ranked = ranked.withColumn("__rank", F.coalesce("__base", F.lit(0)) + F.row_number().over(within) - 1).drop("__l", "__n", "__bl", "__bg", "__base", "__group")
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    largest = max(histogram.values(), default=0) + 1
    keys = steps[:, 0] * largest + steps[:, 1]
    names = pieces_.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            row = steps[np.searchsorted(keys, length * largest + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents (see token_pieces) with their sequence_id and offset (see place)."""
    return place(save(token_pieces(docs, capacity, vocabulary, with_ids)), capacity)
