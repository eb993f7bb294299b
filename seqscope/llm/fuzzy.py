"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A hash of a window that rolls over the bytes ends a piece wherever it is a multiple of the block size, so borders
depend on the bytes around them only and an edit changes the pieces that it touches. Each piece gives one
letter of a signature. A fingerprint has the signatures at a block size and at twice that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

WINDOW = 7
#: A signature has about so many letters at least where the text has bytes enough, and at most.
LETTERS_LEAST, LETTERS_MOST = 32, 192
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Odd multipliers of the window's and of the pieces' hash, as fractions of 2**64 (golden ratio, root of 2).
ROLL, PIECE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909)
#: Letters that likenesses must have in common in a row.
RUN = 7
#: Rows of a bucket of neighbouring documents, about, and the largest number of buckets of ids.
BUCKET_ROWS, BUCKETS = 4_000, 100_000
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """PIECE ** 0 .. PIECE ** (n - 1), modulo 2**64; kept up to a million."""
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        out = np.full(size, PIECE, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 1 << 20:
            return out[:n]
        _powers = out
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of the numbers over their high bits and back."""
    x = (x ^ (x >> np.uint64(29))) * ROLL
    return x ^ (x >> np.uint64(32))


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the WINDOW bytes that end there (fewer at the start), as by rolling it on."""
    x = data.astype(np.uint64) + np.uint64(1)
    out = x.copy()
    factor = ROLL
    for k in range(1, min(WINDOW, len(x))):
        out[k:] += x[:-k] * factor
        factor = factor * ROLL
    return mixed(out)


def signature(ends: np.ndarray, prefix: np.ndarray, n: int) -> str:
    """A letter for each piece, from a hash of the piece's bytes wherever in the text it stands.

    prefix[i] sums byte[j] * PIECE ** j for j < i. A piece's sum, times PIECE ** (n - start), doesn't
    depend on its place but for a factor that all pieces share.
    """
    stops = ends + 1
    if not len(stops) or stops[-1] != n:
        stops = np.r_[stops, n]
    starts = np.r_[0, stops[:-1]]
    sums = prefix[stops] - prefix[starts]
    return ALPHABET[(mixed(sums * inverse_powers(starts)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


_INVERSE = np.uint64(pow(int(PIECE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """(1 / PIECE) ** at, modulo 2**64, by repeated squaring over the bits of at."""
    out, square = np.ones(len(at), np.uint64), int(_INVERSE)
    for bit in range(int(at.max()).bit_length() if len(at) else 0):
        on = (at >> bit) & 1 == 1
        out[on] *= np.uint64(square)
        square = square * square % (1 << 64)
    return out


def fingerprint(text: str) -> str:
    """blocksize:signature:signature at twice the block size; of the empty text 1::.

    The block size is a power of 2, near the length over 48, halved while the signature has fewer letters
    than LETTERS_LEAST and doubled while it has more than LETTERS_MOST; the whole text is in the signature.
    """
    with np.errstate(over="ignore"):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(data)
        if not n:
            return "1::"
        hashes = rolling(data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
        power = max(0, (n // 48).bit_length() - 1)
        ends = np.flatnonzero((hashes & np.uint64((1 << power) - 1)) == 0)
        while power and len(ends) < LETTERS_LEAST:
            power -= 1
            ends = np.flatnonzero((hashes & np.uint64((1 << power) - 1)) == 0)
        while len(ends) > LETTERS_MOST:
            power += 1
            ends = ends[(hashes[ends] & np.uint64((1 << power) - 1)) == 0]
        twice = ends[(hashes[ends] & np.uint64((2 << power) - 1)) == 0]
        return f"{1 << power}:{signature(ends, prefix, n)}:{signature(twice, prefix, n)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one number (as the edit distance of insertions and deletions is len(a) + len(b) - 2 times it)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def near(a: str, b: str) -> float:
    """1 - edit distance / length of both signatures together, by insertions and deletions.

    Letters of unrelated texts' signatures agree by chance too, but in runs of a few at most: without a
    common run of RUN letters (a quarter of the shorter signature, if that is less) it is 0.
    """
    if a == b:
        return 1.0
    run = max(1, min(RUN, min(len(a), len(b)) // 4))
    if not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 2.0 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the larger likeness of two fingerprints' signatures at equal block sizes; 0 without such."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    at = {int(size_a): one_a, 2 * int(size_a): two_a}
    shared = [near(at[size], s) for size, s in ((int(size_b), one_b), (2 * int(size_b), two_b)) if size in at]
    return max(shared, default=0.0)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, h, bucket, head): docs by buckets of neighbouring ids, which the driver can walk in order.

    A bucket's rows with head true are the first of the next bucket (of the last: of the first), so each
    row's follower is in its own bucket. Order is by doc_id, then the text's hash h; null ids come last,
    in buckets by h. Bounds are quantiles of the ids and only they and each bucket's first key reach the
    driver, so a text is shuffled once.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("h"))
    keys = save(keys)
    total = keys.where("doc_id is not null").count()
    n = min(BUCKETS, max(1, -(-total // bucket_rows)))
    found = keys.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.array(sorted(set(found)), np.int64)

    def bucket_of(batch: pa.RecordBatch) -> np.ndarray:
        ids, h = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("h")).to_numpy()
        out = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "right").astype(np.int64)
        null = np.asarray(ids.is_null())
        out[null] = len(bounds) + 1 + (h[null] >> 58) + 32
        return out

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(batch))], names=["doc_id", "h", "bucket"])

    least = keys.mapInArrow(number, "doc_id long, h long, bucket long").groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("o")).collect()
    least = sorted((r["bucket"], r["o"]["doc_id"], r["o"]["h"]) for r in least)
    before = {(doc, h): least[i - 1][0] for i, (_, doc, h) in enumerate(least)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "h", "bucket", "head"]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(batch)), pa.array(np.zeros(batch.num_rows, bool))], names=names)
            firsts = [(i, before[k]) for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)) if k in before]
            if firsts:
                part = batch.take(pa.array([i for i, _ in firsts]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b for _, b in firsts]), pa.array([True] * len(firsts))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.xxhash64(text_of("text")).alias("h"))
    dealt = rows.mapInArrow(deal, "doc_id long, text string, h long, bucket long, head boolean")
    # As many partitions as buckets, so that a task's texts don't grow with the table.
    return dealt.repartition(max(1, len(least)), "bucket").sortWithinPartitions("bucket", "head", "doc_id", "h")


def fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one that follows in the order of in_order (of the last: the first; of a
    single row: itself). Null texts count as empty. Rows are walked in order, so a task holds a batch of
    texts and the row before it. Two empty texts are alike (1), an empty and another one aren't (0).
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, doc_id, text, fingerprint
        for batch in batches:
            rows = []
            for doc, text, bucket, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "head")), strict=True):
                if last and last[0] == bucket:
                    own = fingerprint(text)
                    new = edited(last[2], text)
                    other = fingerprint(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((last[1], len(last[2]), sha, last[3], other, likeness(last[3], other), likeness(last[3], own)))
                elif not head:
                    own = fingerprint(text)
                last = None if head else (bucket, doc, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return in_order(docs, bucket_rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
