"""SimHash near-duplicates: 64-bit fingerprints compared by bit planes with carry-save counters.

near_duplicates links fingerprints within a radius, exactly, in bands of bits. drop_near_duplicates
links texts by the similarity of their shingles: fingerprints that meet in a block are compared by bit
planes, and pairs within a wide radius are verified with the exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, components, save

SEED = 42
#: Buckets with more fingerprints are compared as pairs of blocks of about this many.
BLOCK = 8192
#: Bits that fingerprints of a bucket share at least, about: 2**24 buckets for each choice of bands.
KEY_BITS = 24
#: Texts meet in a block if all hashes of one band agree: at a similarity of 0.8, all but 7 in 100,000 pairs.
BANDS, BAND_HASHES = 24, 5
#: Fingerprints of sets of shingles with a similarity of 0.8 differ in 9.7 bits on average (sd 2.9).
WIDE_RADIUS = 24
#: Blocks with more shingles are compared as pairs of parts of about this many, after so many of their members, the pivots, met all.
BLOCK_SHINGLES, PIVOTS = 1 << 20, 8
#: Offsets and odd multipliers of the bands' hashes.
FLIP, TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_HASHES, 1), np.uint64)
TIMES |= np.uint64(1)
#: Words of 64 comparisons that are held in memory at once, and those whose pairs are.
LANES, PAIR_WORDS = 1 << 19, 1 << 14


def fingerprint(text: str | None, width: int = 4) -> int:
    """Fingerprint of a text: a bit is 1 if it is set in over half of the shingles' hashes.

    Lower-cases A-Z only. A text with fewer words than a shingle is one shingle; a text without words
    (null, empty, white space) has fingerprint zero. Repeated shingles count as often as they occur.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: len(words) - width].tolist()]
    last = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def signatures(docs: DataFrame, width: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, content long) of every document: fp is the fingerprint, content a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, content = batch.columns
            fp = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp), content], names=["doc_id", "fp", "content"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("content"))
    return rows.mapInArrow(run, "doc_id long, fp long, content long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[b, w] has bit b of values 64*w .. 64*w+63, stored vertically (the last word padded)."""
    full = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    full[: len(values)] = values
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of one group (equal, adjacent entries) whose values differ in at most radius bits.

    Each query meets the words of its group's bit planes, 64 values at a time: a plane's differing
    bits are added to bitwise counters (as many as the radius has binary digits, and a sticky
    overflow) by carry-save steps, and every eight planes the words of which all lanes exceed the radius are abandoned.
    """
    n = len(values)
    planes = bit_planes(values)
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    stop = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))  # the end of each one's group
    index = np.arange(n)
    first_word, words = (index + 1) // 64, np.maximum(0, (stop - 1) // 64 - (index + 1) // 64 + 1)
    words[index + 1 >= stop] = 0
    if not words.any():  # each is the only one of its group
        return
    cuts = np.searchsorted(np.cumsum(words), np.arange(LANES, words.sum() + LANES, LANES))
    one = np.uint64(1)
    for a, b in zip([0, *np.minimum(cuts + 1, n)[:-1]], np.minimum(cuts + 1, n), strict=True):
        if not (total := int(words[a:b].sum())):
            continue
        query = np.repeat(index[a:b], words[a:b])
        offset = np.arange(total) - np.repeat(np.cumsum(words[a:b]) - words[a:b], words[a:b])
        word = first_word[query] + offset
        low, high = np.maximum(query + 1 - 64 * word, 0), np.minimum(stop[query] - 64 * word, 64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        alive = (ones >> (64 - high).astype(np.uint64)) & (ones << low.astype(np.uint64))
        q = values[query]
        counters = [np.zeros(total, np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(total, np.uint64)
        for plane in range(64):
            carry = planes[plane][word] ^ (np.uint64(0) - ((q >> np.uint64(plane)) & one))
            for counter in counters:
                kept = counter & carry
                counter ^= carry
                carry = kept
            over |= carry
            if plane % 8 == 7:
                alive &= ~exceeds(counters, over, radius)
                keep = alive != 0
                if not keep.all():
                    query, word, alive, q, over = (v[keep] for v in (query, word, alive, q, over))
                    counters = [c[keep] for c in counters]
                if not len(query):
                    break
        for low in range(0, len(query), PAIR_WORDS):
            lanes = np.unpackbits(alive[low : low + PAIR_WORDS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            yield query[low + k], 64 * word[low + k] + lane


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: counters has its binary digits from the lowest on; over, lanes beyond them."""
    above, equal = over.copy(), ~over
    for digit in range(len(counters) - 1, -1, -1):
        if radius >> digit & 1:
            equal &= counters[digit]
        else:
            above |= equal & counters[digit]
            equal &= ~counters[digit]
    return above


def hang(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; root[x] is the smallest member of x's class, before and after."""
    while True:
        ra, rb = root[a], root[b]
        if (same := ra == rb).all():
            return
        a, b = a[~same], b[~same]
        low, high = np.minimum(ra[~same], rb[~same]), np.maximum(ra[~same], rb[~same])
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def bands_for(radius: int) -> int:
    """The fewest bands whose keys have KEY_BITS bits; it depends on the radius only, so that a fingerprint has as many rows in a table of any size."""
    return next((k for k in range(radius + 1, 65) if 64 * (k - radius) >= KEY_BITS * k), 64)


def link(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that join all within radius differing bits.

    Of k bands of bits, two fingerprints within the radius agree in k - radius at least, so each goes
    to a bucket for each choice of so many bands (radius 4: 35 choices of 3 of 7 bands), and only
    buckets are compared. Buckets of over BLOCK fingerprints are compared block against block in
    separate tasks. A bucket yields the edges of a spanning forest, at most one for each member, not
    all its pairs.
    """
    k = bands_for(radius)
    edge = [round(i * 64 / k) for i in range(k + 1)]
    keys = []
    for i, bands in enumerate(combinations(range(k), k - radius)):
        mask = sum((1 << edge[b + 1]) - (1 << edge[b]) for b in bands)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.choice", "key.bits")
    large = rows.groupBy("choice", "bits").count().where(F.col("count") > BLOCK)
    large = large.select(F.col("choice").alias("c"), F.col("bits").alias("v"), F.ceil(F.col("count") / BLOCK).alias("n_blocks"))
    dealt = rows.join(large, (rows.choice == large.c) & (rows.bits == large.v), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
    other = F.explode(F.when(F.col("n_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0).cast("long"))).withColumn("other", other)
    dealt = dealt.select("fp", "choice", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    by = ["choice", "bits", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table) -> pa.RecordBatch | None:
            columns = [part[c].to_numpy() for c in (*by, "fp")]
            change = np.zeros(len(part), bool)
            for c in columns[:-1]:
                change[1:] |= c[1:] != c[:-1]
            fp = columns[-1].view(np.uint64)
            root = np.arange(len(fp))
            for i, j in close_pairs(fp, np.cumsum(change), radius):
                hang(root, i, j)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(columns[-1][moved]), pa.array(columns[-1][root[moved]])], names=["a", "b"]) if len(moved) else None

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 17:
                continue
            whole = pa.Table.from_batches(held)
            last = [whole[c][-1].as_py() for c in by]
            n_rows, cut_at = len(whole), len(whole)
            same = np.ones(n_rows, bool)
            for c, v in zip(by, last, strict=True):
                same &= whole[c].to_numpy() == v
            cut_at = int(np.argmax(same))  # rows are sorted: the last group starts here
            if cut_at:
                if (out := flush(whole.slice(0, cut_at))) is not None:
                    yield out
                held = whole.slice(cut_at).to_batches()
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a long, b long")


def clusters(signed: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id, root) of each distinct fingerprint: the smallest doc_id and fingerprint reachable by links."""
    nodes = save(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(nodes.select("fp"), radius))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = save(joined)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every row of docs.

    Copies meet as one fingerprint before anything is compared, so links between texts are all found
    without a pair for each two copies. A null doc_id never becomes a component_id unless no member
    has another; repeated rows stay repeated. Texts without words link like any other.
    """
    signed = save(signatures(docs, width))
    out = signed.join(clusters(signed, radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_least(docs: DataFrame, member: DataFrame) -> DataFrame:
    """The row of docs that stays for each root of member (doc_id, content, root): that with the smallest doc_id.

    Nulls come last, and ties of doc_id go to the smaller hash of the text; of rows equal in both, one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "content")
    chosen = member.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("kept_id"), F.col("o.content").alias("kept_content"))
    rows = docs.withColumn("__content", F.xxhash64("text"))
    kept = rows.join(chosen, rows.doc_id.cast("long").eqNullSafe(chosen.kept_id) & (rows["__content"] == chosen.kept_content), "left_semi")
    one = Window.partitionBy("doc_id", "__content").orderBy("__content")
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, with the words of fingerprint; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: len(words) - width].tolist()]
    last = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, each counted once: so its bits follow the similarity of sets."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 14):
        part = np.ascontiguousarray(found[k : k + (1 << 14)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(found)).astype(np.uint8), bitorder="little").view("<u8")[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of the blocks of a set of shingles: a hash of the smallest hashes of each band; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(least, ((found[k : k + 2048] ^ FLIP) * TIMES).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, -1))], np.uint64).view(np.int64)


def set_signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, content, node, fp, size, keys): node stands for a text's set of shingles, fp is its fingerprint, size its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_size(whole, 1)):
            ids, texts, content = batch.columns
            sets = [shingles(t.as_py(), width) for t in texts]
            node, fp = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (lambda s: xxhash.xxh64_intdigest(s.tobytes(), SEED), set_fingerprint))
            keys = [band_keys(s) for s in sets]
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([ids, content, pa.array(node), pa.array(fp), pa.array(np.array([len(s) for s in sets], np.int64)), keys], names=["doc_id", "content", "node", "fp", "size", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("content"))
    return rows.mapInArrow(run, "doc_id long, content long, node long, fp long, size long, keys array<long>")


def similar(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, tenths: int, root: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j of its pairs whose similarity is tenths / 10 at least), for pairs (first, second) sorted by first.

    All pairs of one set are checked at once; with root, pairs that are in one class by then are left out.
    """
    sizes = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(sizes)]
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    fit = 10 * np.minimum(sizes[first], sizes[second]) >= tenths * np.maximum(sizes[first], sizes[second])
    first, second = first[fit], second[fit]
    edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True]) if len(first) else np.zeros(1, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i, rest = int(first[low]), second[low:high]
        if root is not None:
            rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        mine = ids[start[i] : start[i + 1]]
        mark[mine] = True
        met = np.concatenate([ids[start[j] : start[j + 1]] for j in rest])
        common = np.add.reduceat(mark[met], np.r_[0, np.cumsum(sizes[rest])[:-1]], dtype=np.int64)
        mark[mine] = False
        close = rest[10 * common >= tenths * (sizes[i] + sizes[rest] - common)]
        if len(close):
            yield i, close


def linked(fps: np.ndarray, sets: list[np.ndarray], tenths: int, radius: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set, the first one of its class: classes join sets of a similarity of tenths / 10 at least. No set is empty.

    Pairs come from comparing fingerprints by bit planes. Sets of equal known (0: none) are in one class from the start.
    """
    root = np.arange(len(sets))
    if known is not None:
        names, first, place = np.unique(known, return_index=True, return_inverse=True)
        root = np.where(known == 0, root, first[place])
    for first, second in close_pairs(fps, np.zeros(len(fps), np.int64), radius):
        apart = root[first] != root[second]
        first, second = first[apart], second[apart]
        if not len(first):
            continue
        order = np.argsort(first, kind="stable")
        for i, close in similar(sets, first[order], second[order], tenths, root):
            hang(root, np.full(len(close), i), close)
    return root


def link_similar(docs: DataFrame, signed: DataFrame, width: int, tenths: int, radius: int = WIDE_RADIUS) -> DataFrame:
    """Edges (a, b) of nodes whose sets have a similarity of tenths / 10 at least, joining all that a block's comparison finds.

    Texts with one set of shingles are one node. Bands with the same smallest node make one block, so
    that near copies meet in few blocks and not in one for each band; a node has at most BANDS rows in
    a table of any size. In a block of over BLOCK_SHINGLES shingles, all members meet its pivots first (see
    star), and what these join needs no comparison; the rest is compared part against part in separate
    tasks. A part yields the edges of a spanning forest, at most one for each member, not all its pairs.
    """
    one = F.min(F.struct("doc_id", "content")).alias("one")
    nodes = save(signed.where("size > 0").groupBy("node", "fp", "size").agg(one, F.first("keys").alias("keys")))
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = save(rows.join(least, "key").select("leader", "node", "size").distinct())

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["member", "fp", "hashes"])

    def sets_of(chosen: DataFrame) -> DataFrame:
        """(member, fp, hashes) of nodes, from one text of each."""
        own = nodes.join(chosen.select("node").distinct(), "node").select(F.col("node").alias("member"), "fp", F.col("one.doc_id").alias("id"), F.col("one.content").alias("hash"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("content"))
        texts = texts.join(own, texts.doc_id.eqNullSafe(own.id) & (texts.content == own.hash)).select("member", "fp", "text")
        return texts.mapInArrow(hashes, "member long, fp long, hashes binary").dropDuplicates(["member"])

    def run(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        order = np.argsort(node)
        fps = group["fp"].to_numpy()[order].view(np.uint64)
        root = linked(fps, [np.frombuffer(group["hashes"][int(i)].as_py(), np.uint64) for i in order], tenths, radius, group["class"].to_numpy()[order])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[order[moved]], "b": node[order[root[moved]]]})

    zero = F.lit(0).cast("long")
    alone = F.struct(zero.alias("class"), zero.alias("part"))
    large = save(pairs.groupBy("leader").agg(F.sum("size").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select(F.col("leader").alias("l"), F.ceil(F.col("total") / BLOCK_SHINGLES).alias("parts")))
    unpaired = lambda df: df.select("leader", "node", zero.alias("class"), alone.alias("x"), alone.alias("y"))
    dealt, found = unpaired(pairs), None
    if not large.isEmpty():
        members = save(pairs.join(large, pairs.leader == large.l).drop("l"))
        found = save(star(members, sets_of, tenths))
        dealt = unpaired(pairs.join(large, pairs.leader == large.l, "left_anti")).unionByName(rest_of(members, found))
    sets = sets_of(dealt)
    groups = dealt.join(sets, dealt.node == sets.member).select("leader", "x", "y", "node", "class", "fp", "hashes")
    edges = groups.groupBy("leader", "x", "y").applyInArrow(run, "a long, b long")
    return edges if found is None else edges.union(found)


def pivots_of(members: DataFrame) -> DataFrame:
    """(leader, pivot): at most PIVOTS members of each block, the smallest node of each class of hashes."""
    return members.groupBy("leader", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("pivot")).drop("slot")


def star(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], tenths: int) -> DataFrame:
    """Edges (a, b) between all members (leader, node, size, parts) of blocks and their block's pivots, as far as they are similar.

    Each part of a block meets the pivots in a task of its own, so the work grows with the number of members.
    """
    pivots = pivots_of(members).join(members.select("leader", "parts").distinct(), "leader")
    rows = members.select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", F.lit(False).alias("pivot"))
    rows = rows.unionByName(pivots.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"), F.lit(True).alias("pivot")))
    sets = sets_of(members)

    def run(group: pa.Table) -> pa.Table:
        node, pivot = group["node"].to_numpy(), group["pivot"].to_numpy(zero_copy_only=False)
        own = [np.frombuffer(x.as_py(), np.uint64) for x in group["hashes"]]
        centres, others = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        met = similar(own, np.repeat(centres, len(others)), np.tile(others, len(centres)), tenths)
        edges = [np.stack([node[close], np.full(len(close), node[i])]) for i, close in met]
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *edges], axis=1)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    joined = rows.join(sets, rows.node == sets.member).select("leader", "part", "node", "pivot", "hashes")
    return joined.groupBy("leader", "part").applyInArrow(run, "a long, b long")


def rest_of(members: DataFrame, found: DataFrame) -> DataFrame:
    """(leader, node, class, x, y): the pairs of parts of large blocks that are still to be compared, with their members.

    Members that the found edges join with a pivot of their block are of the pivots' class, the others of
    class 0. Classes are dealt to parts. A part of one class but 0 isn't compared with others of that class.
    """
    roots = save(components(found))
    centres = pivots_of(members).join(roots, F.col("pivot") == F.col("node")).select(F.col("leader").alias("cl"), F.col("root").alias("class")).distinct()
    known = members.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").drop("rn")
    known = known.join(centres, (F.col("leader") == F.col("cl")) & (F.col("root") == F.col("class")), "left").withColumn("class", F.coalesce("class", F.lit(0).cast("long"))).select("leader", "node", "size", "class")
    known = save(known)
    parts = known.groupBy("leader", "class").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("n"))
    of = parts.select(F.col("leader").alias("pl"), F.col("class").alias("pc"), "n")
    own = F.struct("class", F.pmod(F.xxhash64("node"), F.col("n")).alias("part"))
    rows = known.join(of, (F.col("leader") == F.col("pl")) & (F.col("class") == F.col("pc"))).select("leader", "node", "class", own.alias("own"))
    blocks = parts.select("leader", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part")).select(F.col("leader").alias("bl"), F.struct("class", "part").alias("other"))
    todo = (F.col("leader") == F.col("bl")) & ((F.col("class") == 0) | (F.col("other.class") != F.col("class")))
    return rows.join(blocks, todo).select("leader", "node", "class", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """The rows of docs of which one is left of all that links of a similarity of tenths / 10 or more join.

    The similarity is the Jaccard index of the texts' sets of shingles; texts without words (null,
    empty, white space) are alike. Which row stays is as in keep_least; repeated rows are one text. An
    empty table gives none; other columns stay as they are.
    """
    signed = save(set_signatures(docs, width))
    roots = components(link_similar(docs, signed, width, tenths)).withColumnRenamed("root", "top")
    member = signed.join(roots, signed.node == roots.node, "left")
    return keep_least(docs, member.select("doc_id", "content", F.coalesce("top", signed.node).alias("root")))
