"""Embedding near-duplicates: cover trees compared by dual traversal, for exact threshold pairs.

Vectors of unit length at a cosine of t are at a distance of sqrt(2 - 2 t), so covering radii bound
cosines. Large labels are dealt to cells around pivots, the upper level of the tree; pairs of cells
that are too far apart for their covering radii are pruned. Each remaining pair of blocks is one
group of bounded size, for which trees with halving radii are built and traversed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save
from .simhash import hang

THRESHOLD = 0.98
#: Vectors of a block; pivots of all labels together; labels that get pivots; candidates for each pivot.
BLOCK, PIVOTS, LABELS, TRIES = 4096, 1024, 256, 4
#: Nodes with so few vectors, or so small a radius, aren't divided further.
LEAF, LEAST_RADIUS = 8, 0.05
SLACK = 1e-9


@dataclass
class Node:
    """The vectors of a node of a cover tree, its centre first, and the farthest distance from it."""

    members: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover_tree(x: np.ndarray, members: np.ndarray | None = None, radius: float = 2.0) -> Node:
    """The cover tree of unit vectors x: children's centres are apart by over half of the level's
    radius, the first one is the node's own centre, and each vector is within that half of its centre."""
    members = np.arange(len(x)) if members is None else members
    to_centre = distances(x[members], x[members[:1]])[:, 0]
    node = Node(members, float(to_centre.max()))
    half = radius / 2
    while half >= LEAST_RADIUS and node.radius <= half:
        half /= 2  # levels at which nothing would be divided
    if len(members) <= LEAF or half < LEAST_RADIUS:
        return node
    left, at = members, to_centre
    while len(left):
        near = at <= half
        near[0] = True
        node.children.append(cover_tree(x, left[near], half))
        left = left[~near]
        if len(left):
            at = distances(x[left], x[left[:1]])[:, 0]
    return node


def dual_traversal(x: np.ndarray, a: Node, y: np.ndarray, b: Node, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of vectors of x under a and of y under b whose cosine is at least the threshold.

    For a is b, each unordered pair comes once. A pair of nodes is pruned if its centres are farther
    apart than both covering radii and the threshold's distance together.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            i, j = np.nonzero(x[a.members] @ y[b.members].T >= threshold)
            i, j = a.members[i], b.members[j]
            yield (i[i < j], j[i < j]) if a is b else (i, j)
            continue
        own, others = a.children or [a], b.children or [b]
        centres = y[[n.members[0] for n in others]]
        radii = np.array([n.radius for n in others])
        for low in range(0, len(own), 512):
            part = own[low : low + 512]
            d = distances(x[[n.members[0] for n in part]], centres)
            near = d <= np.array([n.radius for n in part])[:, None] + radii[None, :] + reach
            pairs = np.argwhere(near)
            if a is b:
                pairs = pairs[pairs[:, 0] + low <= pairs[:, 1]]
            stack += [(part[p], others[q]) for p, q in pairs.tolist()]


def _unit(column: pa.Array, n: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pivots(classes: DataFrame, counts: DataFrame, reach: float, block: int) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of the largest labels, by farthest point among a bounded sample of their vectors."""
    large = counts.where(F.col("count") > block).orderBy(F.desc("count"), "label", "dim").limit(LABELS).collect()
    share = max(1.0, sum(r["count"] / block for r in large) / PIVOTS)
    wanted = {(r["label"], r["dim"]): int(-(-r["count"] // (block * share))) for r in large}
    wanted = {k: n for k, n in wanted.items() if n > 1}
    if not wanted:
        return {}
    chosen = [F.struct(F.lit(a).cast("long").alias("label"), F.lit(b).cast("int").alias("dim")) for a, b in wanted]
    rows = classes.where(F.struct("label", "dim").isin(*chosen)).orderBy(F.xxhash64("embedding"), "cid").limit(TRIES * PIVOTS).select("label", "dim", "embedding").collect()
    out = {}
    for key, n in wanted.items():
        own = np.array([r["embedding"] for r in rows if (r["label"], r["dim"]) == key], float)
        if len(own) < 2:
            continue
        own = own / np.abs(own).max(1, keepdims=True)
        own = own / np.sqrt((own * own).sum(1, keepdims=True))
        picked, far = [0], distances(own, own[:1])[:, 0]
        while len(picked) < n and far.max() > reach:
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances(own, own[picked[-1:]])[:, 0])
        out[key] = own[picked]
    return out


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, k1, k2) of all rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can link (vec_id, label, embedding), and their classes of equal label and vector.

    Classes: cid, label, dim, k1, k2, embedding, n (vectors), least (smallest vec_id). Two 64-bit hashes stand for a
    vector, so that no vector is a key. Rows whose vector or label is null, or whose vector is empty, zero or has
    null or non-finite components, can't link.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = keyed(vectors)
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    grouped = rows.groupBy("label", "k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    return rows, save(grouped.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()))


def link(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, links): for each block pair, edges of a spanning forest (b null: none) and, once a class
    and block pair, how many vectors of other classes class a links with there."""
    spark = classes.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    counts = save(classes.groupBy("label", "dim").count())
    pivots = _pivots(classes, counts, reach, block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            cell, away = np.zeros(len(labels), np.int64), np.zeros(len(labels))
            for (label, dim), own in pivots.items():
                rows = np.flatnonzero((labels == label) & (dims == dim))
                if len(rows):
                    d = distances(_unit(batch.column("embedding").take(pa.array(rows)), len(rows)), own)
                    cell[rows], away[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    dealt = classes.select("cid", "label", "dim", "n", "embedding").mapInArrow(deal, "cid long, label long, dim int, n long, embedding array<double>, cell long, away double")
    dealt = save(dealt)
    stats = save(dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"), F.max("away").alias("radius")))
    near = []
    if pivots:
        keys = [F.struct(F.lit(a).cast("long").alias("label"), F.lit(b).cast("int").alias("dim")) for a, b in pivots]
        radius = {(r["label"], r["dim"], r["cell"]): r["radius"] for r in stats.where(F.struct("label", "dim").isin(*keys)).collect()}
        for (label, dim), own in pivots.items():
            cells = [c for c in range(len(own)) if (label, dim, c) in radius]
            r = np.array([radius[label, dim, c] for c in cells])
            close = distances(own[cells], own[cells]) <= r[:, None] + r[None, :] + reach
            near += [(label, dim, cells[i], cells[j]) for i, j in np.argwhere(close).tolist() if i != j]
    same = stats.select("label", "dim", "cell", F.col("cell").alias("other"))
    pairs = same.union(spark.createDataFrame(near, "label long, dim int, cell long, other long")) if near else same
    sizes = stats.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("blocks").alias("n_blocks"))
    on = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))
    pairs = pairs.join(sizes, on & (F.col("cell") == F.col("c"))).drop("l", "d", "c").withColumnRenamed("n_blocks", "own_blocks")
    pairs = pairs.join(sizes, on & (F.col("other") == F.col("c"))).drop("l", "d", "c")
    rows = dealt.drop("away").join(pairs, ["label", "dim", "cell"])
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("own_blocks"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    own, other = F.struct("cell", "sub"), F.struct(F.col("other").alias("cell"), F.col("k").alias("sub"))
    first, second = F.least(own, other), F.greatest(own, other)
    rows = rows.select("cid", "n", "embedding", "label", "dim", first["cell"].alias("a"), first["sub"].alias("ai"), second["cell"].alias("b"), second["sub"].alias("bi"), (own > other).cast("int").alias("side"))
    by = ["label", "dim", "a", "ai", "b", "bi"]

    def compare(part: pa.Table) -> pa.RecordBatch:
        x = _unit(part["embedding"].combine_chunks(), len(part))
        side, cid, n = (part[c].to_numpy() for c in ("side", "cid", "n"))
        split = int((side == 0).sum())  # rows are sorted by side
        links, root = np.zeros(len(part), np.int64), np.arange(len(part))
        left = cover_tree(x[:split]) if split else None
        right = cover_tree(x[split:]) if split < len(part) else None
        alone = part["a"][0].as_py() == part["b"][0].as_py() and part["ai"][0].as_py() == part["bi"][0].as_py()
        if left and (right or alone):
            y, b, shift = (x, left, 0) if alone else (x[split:], right, split)
            for i, j in dual_traversal(x[:split], left, y, b, threshold):
                if len(i):
                    j = j + shift
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    hang(root, i, j)
        got = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cid[got]), pa.array(cid[root[got]]), pa.array(links[got])], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            edges = [np.r_[True, batch.column(c).to_numpy()[1:] != batch.column(c).to_numpy()[:-1]] for c in by]
            starts = np.flatnonzero(np.logical_or.reduce(edges)).tolist()
            for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(low, high - low)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in by):
                    yield compare(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by, "side", "cid").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine in double precision is at least the threshold. Copies are
    compared once and counted by their number. A row that can't link (see classes_of) has no links
    and is its own component. Vectors of different dimensions don't link; repeated rows are copies. An empty table gives none. A null vec_id never is a component_id while another is there.
    """
    rows, classes = classes_of(vectors)
    found = save(link(classes, threshold, block))
    links = found.groupBy(F.col("a").alias("lc")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    known = classes.join(roots, classes.cid == roots.node, "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    known = save(known.join(links, known.cid == links.lc, "left").select("label", "k1", "k2", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    smallest = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    known = known.join(smallest, known.root == smallest.r).select(F.col("label").alias("kl"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "n_links", "component_id")
    all_rows = keyed(vectors).drop("embedding")
    out = all_rows.join(known, (all_rows.label == known.kl) & (all_rows.k1 == known.c1) & (all_rows.k2 == known.c2), "left")
    component = F.when(F.col("kl").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
