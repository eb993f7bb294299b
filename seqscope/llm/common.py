"""Shared helpers: reading tables, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder, remove, save, shared_dir

__all__ = ["WORD", "by_size", "components", "n_words", "new_folder", "remove", "save", "shared_dir", "table", "text_of"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most so many bytes together (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    low = 0
    while low < batch.num_rows:
        before = int(sizes[low - 1]) if low else 0
        high = max(low + 1, int(sizes.searchsorted(before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def text_of(column: str | Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star rounds: each hangs the neighbours of a node under the
    smallest of them, so the number of rounds grows with the logarithm of a component's diameter and
    no component meets in one task. Minima are aggregated before they are shuffled. Nodes without
    an edge to another node have no row; null nodes are ignored.
    """
    spark = edges.sparkSession
    folders = [new_folder(spark)]
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path=folders[-1])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        hung = large.join(small, large.a == small.k).select(F.col("b").alias("a"), F.col("m").alias("b"))
        folders.append(new_folder(spark))
        edges = save(hung.union(small.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), path=folders[-1])
        remove(spark, folders[-2])  # the last round's edges
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
