"""Data set protocol: normalizing, hashing, deduplicating, splitting and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs

SEED = 20260811


def items(rows: DataFrame, problem: str, source_id: str, order: Sequence[str], ascii_only: bool = True, seed: int = SEED, source: str = "source") -> DataFrame:
    """rows with normal, content_sha256, selection_key, item_id, item_seed and src_ord (the order of the source)."""
    normal = C.normalized_ascii(F.col(problem)) if ascii_only else udfs.normalize(F.col(problem))
    out = rows.withColumn("normal", normal).withColumn("content_sha256", C.content_hash(F.col("normal")))
    out = out.withColumn("selection_key", C.selection_key(seed, F.col("content_sha256")))
    out = out.withColumn("item_id", F.concat_ws(":", F.lit(source), F.col(source_id).cast("string"), F.substring("content_sha256", 1, 16)))
    return out.withColumn("item_seed", C.item_seed(seed, F.col("item_id"))).withColumn("src_ord", F.struct(*order) if len(order) > 1 else F.col(order[0]))


def fallback(*names: str, present: Sequence[str]) -> F.Column:
    """The first of the named columns that is there and not null."""
    return F.coalesce(*[F.col(n) for n in names if n in present], F.lit(None).cast("string"))


def dedupe(rows: DataFrame, keep: str = "first", skip_empty: bool = False) -> DataFrame:
    """One row for each content: the first in source order, or the last; empty problems can be left out.

    Each content's key is a minimum or maximum, combined before the shuffle, so copies don't meet in a task.
    """
    rows = rows.where("normal <> ''") if skip_empty else rows
    pick = (F.min if keep == "first" else F.max)("src_ord")
    chosen = rows.groupBy("content_sha256").agg(pick.alias("__ord")).select(F.col("content_sha256").alias("__h"), "__ord")
    return rows.join(chosen, (rows.content_sha256 == F.col("__h")) & (rows.src_ord == F.col("__ord"))).drop("__h", "__ord")


def take(rows: DataFrame, k: int) -> DataFrame:
    """The k rows with the smallest (selection_key, item_id), by a top-k and not by a sort of all."""
    return rows.orderBy("selection_key", "item_id").limit(k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The same rows with their rank from 1."""
    return take(rows, k).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("selection_key", "item_id")))


def fixed_split(rows: DataFrame, reference: int, development: int) -> DataFrame:
    """rank and role of the first reference + development items by key."""
    out = ranked(rows, reference + development)
    return out.withColumn("role", F.when(F.col("rank") <= reference, "reference").otherwise("development"))


def role_split(sources: dict[str, DataFrame], counts: dict[str, int]) -> DataFrame:
    """Items of each role from its source in turn, without the contents that earlier roles took."""
    taken: DataFrame | None = None
    for role, source in sources.items():
        free = source if taken is None else source.join(taken.select("content_sha256"), "content_sha256", "left_anti")
        own = take(free, counts[role]).withColumn("role", F.lit(role))
        taken = own if taken is None else taken.unionByName(own)
    if taken is None:
        raise ValueError("no roles")
    return taken


def prefix_mismatches(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of an old selection (with rank) that the new one doesn't have at their rank: none if it only grew."""
    o = old.select("rank", *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return o.join(new.select("rank", *columns), "rank", "left").where(~same)


def overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one role has."""
    return rows.groupBy(key).agg(F.countDistinct("role").alias("roles"), F.count("*").alias("rows")).where("roles > 1")


def violations(rows: DataFrame, counts: dict[str, int], required: Sequence[str]) -> DataFrame:
    """(rule, n): how often a manifest breaks each rule: row counts, required values, unique ids and contents, disjoint roles."""
    found = [rows.where(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"missing {c}").alias("rule"), "n") for c in required]
    for role, k in counts.items():
        found.append(rows.where(F.col("role") == role).agg(F.abs(F.count("*") - k).alias("n")).select(F.lit(f"count {role}").alias("rule"), "n"))
    for c in ("item_id", "content_sha256"):
        twice = rows.groupBy("role", c).count().where("count > 1")
        found.append(twice.agg(F.count("*").alias("n")).select(F.lit(f"repeated {c}").alias("rule"), "n"))
        found.append(overlaps(rows, c).agg(F.count("*").alias("n")).select(F.lit(f"shared {c}").alias("rule"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def independent(test: DataFrame, earlier: DataFrame) -> DataFrame:
    """Test items whose content an earlier manifest has in any role."""
    return test.join(earlier.select("content_sha256"), "content_sha256", "left_semi")


def units(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Each item with each replicate seed; seed 0 keeps the item's own seed, others derive one."""
    out = rows.withColumn("source_item_id", F.col("item_id")).withColumn("replicate_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    out = out.withColumn("item_id", F.concat(F.col("source_item_id"), F.lit("|replicate:"), F.col("replicate_seed").cast("string")))
    if list(seeds) == [0]:
        return out
    derived = udfs.stable_seed_udf(SEED)(F.concat_ws("::", F.col("item_seed").cast("string"), F.col("replicate_seed").cast("string")))
    return out.withColumn("item_seed", F.when(F.col("replicate_seed") == 0, F.col("item_seed")).otherwise(derived))


def select_ids(rows: DataFrame, id: str, include: DataFrame | None = None, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """rows whose id is in include, without those in exclude, then the first ones by id."""
    out = rows
    if include is not None:
        out = out.join(include.select(F.col(include.columns[0]).alias(id)).distinct(), id, "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(F.col(exclude.columns[0]).alias(id)).distinct(), id, "left_anti")
    return out if limit is None else out.orderBy(id).limit(max(0, limit))


#: Ids that one value may hold.
MOST_IDS = 20_000_000


def ids_digest(rows: DataFrame, id: str, most: int = MOST_IDS) -> DataFrame:
    """One row ids, ids_sha256: a hash of the sorted different ids, each on a line; an error for over `most` ids.

    The hash is of one text, so the ids must fit in one value; see ids_digests for any number of them.
    """
    different = rows.select(F.col(id).cast("string").alias("id")).where("id is not null").distinct()
    if (n := different.count()) > most:
        raise ValueError(f"{n} ids are too many for one digest")
    ids = F.array_sort(F.collect_list("id"))
    return different.agg(F.size(ids).cast("long").alias("ids"), F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("ids_sha256"))


def ids_digests(rows: DataFrame, id: str, digits: int = 3) -> DataFrame:
    """One row ids, ids_sha256 for any number of ids: a hash of the hashes of 16 ** digits buckets of ids, each sorted within itself."""
    key = F.col(id).cast("string")
    different = rows.select(key.alias("id")).where("id is not null").distinct().withColumn("bucket", F.substring(F.sha2("id", 256), 1, digits))
    parts = different.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "h"))), "\n"), 256).alias("ids_sha256"))


def missing(rows: DataFrame, known: DataFrame, id: str) -> DataFrame:
    """Different ids of rows that known doesn't have."""
    return rows.select(id).distinct().join(known.select(id), id, "left_anti")


def once(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, of which none may have the key of another: an error names one that has."""
    n = Window.partitionBy(*key).orderBy(*key)
    checked = rows.withColumn("__n", F.row_number().over(n))
    fail = F.raise_error(F.concat_ws(" ", F.lit("duplicate unit"), *[F.col(k).cast("string") for k in key])).cast("boolean")
    return checked.where(F.when(F.col("__n") > 1, fail).otherwise(F.lit(True))).drop("__n")


def first_mismatches(left: DataFrame, right: DataFrame, key: str, column: str, most: int = 10) -> DataFrame:
    """(key): the first units, by key, that both sides have and whose column differs."""
    a = once(left, [key]).select(key, F.col(column).alias("__a"))
    b = once(right, [key]).select(F.col(key).alias("__k"), F.col(column).alias("__b"))
    return a.join(b, F.col(key) == F.col("__k")).where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key).orderBy(key).limit(most)


def reproducibility(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: units, those of one side only, and for each column how many units agree (nulls agree with nulls)."""
    a = left.select(F.col(key).alias("__k"), F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = right.select(F.col(key).alias("__k"), F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = a.join(b, "__k", "full_outer")
    paired = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = [F.count_if(paired & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))).alias(f"same_{c}") for c in columns]
    return both.agg(F.count_if(paired).alias("units"), F.count_if(F.col("__b").isNull()).alias("left_only"), F.count_if(F.col("__a").isNull()).alias("right_only"), *same)
