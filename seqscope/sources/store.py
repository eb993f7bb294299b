"""Run artifacts: a resumable Parquet store, validated reads, frozen settings and provenance."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import tempfile
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs


def write_json(path: str, value: Any) -> None:
    """Small JSON files whole or not at all: written beside, synced, then renamed."""
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text + "\n")
        file.flush()
        os.fsync(file.fileno())
    os.replace(name, path)


def sealed(value: Mapping[str, Any], field: str) -> dict[str, Any]:
    """The value with a hash of all its other fields."""
    body = {k: v for k, v in value.items() if k != field}
    return body | {field: udfs.canonical_sha(body)}


def unsealed(value: Mapping[str, Any], field: str) -> Mapping[str, Any]:
    """The value, if its hash is right."""
    if sealed(value, field)[field] != value.get(field):
        raise ValueError(f"{field} doesn't match the content")
    return value


def pending(items: DataFrame, done: DataFrame, id: str = "item_id") -> DataFrame:
    """Items without an artifact."""
    return items.join(done.select(id), id, "left_anti")


class Store:
    """Artifacts of one run identity as appended Parquet, at most one an item; other identities are refused."""

    def __init__(self, spark: SparkSession, path: str, identity: Mapping[str, Any], schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.identity = udfs.canonical_sha({k: v for k, v in identity.items() if k != "parallel_workers"})

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{self.schema}, identity string")
        if rows.where(F.col("identity") != self.identity).limit(1).count():
            raise ValueError("the store holds artifacts of another run")
        return rows

    def resume(self, items: DataFrame, worker: Callable[[DataFrame], DataFrame], limit: int | None = None, id: str = "item_id") -> int:
        """Runs the worker on items without an artifact (at most limit) and appends what it gives; returns how many were left to do."""
        todo = pending(items, self.read(), id)
        left = todo.count()
        if limit is not None:
            todo = todo.orderBy(id).limit(limit)
        if left:
            worker(todo).withColumn("identity", F.lit(self.identity)).write.mode("append").parquet(self.path)
        return left

    def in_order(self, items: DataFrame, order: str, id: str = "item_id") -> DataFrame:
        """Artifacts in the items' order; items without one are left out."""
        return items.select(id, F.col(order).alias("__order")).join(self.read(), id).orderBy("__order").drop("__order")


def valid(artifacts: DataFrame, items: DataFrame, body: list[str], id: str = "item_id") -> DataFrame:
    """Artifacts whose hash is that of their body and whose seed and content are their item's."""
    want = items.select(id, F.col("item_seed").alias("__seed"), F.col("content_sha256").alias("__content"))
    rows = artifacts.join(want, id).where((F.col("item_seed") == F.col("__seed")) & (F.col("content_sha256") == F.col("__content")))
    return rows.where(udfs.canonical_json_sha(F.struct(*body)) == F.col("artifact_sha256")).drop("__seed", "__content")


def imported(units: DataFrame, source: DataFrame, campaign: str, id: str = "item_id") -> DataFrame:
    """Units with the artifacts of another campaign and a lineage struct; a unit without one is an error."""
    rows = units.join(source.withColumn("__there", F.lit(True)), id, "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no artifact for "), F.col(id).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.withColumn("__there", there).where("__there").withColumn("lineage", F.struct(F.lit(campaign).alias("campaign"), F.col(id).alias("source_id"))).drop("__there")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files in any store."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def tree_hash(root: str, pattern: str = "**/*.py") -> str:
    """A hash of a source tree's paths and contents (driver only)."""
    out = hashlib.sha256()
    for path in sorted(Path(root).glob(pattern)):
        out.update(str(path.relative_to(root)).encode() + b"\0" + hashlib.sha256(path.read_bytes()).digest())
    return out.hexdigest()


def provenance() -> dict[str, str]:
    """Versions of the driver's environment."""
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()}


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, expected, actual) where two tables (key, value) differ."""
    e, a = expected.select("key", F.col("value").alias("expected")), actual.select("key", F.col("value").alias("actual"))
    return e.join(a, "key", "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def freeze(config: Mapping[str, Any], calibration: Mapping[str, Any], manifest_sha256: str) -> dict[str, Any]:
    """What a test run must be run with."""
    return sealed({"config": dict(config), "calibration": dict(calibration), "manifest_sha256": manifest_sha256, "provenance": provenance()}, "freeze_sha256")


def assert_frozen(lock: Mapping[str, Any], config: Mapping[str, Any], calibration: Mapping[str, Any], manifest_sha256: str) -> None:
    """Refuses settings that aren't the frozen ones."""
    unsealed(lock, "freeze_sha256")
    for name, value in (("config", dict(config)), ("calibration", dict(calibration)), ("manifest_sha256", manifest_sha256)):
        if udfs.canonical(lock[name]) != udfs.canonical(value):
            raise ValueError(f"{name} isn't the frozen one")


def guard_calibration(stored: Mapping[str, Any] | None, new: Mapping[str, Any], replace: bool = False) -> Mapping[str, Any]:
    """A stored calibration isn't replaced by another one unless asked for."""
    if stored is not None and not replace and udfs.canonical(stored) != udfs.canonical(new):
        raise ValueError("another calibration is stored")
    return new


def _digest(pools: DataFrame) -> list[list[Any]]:
    """(bucket, scores, order-free hash of them) of each pool: a row a bucket."""
    h = F.sum(F.xxhash64("bucket", "score").cast("decimal(38,0)")).cast("string")
    rows = pools.groupBy("bucket").agg(F.count("*").alias("n"), h.alias("h")).orderBy("bucket").collect()
    return [[r["bucket"], r["n"], r["h"]] for r in rows]


def save_pools(pools: DataFrame, path: str, clip: float = 1e-6) -> None:
    """A calibrator: its pools (bucket, score) as Parquet, and beside them a row with their sealed description."""
    pools.select("bucket", "score").write.parquet(f"{path}/pools")
    saved = pools.sparkSession.read.parquet(f"{path}/pools")
    text = udfs.canonical(sealed({"p_clip": clip, "pools": _digest(saved)}, "calibrator_sha256"))
    pools.sparkSession.createDataFrame([(text,)], "value string").write.text(f"{path}/description")


def load_pools(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The pools and the clip of a saved calibrator, whose description and pools must be those that were saved."""
    body = unsealed(json.loads(spark.read.text(f"{path}/description").first()[0]), "calibrator_sha256")
    pools = spark.read.schema("bucket string, score double").parquet(f"{path}/pools")
    if _digest(pools) != body["pools"]:
        raise ValueError("the pools aren't those that were saved")
    return pools, body["p_clip"]
