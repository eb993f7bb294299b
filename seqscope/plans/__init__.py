"""Queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detection
from . import protocols, sequences, stores
from .registry import QUERIES, SQL, rounded

__all__ = ["FLAGSHIP_SQL", "QUERIES", "SQL", "flagship", "protocols", "stores"]

FLAGSHIP_SQL = f"""WITH {sequences._CP} SELECT run_id, window_index, changepoint, 32 * window_index + 64 AS token_pos, 32 * changepoint AS rollback_token_pos, round(loge, 6) AS loge FROM cps JOIN stats USING (run_id, window_index)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that degenerate: first alarm of each, where the change began and where a rollback would go."""
    out = detection.rollback_positions(sequences.alarms_of(spark, sf_dir), margin=0)
    return rounded(out.withColumnRenamed("logE", "loge").select("run_id", "window_index", "changepoint", "token_pos", "rollback_token_pos", "loge"))
