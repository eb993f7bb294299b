"""Candidate selection and per-item accounts of generation events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs


def expand(items: DataFrame, n: int) -> DataFrame:
    """Each item with n candidates: candidate 0 has the item's seed, others derive theirs."""
    out = items.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    derived = udfs.stable_seed_udf()(F.concat_ws("::", F.col("item_seed").cast("string"), F.lit("candidate"), F.col("candidate").cast("string")))
    return out.withColumn("candidate_seed", F.when(F.col("candidate") == 0, F.col("item_seed")).otherwise(derived))


def majority(candidates: DataFrame, item: str = "item_id", index: str = "candidate", answer: str = "answer") -> DataFrame:
    """(item, chosen): the first candidate with the most frequent answer; ties go to the answer that came first, 0 without any answer."""
    votes = candidates.where(F.col(answer).isNotNull()).groupBy(item, answer).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    best = votes.groupBy(item).agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    items = candidates.select(item).distinct()
    return items.join(best, item, "left").select(item, F.coalesce("b.first", F.lit(0)).cast("long").alias("chosen"))


def best_logprob(candidates: DataFrame, item: str = "item_id", index: str = "candidate", value: str = "mean_logprob") -> DataFrame:
    """(item, chosen): the candidate with the largest mean log probability (none counts least), the lowest of ties."""
    key = F.struct((-F.coalesce(F.col(value), F.lit(float("-inf")))).alias("v"), F.col(index).alias("i"))
    return candidates.groupBy(item).agg(F.min(key).alias("b")).select(item, F.col("b.i").cast("long").alias("chosen"))


def rollup(candidates: DataFrame, item: str = "item_id") -> DataFrame:
    """Sampled tokens and seconds in all, and the largest memory, of each item's candidates."""
    return candidates.groupBy(item).agg(F.sum("sampled").alias("sampled"), F.sum("seconds").alias("seconds"), F.max("vram").alias("vram"))


def accounts(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, sampled, emitted, deleted, alarms, rerolls, last) of events (type, span, pos): token events are samples, backtracks delete their span."""
    token, back = F.col("type") == "token", F.col("type") == "backtrack"
    out = events.groupBy(run).agg(F.count_if(token).alias("sampled"), F.coalesce(F.sum(F.when(back, F.col("span"))), F.lit(0)).cast("long").alias("deleted"), F.count_if(F.col("type") == "alarm").alias("alarms"), F.count_if(back).alias("rerolls"), F.max("pos").alias("last"))
    return out.withColumn("emitted", F.col("sampled") - F.col("deleted"))


def spans(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, k, pos, span): each run's backtracks in order, as rows."""
    return events.where("type = 'backtrack'").withColumn("k", F.row_number().over(Window.partitionBy(run).orderBy("pos")) - 1).select(run, "k", "pos", "span")


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """rows with truncated: the reason says so, or (without one) the limit was reached without an end token."""
    old = ~F.coalesce(F.col("eos"), F.lit(False)) & (F.col("n_tokens") >= limit)
    return rows.withColumn("truncated", F.when(F.col("termination_reason").isNotNull(), F.col("termination_reason") == "max_new_tokens").otherwise(old))
