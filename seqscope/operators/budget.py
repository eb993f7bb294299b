"""Compute budgets: profiles of paired runs, per-item budgets and intervention schedules."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs


def rollback_lengths(backtracks: Column) -> Column:
    """Lengths of array<struct<token_pos, rollback_pos, alert_rollback_pos>>: 1 at least; incomplete events are left out."""
    at = lambda b: F.coalesce(b["rollback_pos"], b["alert_rollback_pos"])
    whole = F.filter(F.coalesce(backtracks, F.array().cast("array<struct<token_pos:bigint,rollback_pos:bigint,alert_rollback_pos:bigint>>")), lambda b: b["token_pos"].isNotNull() & at(b).isNotNull())
    return F.transform(whole, lambda b: F.greatest(F.lit(1).cast("long"), b["token_pos"] - at(b)))


def templates(vanilla: DataFrame, controlled: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Paired runs of equal id, seed and condition: extra_decode_tokens, backtrack_count, rollback_lengths, reference_primary_tokens."""
    v = vanilla.select("id", F.col("seed").alias("__seed"), F.col("tokens_generated").alias("reference_primary_tokens"), *[F.col(c).alias(f"__{c}") for c in conditions])
    both = controlled.join(v, "id")
    same = F.col("seed").eqNullSafe(F.col("__seed"))
    for c in conditions:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = both.select("id", *conditions, F.coalesce("extra_sampled", F.lit(0)).cast("double").alias("extra_decode_tokens"), F.size("backtracks").alias("backtrack_count"), rollback_lengths(F.col("backtracks")).alias("rollback_lengths"), "reference_primary_tokens", "decode_events", "alarms", same.alias("same"))
    return out


def pairing_errors(vanilla: DataFrame, controlled: DataFrame, pairs: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """One row unpaired, mismatched, conditions: all well if 0, 0 and 1."""
    a, b = vanilla.select("id", F.lit(1).alias("__a")), controlled.select("id", F.lit(1).alias("__b"))
    lone = a.join(b, "id", "full_outer").agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unpaired"))
    return lone.crossJoin(pairs.agg(F.count_if(~F.col("same")).alias("mismatched"), F.countDistinct(F.struct(*conditions)).alias("conditions")))


def profile(pairs: DataFrame) -> DataFrame:
    """The means of templates."""
    return pairs.agg(
        F.count("*").alias("num_examples"),
        F.avg("extra_decode_tokens").alias("mean_extra_decode_tokens"),
        F.avg("reference_primary_tokens").alias("mean_vanilla_tokens_generated"),
        F.avg("decode_events").alias("mean_decode_events"),
        F.avg((F.col("alarms") > 0).cast("double")).alias("activation_rate"),
        F.avg("backtrack_count").alias("mean_backtracks"),
    )


def campaign_profile(rows: DataFrame) -> DataFrame:
    """Means of runs (spans array, deleted): positive spans count as rollbacks, deleted tokens as extra ones."""
    own = rows.withColumn("spans", F.filter("spans", lambda s: s > 0))
    return own.agg(F.count("*").alias("num_examples"), F.avg("deleted").alias("mean_extra_decode_tokens"), F.avg((F.size("spans") > 0).cast("double")).alias("activation_rate"), F.avg(F.size("spans")).alias("mean_backtracks"))


def per_id(rows: DataFrame, tolerance: float = 0.10, order: Sequence[str] = ("src_ord", "line_no")) -> DataFrame:
    """(id, seed, decode_events, max_decode_events): each id's first row over the sources; events fall back and must be positive."""
    first = rows.groupBy("id").agg(F.min_by(F.struct("seed", "token_events_trace", "decode_token_events_total", "tokens_generated"), F.struct(*order)).alias("r"))
    events = F.coalesce("r.token_events_trace", "r.decode_token_events_total", "r.tokens_generated", F.lit(0)).cast("long")
    checked = F.when(events > 0, events).otherwise(F.raise_error(F.concat(F.lit("no positive decode-event count for "), F.col("id").cast("string"))).cast("long"))
    out = first.select("id", F.col("r.seed").alias("seed"), checked.alias("decode_events"))
    return out.withColumn("max_decode_events", F.floor(F.col("decode_events") * (F.lit(1.0) + F.lit(tolerance))).cast("long"))


def periodic(lengths: Column, reference: Column, least: int = 64) -> Column:
    """array<struct<trigger_at, rollback_tokens>>: evenly spaced over the reference length."""
    span, n = F.greatest(F.lit(least + 1), reference), F.size(lengths)
    place = lambda i: F.greatest(F.lit(least).cast("long"), ((i + 1) * span / (n + 1)).cast("long"))
    return F.transform(lengths, lambda v, i: F.struct(place(i).alias("trigger_at"), F.greatest(F.lit(1).cast("long"), v.cast("long")).alias("rollback_tokens")))


def random_schedule(rows: DataFrame, seed: int, least: int = 64) -> DataFrame:
    """rows (id, rollback_lengths, reference_primary_tokens) exploded to (id, k, trigger_at, rollback_tokens), drawn as Python's generator draws."""

    @F.pandas_udf("array<struct<trigger_at:long,rollback_tokens:long>>")
    def draw(id: pd.Series, lengths: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([[{"trigger_at": a, "rollback_tokens": b} for a, b in udfs.random_positions([int(v) for v in ls], int(r), udfs.stable_seed(seed, i), least)] for i, ls, r in zip(id, lengths, reference, strict=True)])

    out = rows.select("id", F.posexplode(draw("id", "rollback_lengths", "reference_primary_tokens")).alias("k", "e"))
    return out.select("id", "k", "e.*")


def assigned(n_templates: int, index: int, base_seed: int, precision: str) -> int:
    """The template that item number index gets: templates in a shuffled order, over and over."""
    return udfs.shuffled(n_templates, udfs.stable_seed(base_seed, precision, "budget-profile"))[index % n_templates]


def restart_subset(rows: DataFrame, index: str, extra: float, vanilla: float, base_seed: int, precision: str) -> DataFrame:
    """The items that start again: as many as the extra tokens pay for, by the smallest seeds of their list index."""
    n = rows.count()
    count = min(n, max(0, round(n * extra / max(1.0, vanilla))))
    seeded = rows.withColumn("__seed", udfs.stable_seed_udf(base_seed, precision, "restart")(F.col(index)))
    return seeded.orderBy("__seed", index).limit(count).drop("__seed")


def restart_count(n: Column, extra: Column, vanilla: Column) -> Column:
    return F.least(n, F.greatest(F.lit(0), F.bround(n * extra / F.greatest(F.lit(1.0), vanilla)))).cast("long")


def revision_budget(mean_extra: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(mean_extra)).cast("long")


def lookup(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows with their id's budget (null if it has none)."""
    return rows.join(budgets, "id", "left")


def first_source(rows: DataFrame, id: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each id's values in its first row over the sources."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(id).agg(first.alias("r")).select(id, *[F.col(f"r.{v}").alias(v) for v in values])




def matched_accounts(rows: DataFrame, revision: int) -> DataFrame:
    """rows (method, first_tokens, second_tokens, chosen, budget) with what a compute-matched baseline decodes.

    restart: chosen items are decoded a second time and the second answer counts; self_correct: each answer is
    revised within the revision budget; the others (schedules) only have their first decode. Nothing goes beyond the item's
    budget (null: none); an attempt that it cuts off counts as exhausted.
    """
    restart, correct = F.col("method") == "restart", F.col("method") == "self_correct"
    wanted = F.when(restart & F.coalesce(F.col("chosen"), F.lit(False)), F.col("second_tokens")).when(correct, F.least(F.col("second_tokens"), F.lit(revision))).otherwise(F.lit(0)).cast("long")
    first = F.least(F.col("first_tokens"), F.coalesce("budget", "first_tokens")).cast("long")
    extra = F.least(wanted, F.coalesce(F.col("budget") - first, wanted)).cast("long")
    out = rows.withColumn("primary_tokens_generated", first).withColumn("extra_decode_tokens", extra).withColumn("decode_token_events_total", F.col("primary_tokens_generated") + F.col("extra_decode_tokens"))
    final = F.when(restart & (F.col("extra_decode_tokens") > 0), F.col("extra_decode_tokens")).otherwise(F.col("decode_token_events_total"))
    return out.withColumn("final_tokens_generated", final).withColumn("exhausted", (first < F.col("first_tokens")) | (extra < wanted))


def scheduled_accounts(runs: DataFrame, max_new_tokens: int) -> DataFrame:
    """runs (run_id, schedule: array<struct<trigger_at, rollback_tokens>>) with sampled, deleted, emitted and rollbacks.

    Without a detector the events of a run follow from its schedule alone: each fires at the first token at
    or after its trigger, at most one a token, and drops the tail. So the accounts are a fold over the schedule.
    """
    start = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("length", "sampled", "deleted", "rollbacks")])

    def step(s: Column, e: Column) -> Column:
        at = F.greatest(e["trigger_at"], s["length"] + 1)
        drop = F.least(at, F.greatest(F.lit(1).cast("long"), e["rollback_tokens"]))
        sampled = s["sampled"] + at - s["length"]
        fires = sampled <= max_new_tokens
        done = F.struct((at - drop).alias("length"), sampled.alias("sampled"), (s["deleted"] + drop).alias("deleted"), (s["rollbacks"] + 1).alias("rollbacks"))
        return F.when(fires, done).otherwise(s)

    folded = F.aggregate(F.array_sort("schedule"), start, step)
    out = runs.select("run_id", folded.alias("f"))
    return out.select("run_id", F.lit(max_new_tokens).cast("long").alias("sampled"), "f.deleted", (F.lit(max_new_tokens) - F.col("f.deleted")).alias("emitted"), "f.rollbacks")
