"""Summaries of runs, paired comparisons, bootstrap intervals and corrections for several comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def or_zero(name: str, present: Sequence[str], *others: str) -> Column:
    """The first of the columns that is there and not null, else 0."""
    return F.coalesce(*[F.col(c).cast("double") for c in (name, *others) if c in present], F.lit(0.0))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Means with each metric's own default: one row (none for no rows), or one for each group of by."""
    has = rows.columns
    length = lambda c: F.size(c).cast("double") if c in has else F.lit(0.0)
    count = lambda c, l: F.coalesce(F.col(c).cast("double"), length(l)) if c in has else length(l)  # noqa: E731, E741
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0) if c in has else F.lit(0.0)
    cells = {
        "accuracy": or_zero("correct", has),
        "tokens_generated": count("tokens_generated", "tokens"),
        "latency": or_zero("latency", has),
        "number_of_alerts": count("number_of_alerts", "alerts"),
        "number_of_backtracks": count("number_of_backtracks", "backtracks"),
        "false_alert_rate": flag("false_alert"),
        "degeneration_rate": flag("degenerated"),
    }
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.avg(c).alias(k) for k, c in cells.items()]).where("rows > 0").drop("rows")


def group_summary(rows: DataFrame) -> DataFrame:
    """Measures by precision and method. Accuracy is over scored rows only, null without any; counts that a row lacks fall back to others."""
    has = rows.columns
    scored = F.col("correct").isNotNull()
    right = F.count_if(F.col("correct") == 1)
    tokens = or_zero("tokens_generated", has)
    cells = {
        "mean_tokens_generated": tokens,
        "mean_token_events_trace": or_zero("token_events_trace", has, "tokens_generated"),
        "mean_extra_sampled": or_zero("extra_sampled", has),
        "mean_latency": or_zero("latency", has),
        "mean_alerts": or_zero("n_alerts", has),
        "mean_backtracks": or_zero("n_backtracks", has),
        "mean_interventions": or_zero("n_interventions", has, "n_backtracks"),
        "mean_primary_tokens_generated": or_zero("primary_tokens_generated", has, "tokens_generated"),
        "mean_final_tokens_generated": or_zero("final_tokens_generated", has, "tokens_generated"),
        "mean_total_decode_tokens": or_zero("decode_token_events_total", has, "token_events_trace"),
        "mean_extra_decode_tokens": or_zero("extra_decode_tokens", has, "extra_sampled"),
    }
    failed = F.count_if(scored & ~F.coalesce(F.col("answer_extraction_ok"), F.lit(False)))
    error = F.coalesce(F.avg("budget_match_relative_error"), F.lit(0.0)) if "budget_match_relative_error" in has else F.lit(0.0)
    return rows.groupBy("precision", "method").agg(
        F.count("*").alias("num_instances"),
        F.when(F.count_if(scored) > 0, right / F.count_if(scored)).alias("accuracy"),
        right.alias("num_correct"),
        F.count_if(scored).alias("num_scored"),
        failed.alias("num_answer_extraction_failures"),
        F.max(or_zero("extra_sampled", has)).alias("max_extra_sampled"),
        *[F.avg(c).alias(k) for k, c in cells.items()],
        error.alias("mean_budget_match_relative_error"),
    )


def budget_summary(summary: DataFrame, target: float, tolerance: float = 0.05) -> DataFrame:
    """Groups with the relative error of their extra tokens to the profile's and whether it is within the tolerance."""
    error = (F.col("mean_extra_decode_tokens") - target) / F.lit(target) if target else F.lit(None).cast("double")
    out = summary.select("precision", "method", "mean_extra_decode_tokens", "mean_total_decode_tokens", "mean_latency", error.alias("relative_error_to_profile"))
    return out.withColumn("within_five_percent", F.coalesce(F.abs("relative_error_to_profile") <= tolerance, F.lit(False)))


def derived_rows(rows: DataFrame) -> DataFrame:
    """Result rows (n_tokens, prompt_tokens, trace_events, budget, target_extra) with the counts that follow from them."""
    out = rows.withColumn("tokens_generated", F.greatest(F.lit(0), F.col("n_tokens") - F.col("prompt_tokens")).cast("long"))
    out = out.withColumn("decode_token_events_total", F.coalesce("trace_events", "tokens_generated").cast("long"))
    out = out.withColumn("extra_sampled", F.greatest(F.lit(0), F.col("decode_token_events_total") - F.col("tokens_generated")).cast("long"))
    out = out.withColumn("decode_budget_compliant", F.col("decode_token_events_total") <= F.col("budget"))
    error = F.when(F.coalesce(F.col("target_extra"), F.lit(0.0)) != 0, (F.col("extra_sampled") - F.col("target_extra")) / F.col("target_extra"))
    return out.withColumn("budget_match_relative_error", error)


def method_summary(rows: DataFrame) -> DataFrame:
    """Rates, sums and means by method of (method, correct, extractable, truncated, alarms, rerolls, sampled, emitted, deleted, latency, vram)."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy("method").agg(
        F.count("*").alias("items"),
        F.avg("correct").alias("accuracy"),
        rate(F.col("extractable")).alias("extractability"),
        rate(F.col("truncated")).alias("truncation_rate"),
        rate(F.col("alarms") > 0).alias("items_with_alarm_rate"),
        rate(F.col("rerolls") > 0).alias("items_with_reroll_rate"),
        *[F.sum(c).alias(f"{c}_tokens") for c in ("sampled", "emitted", "deleted")],
        F.avg("sampled").alias("mean_sampled_tokens"),
        F.avg("latency").alias("mean_latency_seconds"),
        F.max("vram").alias("peak_vram_bytes"),
    )


def terminations(rows: DataFrame) -> DataFrame:
    """How often runs of each method ended for each reason."""
    return rows.groupBy("method", F.coalesce("termination_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def grouped_accuracy(rows: DataFrame) -> DataFrame:
    """(method, seed, subject, items, accuracy) over methods, methods by seed and methods by subject, in one pass."""
    named = rows.withColumn("subject", F.when(F.coalesce("subject", F.lit("")) == "", "unknown").otherwise(F.col("subject")))
    sets = [["method"], ["method", "seed"], ["method", "subject"]]
    return named.groupingSets([[F.col(c) for c in s] for s in sets], "method", "seed", "subject").agg(F.count("*").alias("items"), F.avg("correct").alias("accuracy"))


def seed_spread(rows: DataFrame) -> DataFrame:
    """(method, seeds, accuracy_seed_std): the sample deviation of the seeds' accuracies, 0 for a single seed."""
    each = rows.groupBy("method", "seed").agg(F.avg("correct").alias("a"))
    return each.groupBy("method").agg(F.count("*").alias("seeds"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("accuracy_seed_std"))


def oracle_pass_rate(rows: DataFrame) -> DataFrame:
    """(method, rate): the share of items with candidates of which one is correct (array<double> candidates)."""
    some = rows.where(F.size(F.coalesce("candidates", F.array().cast("array<double>"))) > 0)
    return some.groupBy("method").agg(F.avg(F.exists("candidates", lambda c: c == 1).cast("double")).alias("candidate_oracle_pass_rate"))


def unpaired(baseline: DataFrame, method: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that one side alone has."""
    a, b = baseline.select(*key, F.lit(1).alias("__a")), method.select(*key, F.lit(1).alias("__b"))
    return a.join(b, list(key), "full_outer").where("__a is null or __b is null").select(*key)


def pairs(baseline: DataFrame, method: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units of both sides: key, v and m (0 or 1)."""
    left = baseline.select(*key, F.col("correct").cast("int").alias("v"))
    return left.join(method.select(*key, F.col("correct").cast("int").alias("m")), list(key))


def paired(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracies, difference, corrections, regressions and the exact p of paired units."""
    out = both.groupBy(*by).agg(
        F.count("*").alias("paired_units"),
        F.avg("v").alias("baseline_accuracy"),
        F.avg("m").alias("method_accuracy"),
        F.avg(F.col("m") - F.col("v")).alias("difference"),
        F.count_if((F.col("v") == 0) & (F.col("m") == 1)).alias("corrections"),
        F.count_if((F.col("v") == 1) & (F.col("m") == 0)).alias("regressions"),
    )
    return out.withColumn("p", C.mcnemar(F.col("corrections"), F.col("regressions")))


def cluster_means(both: DataFrame, cluster: str) -> DataFrame:
    """(cluster, units, mean_difference): replicates of an item depend on each other, so items are resampled."""
    return both.groupBy(cluster).agg(F.count("*").alias("units"), F.avg(F.col("m") - F.col("v")).alias("mean_difference"))


def token_identity(both: DataFrame) -> DataFrame:
    """One row no_alarm_units, identical, rate of (alarms, left_tokens, right_tokens): without an alarm tokens must agree."""
    calm = both.where(F.coalesce("alarms", F.lit(0)) == 0)
    same = F.count_if(F.col("left_tokens").eqNullSafe(F.col("right_tokens")))
    return calm.agg(F.count("*").alias("no_alarm_units"), same.alias("identical"), F.when(F.count("*") > 0, same / F.count("*")).alias("rate"))


def holm(comparisons: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """comparisons (few rows) with holm_p: step-down over rising p, ties by name."""
    order = Window.partitionBy().orderBy(p, name)
    n = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (n - F.row_number().over(order) + 1) * F.col(p))
    return comparisons.withColumn("__step", step).withColumn("holm_p", F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def bootstrap(clusters: DataFrame, value: str, samples: int = 10_000, seed: int = 20260811, name: str = "name") -> DataFrame:
    """(name, low, high): 2.5 and 97.5 % quantiles of resampled means, with NumPy's generator for parity.

    Only means of clusters come here, so a group is as large as a comparison has problems.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("__order")[value].to_numpy()
        draw = np.random.default_rng(seed)
        means = np.concatenate([draw.choice(values, size=(min(500, samples - i), len(values)), replace=True).mean(1) for i in range(0, samples, 500)])
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"name": [frame[name].iloc[0]], "low": [low], "high": [high]})

    return clusters.groupBy(name).applyInPandas(run, f"name {dict(clusters.dtypes)[name]}, low double, high double")


def bootstrap_hashed(clusters: DataFrame, value: str, samples: int = 200, seed: int = 7, order: str = "k") -> DataFrame:
    """One row low, high: the same interval with draws by a hash of (sample, place), all in the JVM.

    clusters must be numbered from 0 by `order`; each sample draws as many places as there are clusters.
    """
    n = clusters.agg(F.count("*").alias("n"))
    slots = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b")).select("n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") % F.col("n")
    picked = slots.select("b", draw.alias("__pick")).join(clusters.select(F.col(order).alias("__pick"), F.col(value).alias("__v")), "__pick")
    means = picked.groupBy("b").agg(F.avg("__v").alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def running_progress(rows: DataFrame, order: Sequence[str], by: str) -> DataFrame:
    """rows with completed, running accuracy over scored rows and mean sampled tokens, in order of completion."""
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("completed", F.count("*").over(run)).withColumn("running_accuracy", F.avg("correct").over(run)).withColumn("mean_sampled", F.avg("sampled").over(run))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each group's last row."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*by).agg(last.alias("l")).select(*by, *[F.col(f"l.{v}").alias(v) for v in values])
