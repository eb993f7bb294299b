"""Calibration: position-conditional empirical p-values and the search for an alarm threshold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUCKETS, DetectorConfig
from ..functions import columns as C
from .detection import cusum

#: Score classes of one unit; ranks are sums over classes and ranks within one.
CLASSES = 2000


def healthy(runs: DataFrame, correct: str = "correct", extractable: str | None = "extractable", truncated: str | None = "truncated") -> DataFrame:
    """Runs that are correct, extractable and not truncated; None leaves a condition out."""
    keep = F.coalesce(F.col(correct) == 1, F.lit(False))
    if extractable:
        keep &= F.coalesce(F.col(extractable), F.lit(False))
    if truncated:
        keep &= ~F.coalesce(F.col(truncated), F.lit(False))
    return runs.where(keep)


def pools(windows: DataFrame, buckets: Sequence[tuple[int, int | None]] = BUCKETS) -> DataFrame:
    """(bucket, score) of reference windows; scores that aren't finite are left out."""
    return windows.where(C.finite(F.col("score"))).select(C.bucket(F.col("end_pos"), buckets).alias("bucket"), "score")


def reference_summary(windows: DataFrame, buckets: Sequence[tuple[int, int | None]] = BUCKETS) -> DataFrame:
    """Windows and different runs of each bucket."""
    rows = windows.where(C.finite(F.col("score"))).withColumn("bucket", C.bucket(F.col("end_pos"), buckets))
    return rows.groupBy("bucket").agg(F.count("*").alias("windows"), F.countDistinct("run_id").alias("trajectories"))


def _class(score: str = "score") -> Column:
    return F.floor(F.least(F.greatest(F.col(score), F.lit(-1e6)), F.lit(1e6)) * CLASSES).cast("long")


def _tail(rows: DataFrame, by: str) -> DataFrame:
    """rows (score, __ref: 1 for a reference score, else 0) with ge (reference scores of their `by` that
    aren't below theirs) and n (all of it).

    A group of scores is sorted in classes: those above are summed up from class counts, those within are
    counted by a RANGE frame. So a bucket with most rows is many tasks' work.
    """
    both = rows.withColumn("__class", _class())
    sums = both.groupBy(by, "__class").agg(F.sum("__ref").alias("__n"))
    down = Window.partitionBy(by).orderBy(F.desc("__class"))
    sums = sums.select(F.col(by).alias("__by"), F.col("__class").alias("__c"), (F.sum("__n").over(down) - F.col("__n")).alias("__above"), F.sum("__n").over(Window.partitionBy(by)).alias("n"))
    within = Window.partitionBy(by, "__class").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.withColumn("__in", F.sum("__ref").over(within)).join(sums, (F.col(by) == sums["__by"]) & (F.col("__class") == sums["__c"]))
    return joined.withColumn("ge", F.col("__above") + F.col("__in")).drop("__class", "__in", "__by", "__c", "__above")


def bare_buckets(windows: DataFrame, reference: str, buckets: Sequence[tuple[int, int | None]] = BUCKETS) -> list[str]:
    """The buckets that have windows but no reference score: at most as many names as there are buckets."""
    rows = windows.groupBy(C.bucket(F.col("end_pos"), buckets).alias("bucket")).agg(F.count_if(F.col(reference) & C.finite(F.col("score"))).alias("n"))
    return sorted(r["bucket"] for r in rows.where("n = 0").collect())


def tail_pvalues(windows: DataFrame, reference: DataFrame | str, buckets: Sequence[tuple[int, int | None]] = BUCKETS, clip: float = 1e-6, bare: Sequence[str] | None = None) -> DataFrame:
    """windows with bucket, num, den and p = num / den clipped: (1 + scores not below) / (1 + all) of the bucket's
    pool, or of all pools together where the bucket has none. A score that isn't finite counts as the largest.

    reference is a table of pools (bucket, score), or the name of a boolean column of windows that marks
    the reference. Windows whose bucket has a pool are ranked once; the rank among all pools is for
    the others only, and isn't planned if bare (see bare_buckets) says that there are none. Without any reference score
    a window's p-value is an error.
    """
    rows = windows.withColumn("bucket", C.bucket(F.col("end_pos"), buckets)).withColumn("__own", F.col("score")).withColumn("__query", F.lit(1))
    marked = F.coalesce(F.col(reference) & C.finite(F.col("score")), F.lit(False)).cast("int") if isinstance(reference, str) else F.lit(0)
    rows = rows.withColumn("__ref", marked).withColumn("score", F.when(C.finite(F.col("score")), F.col("score")).otherwise(F.lit(float("inf"))))
    if not isinstance(reference, str):
        rows = rows.unionByName(reference.select("bucket", "score", F.lit(1).alias("__ref"), F.lit(0).alias("__query")), allowMissingColumns=True)
    out = _tail(rows, "bucket")
    if len(buckets) > 1 and (bare is None or bare):
        if bare is None:
            again, out = out.withColumn("__bare", F.col("n") == 0).drop("ge", "n"), out.where("n > 0")
        else:
            again, out = rows.withColumn("__bare", F.col("bucket").isin(*bare)), out.where(~F.col("bucket").isin(*bare))
        every = _tail(again.where("__bare or __ref = 1").withColumn("__every", F.lit(0)), "__every")
        out = out.unionByName(every.where("__bare").drop("__bare", "__every"))
    pool = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no finite reference score")).cast("long"))
    out = out.where("__query = 1").withColumn("num", (1 + F.col("ge")).cast("long")).withColumn("den", (1 + pool).cast("long")).withColumn("score", F.col("__own"))
    return out.withColumn("p_value", C.clipped(F.col("num") / F.col("den"), clip)).drop("__own", "__query", "__ref", "ge", "n")


def largest_statistic(pvalues: DataFrame, detector: DetectorConfig | None = None) -> DataFrame:
    """(run_id, top): the largest statistic of each run; a run alarms at h iff top >= log h, as nothing
    resets the statistic before the first alarm."""
    d = detector or DetectorConfig()
    return cusum(pvalues, d).groupBy("run_id").agg(F.max("logE").alias("top"))


def threshold_grid(tops: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """(k, threshold, alarms, runs) for each threshold of the grid, from one aggregation of all runs."""
    grid = list(grid or C.thresholds())
    sums = [F.count_if(F.col("top") >= math.log(h)).alias(f"a{i}") for i, h in enumerate(grid)]
    one = tops.agg(F.count("*").alias("runs"), *sums)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(h).alias("threshold"), F.col(f"a{i}").alias("alarms")) for i, h in enumerate(grid)])
    return one.select("runs", F.explode(cells).alias("g")).select("g.*", "runs")


def select_threshold(grid: DataFrame, target: float = 0.05) -> DataFrame:
    """The first threshold whose share of runs with an alarm isn't above the target: one row threshold,
    selected_h (its log), rate, feasible, runs, few (under 30 runs). If there is none, the last one with rate 1."""
    rate = F.when(F.col("runs") > 0, F.col("alarms") / F.col("runs")).otherwise(F.lit(0.0))
    ok = F.when(rate <= target, F.struct("k", "threshold", rate.alias("rate")))
    one = grid.agg(F.min(ok).alias("best"), F.max_by("threshold", "k").alias("last"), F.max("runs").alias("runs"))
    threshold = F.coalesce("best.threshold", "last")
    return one.select(threshold.alias("threshold"), F.log(threshold).alias("selected_h"), F.coalesce("best.rate", F.lit(1.0)).alias("rate"), F.col("best").isNotNull().alias("feasible"), "runs", (F.col("runs") < 30).alias("few"))


def score_quantiles(windows: DataFrame, by: str, q: float = 0.5) -> DataFrame:
    """Exact quantile (linear between ranks), mean, least and largest score and their number, for each group.

    Counts of classes tell which ones hold the quantile; only their scores are kept, those below and above are
    just counted, so that no task has all scores of a group. A row for each group is broadcast; windows are read three times.
    """
    rows = windows.where(C.finite(F.col("score"))).withColumn("__class", _class())
    counts = rows.groupBy(by, "__class").agg(F.count("*").alias("__n"))
    middle = counts.groupBy(F.col(by).alias("__by")).agg(F.percentile("__class", q, F.col("__n")).alias("__c"))
    # A class more on either side, as the quantile of classes is rounded.
    sides = F.max(F.when(F.col("__class") < F.col("__c") - 1e-3, F.col("__class"))).alias("__a"), F.min(F.when(F.col("__class") > F.col("__c") + 1e-3, F.col("__class"))).alias("__b")
    around = counts.join(F.broadcast(middle), F.col(by).eqNullSafe(F.col("__by"))).groupBy("__by").agg(*sides)
    value = F.when(F.col("__class") < F.col("__a"), float("-inf")).when(F.col("__class") > F.col("__b"), float("inf")).otherwise(F.col("score"))
    near = rows.join(F.broadcast(around), F.col(by).eqNullSafe(F.col("__by"))).groupBy("__by", value.alias("__v")).agg(F.count("*").alias("__m"))
    quantiles = near.groupBy("__by").agg(F.percentile("__v", q, F.col("__m")).alias("mu0"))
    runs = rows.groupBy(by, "run_id").agg(F.sum("score").alias("__sum"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("__n"))
    sums = runs.groupBy(by).agg((F.sum("__sum") / F.sum("__n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("__n").alias("windows"), F.count("run_id").alias("runs"))
    return sums.join(F.broadcast(quantiles), F.col(by).eqNullSafe(F.col("__by"))).select(by, "mu0", "mean", "low", "high", "windows", "runs")


def normalized_runs(runs: DataFrame) -> DataFrame:
    """(run_id, window_index, p_value) of runs that have p_values, or windows with a p_value: nulls are skipped."""
    own = F.col("p_values") if "p_values" in runs.columns else F.lit(None).cast("array<double>")
    other: Column = F.transform("windows", lambda w: w["p_value"]) if "windows" in runs.columns else F.lit(None).cast("array<double>")
    return runs.select("run_id", F.posexplode(F.filter(F.coalesce(own, other), lambda p: p.isNotNull())).alias("window_index", "p_value"))


def calibrated(windows: DataFrame, target: float = DetectorConfig.target_rate, detector: DetectorConfig | None = None, buckets: Sequence[tuple[int, int | None]] = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(p-values, threshold) of scored windows (run_id, window_index, end_pos, score) that are their own reference."""
    d = detector or DetectorConfig()
    marked = windows.withColumn("__mine", F.lit(True))
    ps = tail_pvalues(marked, "__mine", buckets, d.p_clip, bare=[]).drop("__mine")
    return ps, select_threshold(threshold_grid(largest_statistic(ps, d)), target)
