"""Sequential detection over p-values: CUSUM-shaped statistics, alarms, changepoints, rollback positions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktrackConfig, DetectorConfig
from ..functions import columns as C


def cusum(pvalues: DataFrame, config: DetectorConfig | None = None, run: str = "run_id", order: str = "window_index") -> DataFrame:
    """pvalues with log_e and logE.

    With resets S_j = max(0, S_{j-1}) + log e_j, in closed form the prefix sum less the smallest one
    before it (0 at most); without, the prefix sum.
    """
    d = config or DetectorConfig()
    by = Window.partitionBy(run).orderBy(order)
    rows = pvalues.withColumn("log_e", C.log_mixture(F.col("p_value"), d.gammas, d.p_clip)).withColumn("__sum", F.sum("log_e").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    if not d.reset:
        return rows.withColumnRenamed("__sum", "logE")
    low = F.least(F.lit(0.0), F.coalesce(F.min("__sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.withColumn("logE", F.col("__sum") - low).drop("__sum")


def folded(pvalues: DataFrame, config: DetectorConfig | None = None, run: str = "run_id") -> DataFrame:
    """(run_id, logE array): the same statistic in the recurrence's own order of additions, by a fold."""
    d = config or DetectorConfig()
    rows = pvalues.withColumn("log_e", C.log_mixture(F.col("p_value"), d.gammas, d.p_clip))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("window_index", "log_e"))), lambda r: r["log_e"])
    floor = F.lit(0.0) if d.reset else F.lit(float("-inf"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all"))

    def step(state: Column, e: Column) -> Column:
        s = F.greatest(floor, state["s"]) + e
        return F.struct(s.alias("s"), F.concat(state["all"], F.array(s)).alias("all"))

    return rows.groupBy(run).agg(F.aggregate(ordered, start, step)["all"].alias("logE"))


def first_alarm(stats: DataFrame, h: float, run: str = "run_id") -> DataFrame:
    """(run_id, window_index, logE) of the first window of each run whose statistic reaches h."""
    return stats.where(F.col("logE") >= h).groupBy(run).agg(F.min(F.struct("window_index", "logE")).alias("a")).select(run, "a.window_index", "a.logE")


def changepoints(stats: DataFrame, alarms: DataFrame, run: str = "run_id") -> DataFrame:
    """alarms with changepoint: the last window up to the alarm's whose statistic isn't positive, else 0."""
    a = alarms.select(F.col(run).alias("__run"), F.col("window_index").alias("__at"))
    low = stats.where("logE <= 0").join(a, (F.col(run) == F.col("__run")) & (F.col("window_index") <= F.col("__at")))
    found = low.groupBy(F.col("__run").alias("__r")).agg(F.max("window_index").alias("__cp"))
    return alarms.join(found, alarms[run] == found["__r"], "left").withColumn("changepoint", F.coalesce("__cp", F.lit(0))).drop("__r", "__cp")


def alarms(stats: DataFrame, h: float, run: str = "run_id") -> DataFrame:
    """(run_id, window_index, logE, end_pos, changepoint, changepoint_start): first_alarm and changepoints in one pass.

    The last window whose statistic isn't positive is a running maximum in the order that the statistic
    is computed in, so no window is shuffled or joined. Without such a window the changepoint is 0, at position 0.
    """
    past = Window.partitionBy(run).orderBy("window_index").rowsBetween(Window.unboundedPreceding, 0)
    low = F.max(F.when(F.col("logE") <= 0, F.struct("window_index", "start_pos"))).over(past)
    rows = stats.withColumn("__low", low).where(F.col("logE") >= h)
    one = rows.groupBy(run).agg(F.min_by(F.struct("window_index", "logE", "end_pos", "__low"), "window_index").alias("a"))
    zero = F.lit(0).cast("long")
    return one.select(run, "a.window_index", "a.logE", "a.end_pos", F.coalesce("a.__low.window_index", zero).alias("changepoint"), F.coalesce("a.__low.start_pos", zero).alias("changepoint_start"))


def rollback_positions(alarms: DataFrame, windows: DataFrame | None = None, prompt_len: int = 0, margin: int = BacktrackConfig.margin) -> DataFrame:
    """alarms (with changepoint) with token_pos and rollback_token_pos in the tokens of prompt and completion.

    windows (run_id, window_index, start_pos, end_pos) are only needed if alarms has no end_pos and changepoint_start.
    """
    out = alarms
    if windows is not None:
        own = windows.select(F.col("run_id").alias("__r"), F.col("window_index").alias("__w"), F.col("end_pos").alias("__end"))
        cp = windows.select(F.col("run_id").alias("__r2"), F.col("window_index").alias("__w2"), F.col("start_pos").alias("__start"))
        out = out.join(own, (F.col("run_id") == F.col("__r")) & (F.col("window_index") == F.col("__w")))
        out = out.join(cp, (F.col("run_id") == F.col("__r2")) & (F.col("changepoint") == F.col("__w2")))
    start, end = ("__start", "__end") if windows is not None else ("changepoint_start", "end_pos")
    rollback = F.greatest(F.lit(prompt_len), F.lit(prompt_len) + F.col(start) - margin)
    return out.withColumn("token_pos", F.lit(prompt_len) + F.col(end)).withColumn("rollback_token_pos", rollback).drop("__r", "__w", "__end", "__r2", "__w2", "__start", "changepoint_start")


def stale_windows(windows: DataFrame, alarms: DataFrame, prompt_len: int = 0) -> DataFrame:
    """Windows that end beyond their run's rollback position."""
    cut = alarms.select(F.col("run_id").alias("__r"), (F.col("rollback_token_pos") - prompt_len).alias("__cut"))
    return windows.join(cut, (F.col("run_id") == F.col("__r")) & (F.col("end_pos") > F.col("__cut"))).drop("__r", "__cut")


def above(windows: DataFrame, threshold: float) -> DataFrame:
    """Windows whose score reaches a fixed threshold."""
    return windows.where(F.col("score") >= threshold)


def random_trigger(rows: DataFrame, key: Sequence[str], probability: float, seed: int = 0) -> DataFrame:
    """rows with fired, by a uniform number of the row's key: the same wherever and whenever it is computed."""
    p = min(1.0, max(0.0, probability))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return rows.withColumn("fired", u < p)


def forced_schedule(windows: DataFrame, schedule: DataFrame) -> DataFrame:
    """schedule (run_id, trigger_at, ...) with window_index: events in order of trigger_at take the first
    window that ends at or after it, one event a window, so an event waits for the window after the one before's.

    The first window of each event comes from one running minimum over a run's windows and events by
    position, so an event meets no window but those of its run, once.
    """
    w = windows.select("run_id", F.col("end_pos").alias("__at"), F.lit(1).alias("__kind"), F.col("window_index").cast("long").alias("__w"))
    events = schedule.withColumns({"__at": F.col("trigger_at"), "__kind": F.lit(0), "__w": F.lit(None).cast("long")})
    both = events.unionByName(w, allowMissingColumns=True)
    after = Window.partitionBy("run_id").orderBy("__at", "__kind").rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy("run_id")
    first = both.withColumn("__first", F.min("__w").over(after)).withColumn("__last", F.max("__w").over(all_of)).where("__kind = 0 and __first is not null")
    order = Window.partitionBy("run_id").orderBy("trigger_at")
    n = F.row_number().over(order)
    at = F.max(F.col("__first") - F.col("__n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n")
    out = first.withColumn("__n", n).withColumn("window_index", at)
    return out.where("window_index <= __last").drop("__at", "__kind", "__w", "__first", "__last", "__n")


def decisions(alarms: DataFrame, config: BacktrackConfig | None = None, prompt_len: int = 0) -> DataFrame:
    """alarms (run_id, token_pos, rollback_pos, length) with reroll, refused, cut and span: what the controller does about each.

    The first max_rerolls alarms of a run are rolled back, later ones are refused. A fixed rollback goes back from the alarm's
    token; either is kept between the prompt's end and the run's length.
    """
    b = config or BacktrackConfig()
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("token_pos"))
    goal = F.col("rollback_pos") if b.fixed_rollback is None else F.col("token_pos") - b.fixed_rollback
    cut = F.least(F.greatest(F.lit(prompt_len), goal), F.col("length"))
    out = alarms.withColumn("__n", at).withColumn("refused", F.col("__n") > b.max_rerolls).withColumn("reroll", F.least("__n", F.lit(b.max_rerolls))).drop("__n")
    return out.withColumn("cut", F.when(~F.col("refused"), cut)).withColumn("span", F.when(~F.col("refused"), F.col("length") - F.col("cut")))


def redecoded(tokens: DataFrame, backtracks: DataFrame, config: BacktrackConfig | None = None, base: float = 1.0) -> DataFrame:
    """tokens (run_id, step) with temperature and penalty: from a run's first backtrack (run_id, step) on, those of redecoding."""
    b = config or BacktrackConfig()
    first = backtracks.groupBy(F.col("run_id").alias("__r")).agg(F.min("step").alias("__first"))
    after = F.col("__first").isNotNull() & (F.col("step") > F.col("__first"))
    out = tokens.join(first, F.col("run_id") == F.col("__r"), "left")
    return out.withColumn("temperature", F.when(after, b.temperature).otherwise(base)).withColumn("penalty", F.when(after, b.repetition_penalty).otherwise(1.0)).drop("__r", "__first")


@dataclass
class Detector:
    """The detector's state for one run: statistic, histories since the last reset, refractory windows left."""

    config: DetectorConfig
    h: float
    logE: float = 0.0
    left: int = 0
    history: list[float] = field(default_factory=list)

    def update(self, p: float) -> tuple[float, float, bool, bool]:
        """(e, logE, alarm, refractory) after a p-value."""
        if self.left:
            self.left -= 1
            self.history.append(self.logE)
            return 1.0, self.logE, False, True
        d = self.config
        x = math.log(min(1.0, max(d.p_clip, p)))
        terms = [math.log(g) + (g - 1) * x for g in d.gammas]
        top = max(terms)
        log_e = top + math.log(sum(math.exp(t - top) for t in terms)) - math.log(len(terms))
        self.logE = (max(0.0, self.logE) if d.reset else self.logE) + log_e
        self.history.append(self.logE)
        return math.exp(log_e), self.logE, self.logE >= self.h, False

    def changepoint(self) -> int:
        return next((i for i in range(len(self.history) - 1, -1, -1) if self.history[i] <= 0), 0)

    def reset(self) -> None:
        self.logE, self.history = 0.0, []

    def rest(self) -> None:
        self.left = self.config.refractory


def replay(pvalues: DataFrame, h: float, config: DetectorConfig | None = None, backtrack: BacktrackConfig | None = None) -> DataFrame:
    """(run_id, window_index, logE, alarm, refractory, changepoint, rerolls) of each window of recorded runs.

    An alarm resets the detector and rests it for some windows, up to max_rerolls times; later alarms
    are only recorded. Rows of a run are folded in order as they stream in, so no run is held as a whole but its history since the last reset.
    """
    d, b = config or DetectorConfig(), backtrack or BacktrackConfig()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, rerolls, base = None, Detector(d, h), 0, 0
        for frame in frames:
            out = []
            for run_id, index, p in zip(frame["run_id"], frame["window_index"], frame["p_value"], strict=True):
                if run_id != current:
                    current, state, rerolls, base = run_id, Detector(d, h), 0, int(index)
                _, log_e, alarm, rest = state.update(float(p))
                cp = base + state.changepoint() if alarm else -1
                if alarm and rerolls < b.max_rerolls:
                    rerolls += 1
                    state.reset()
                    state.rest()
                    base = int(index) + 1
                out.append((run_id, index, log_e, alarm, rest, cp, rerolls))
            yield pd.DataFrame(out, columns=["run_id", "window_index", "logE", "alarm", "refractory", "changepoint", "rerolls"])

    rows = pvalues.select("run_id", F.col("window_index").cast("long").alias("window_index"), "p_value").repartition("run_id").sortWithinPartitions("run_id", "window_index")
    kind = dict(pvalues.dtypes)["run_id"]
    return rows.mapInPandas(run, f"run_id {kind}, window_index long, logE double, alarm boolean, refractory boolean, changepoint long, rerolls int")


def log_e_of(p: np.ndarray, config: DetectorConfig | None = None) -> np.ndarray:
    """Log of the mixture for an array of p-values."""
    d = config or DetectorConfig()
    x = np.log(np.clip(p, d.p_clip, 1.0))
    return np.log(np.mean([g * np.exp((g - 1) * x) for g in d.gammas], axis=0))
