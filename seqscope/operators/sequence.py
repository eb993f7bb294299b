"""Token sequences: a bigram token source, n-grams and repeats, sliding windows and their features.

Tables of tokens have run_id, pos (0-based, within the completion), token, logprob and entropy. All
windows are partitioned by run_id, so one exchange serves n-grams, running means and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig, WindowConfig
from ..functions import columns as C

EPS = 1e-8


def split_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", prev: bool = False) -> DataFrame:
    """(run_id, pos, token[, prev]): the words of each text; prev: the word before, <s> for the first one."""
    words = F.filter(F.split(F.col(text), r"[ \t\n\r\f]+"), lambda w: w != "")
    if not prev:
        return docs.select(F.col(id).alias("run_id"), F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    # The words are shifted within a row, so that no run is sorted for it.
    pairs = C.bound(words, lambda w: F.arrays_zip(F.slice(F.concat(F.array(F.lit("<s>")), w), F.lit(1), F.size(w)).alias("prev"), w.alias("token")))
    rows = docs.select(F.col(id).alias("run_id"), F.posexplode(pairs).alias("pos", "pair"))
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "pair.token", "pair.prev")


def bigram_tokens(tokens: DataFrame) -> DataFrame:
    """tokens with logprob and entropy under the bigram model of all of them (a synthetic token source).

    Words and pairs are keys of two 64-bit hashes. Counts of pairs are combined before the shuffle and
    stay where tokens meet them, so the model isn't shuffled again while the words' sums are small enough to
    be broadcast at run time. A frequent pair is a skewed partition of the join, which is split
    at run time, as the model has one row for it.
    """
    order = Window.partitionBy("run_id").orderBy("pos")
    prev = tokens if "prev" in tokens.columns else tokens.withColumn("prev", F.coalesce(F.lag("token").over(order), F.lit("<s>")))
    prev = prev.select("run_id", "pos", "token", *[F.xxhash64(F.lit(i), *c).alias(k) for c, *ks in ((("prev", "token"), "p", "q"), (("prev",), "v", "w")) for i, k in enumerate(ks)])
    pairs = prev.groupBy("p", "q").agg(F.count("*").cast("double").alias("n"), F.first("v").alias("v"), F.first("w").alias("w"))
    # With N the word's count: the entropy is log N - sum(n log n) / N.
    sums = pairs.groupBy("v", "w").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("part"))
    model = pairs.join(sums, ["v", "w"]).select("p", "q", F.log(F.col("n") / F.col("total")).alias("logprob"), F.greatest(F.lit(0.0), F.log("total") - F.col("part") / F.col("total")).alias("entropy"))
    return prev.drop("v", "w").join(model, ["p", "q"]).select("run_id", "pos", "token", "logprob", "entropy")


def martingale(tokens: DataFrame) -> DataFrame:
    """Running sum of logprob + entropy of each run."""
    run = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("m", F.sum(F.col("logprob") + F.col("entropy")).over(run))


def _grams(tokens: DataFrame, low: int, high: int, keep_tokens: bool, features: bool) -> DataFrame:
    """The rows of ngrams; with features, also a row with n = 0 for each token, which has its entropy and the prefix mean.

    One sort of a run gives both. Tokens count as two hashes, so no strings are carried along.
    """
    order = Window.partitionBy("run_id").orderBy("pos")
    rows = tokens.withColumns({"__t": F.xxhash64("token"), "__u": F.xxhash64(F.lit(1), "token")})
    rows = rows.select("run_id", "pos", "logprob", "__t", "__u", *["token"] * keep_tokens, *["entropy"] * features)
    lags = {f"{c}{k}": (F.lag(c, k).over(order) if k else F.col(c)) for c in ("__t", "__u", *["token"] * keep_tokens) for k in range(high)}
    means = {f"__m{n}": F.avg("logprob").over(order.rowsBetween(-(n - 1), 0)) for n in range(low, high + 1)}
    prefix = {"prefix": F.avg("entropy").over(order.rowsBetween(Window.unboundedPreceding, 0))} if features else {}
    rows = rows.withColumns(lags | means | prefix)
    each = []
    for n in range(low, high + 1):
        back = range(n - 1, -1, -1)
        cells = [F.lit(n).alias("n"), F.col(f"__m{n}").alias("mean_logprob"), F.xxhash64(*[F.col(f"__t{k}") for k in back]).alias("k1"), F.xxhash64(F.lit(n), *[F.col(f"__u{k}") for k in back]).alias("k2")]
        if keep_tokens:
            cells.append(F.array(*[F.col(f"token{k}") for k in back]).alias("ngram"))
        each.append(F.when(F.col(f"__t{n - 1}").isNotNull(), F.struct(*cells)))
    if features:
        each.append(F.struct(F.lit(0).alias("n"), F.col("logprob").alias("mean_logprob"), F.col("pos").alias("k1"), F.lit(0).cast("long").alias("k2")))
    out = rows.select("run_id", "pos", *["entropy", "prefix"] * features, F.explode(F.array(*each)).alias("g")).where("g is not null")
    start = F.col("pos") - F.greatest(F.col("g.n"), F.lit(1)) + 1
    return out.select("run_id", "g.*", start.alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), *["entropy", "prefix"] * features)


def ngrams(tokens: DataFrame, low: int = 6, high: int = 8, keep_tokens: bool = False) -> DataFrame:
    """(run_id, n, start_pos, end_pos, mean_logprob, k1, k2[, ngram]): end_pos is exclusive.

    k1 and k2 are two hashes of the tokens that together stand for the n-gram, so no token array is
    shuffled; frames of n rows give the means, without a join of n-grams and tokens.
    """
    return _grams(tokens, low, high, keep_tokens, False)


def without_prompt(grams: DataFrame, prompt: DataFrame) -> DataFrame:
    """n-grams that don't occur among their run's prompt n-grams."""
    return grams.join(prompt.select("run_id", "k1", "k2").distinct(), ["run_id", "k1", "k2"], "left_anti")


def repeats(grams: DataFrame) -> DataFrame:
    """n-grams with repeated (an equal one came before in the run) and delta: how far a repeat's mean log
    probability is above the mean of the earlier ones' (0 at least; 0 if it isn't a repeat)."""
    same = Window.partitionBy("run_id", "n", "k1", "k2").orderBy("end_pos")
    before = F.avg("mean_logprob").over(same.rowsBetween(Window.unboundedPreceding, -1))
    out = grams.withColumn("repeated", F.row_number().over(same) > 1)
    return out.withColumn("delta", F.when(F.col("repeated"), F.greatest(F.lit(0.0), F.col("mean_logprob") - before)).otherwise(F.lit(0.0)))


def _windows_of(start, end, size: int, stride: int):
    """Numbers of the windows [stride * j, stride * j + size) that hold [start, end)."""
    first = F.greatest(F.lit(0), F.ceil((end - size) / stride)).cast("long")
    last = F.floor(start / stride).cast("long")
    return F.when(first <= last, F.sequence(first, last))


def window_repetition(grams: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """(run_id, window_index, n_ngrams, n_repeats, confident_loop) of windows that hold n-grams.

    Each n-gram goes to the windows that hold it, which makes the range join an aggregation.
    """
    spread = grams.withColumn("window_index", F.explode(_windows_of(F.col("start_pos"), F.col("end_pos"), size, stride)))
    return spread.groupBy("run_id", "window_index").agg(F.count("*").alias("n_ngrams"), F.sum(F.col("repeated").cast("long")).alias("n_repeats"), F.max("delta").alias("confident_loop"))


def faulty_ngrams(grams: DataFrame, low, high, top: int = 10) -> DataFrame:
    """The top repeated n-grams of each run inside [low, high): by delta, then by place; an n-gram once.

    low and high are numbers or columns of grams, such as each run's own rollback position and alarm.
    """
    low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    inside = grams.where(F.col("repeated") & (F.col("start_pos") >= low) & (F.col("end_pos") <= high))
    own = Window.partitionBy("run_id", "n", "k1", "k2").orderBy(F.desc("delta"), "end_pos", "n")
    best = inside.withColumn("r", F.row_number().over(own)).where("r = 1")
    order = Window.partitionBy("run_id").orderBy(F.desc("delta"), "end_pos", "n")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("r")


def truncated(tokens: DataFrame, cut) -> DataFrame:
    """Tokens before a position; everything else is derived from them again."""
    return tokens.where(F.col("pos") < cut)


def truncated_monitors(runs: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """runs (run_id, n_tokens, cut) with tokens, windows and next_start that a monitor has after it is truncated.

    Windows that end beyond the cut go; the next one starts at 0 if there aren't tokens for one, else after those that stay.
    """
    kept = F.least("n_tokens", "cut")
    windows = F.when(kept >= size, F.floor((kept - size) / stride) + 1).otherwise(F.lit(0)).cast("long")
    return runs.withColumn("tokens", kept).withColumn("windows", windows).withColumn("next_start", F.when(kept < size, F.lit(0).cast("long")).otherwise(windows * stride))


def window_means(tokens: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """(run_id, window_index, start_pos, end_pos, mean_entropy, mean_logprob, prefix_entropy) of full windows.

    Window j is [stride * j, stride * j + size) and is there once all its tokens are; prefix_entropy is the
    mean over [0, end). A token goes to size / stride windows, so windows cost no join.
    """
    run = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("prefix", F.avg("entropy").over(run))
    spread = rows.withColumn("window_index", F.explode(_windows_of(F.col("pos"), F.col("pos") + 1, size, stride)))
    out = spread.groupBy("run_id", "window_index").agg(
        F.count("*").alias("n"), F.avg("entropy").alias("mean_entropy"), F.avg("logprob").alias("mean_logprob"), F.max_by("prefix", "pos").alias("prefix_entropy")
    )
    start = F.col("window_index") * stride
    return out.where(F.col("n") == size).select("run_id", "window_index", start.alias("start_pos"), (start + size).alias("end_pos"), "mean_entropy", "mean_logprob", "prefix_entropy")


def window_features(tokens: DataFrame, config: WindowConfig | None = None, prompt: DataFrame | None = None) -> DataFrame:
    """All features of full windows; prompt: tokens whose n-grams don't count.

    Tokens and n-grams are rows of one table from one pass over a run, and windows one aggregation of it:
    after the shuffle by run nothing is shuffled or joined again.
    """
    w = config or WindowConfig()
    rows = _grams(tokens, w.ngram_min, w.ngram_max, False, True)
    if prompt is not None and w.exclude_prompt_ngrams:
        rows = without_prompt(rows, ngrams(prompt.withColumn("logprob", F.lit(0.0)), w.ngram_min, w.ngram_max))
    spread = repeats(rows).withColumn("window_index", F.explode(_windows_of(F.col("start_pos"), F.col("end_pos"), w.size, w.stride)))
    token, gram = F.col("n") == 0, F.col("n") > 0
    out = spread.groupBy("run_id", "window_index").agg(
        F.count_if(token).alias("n_tokens"),
        F.avg(F.when(token, F.col("entropy"))).alias("mean_entropy"),
        F.avg(F.when(token, F.col("mean_logprob"))).alias("mean_logprob"),
        F.max_by("prefix", F.when(token, F.col("end_pos"))).alias("prefix_entropy"),
        F.count_if(gram).alias("n_ngrams"),
        F.count_if(gram & F.col("repeated")).alias("n_repeats"),
        F.max(F.when(gram, F.col("delta"))).alias("loop"),
    )
    return finished(out.where(F.col("n_tokens") == w.size).withColumns({"start_pos": F.col("window_index") * w.stride, "end_pos": F.col("window_index") * w.stride + w.size}))


def finished(windows: DataFrame, *more: str) -> DataFrame:
    """Sums of full windows with the features that follow from them, and more columns as they are."""
    rate = F.when(F.col("n_ngrams") > 0, F.col("n_repeats") / F.col("n_ngrams")).otherwise(F.lit(0.0))
    ratio = F.log((F.col("mean_entropy") + EPS) / (F.col("prefix_entropy") + EPS))
    out = windows.select("run_id", "window_index", "start_pos", "end_pos", "mean_entropy", "mean_logprob", "prefix_entropy", "n_ngrams", "n_repeats", rate.alias("repetition_rate"), F.coalesce("loop", F.lit(0.0)).alias("confident_loop"), ratio.alias("log_ratio"), *more)
    return out.withColumn("local_pos", F.greatest(F.lit(0.0), F.col("log_ratio"))).withColumn("local_neg", F.greatest(F.lit(0.0), -F.col("log_ratio")))


def scored_windows(tokens: DataFrame, config: WindowConfig | None = None, score: ScoreConfig | None = None, prompt: DataFrame | None = None) -> DataFrame:
    """Window features with their score, rounded to 9 digits so that equal scores are equal everywhere."""
    return rescore(window_features(tokens, config, prompt), score)


def rescore(features: DataFrame, score: ScoreConfig | None = None) -> DataFrame:
    """Stored features with the score of other weights."""
    return features.withColumn("score", F.round(C.window_score(score), 9))
