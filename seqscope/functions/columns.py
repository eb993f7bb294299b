"""Column builders: everything here stays in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUCKETS, DetectorConfig, ScoreConfig

NAN_LOGPROB = -1e9


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a column that a lambda names is computed for each element."""
    return F.transform(F.array(value), use)[0]


def _softmax(logits: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(shifted logits, log of their exponentials' sum); linear in the number of logits."""
    doubles = logits.cast("array<double>")
    norm = lambda sh: F.log(F.aggregate(sh, F.lit(0.0), lambda s, x: s + F.exp(x)))
    shifted = lambda top: F.transform(doubles, lambda x: x - top)
    return bound(F.array_max(doubles), lambda top: bound(shifted(top), lambda sh: use(sh, norm(sh))))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of logits; 0 where it isn't finite."""
    # With Z the sum of exponentials: log Z less the mean of the shifted logits under the softmax.
    mean = lambda sh, lz: F.aggregate(sh, F.lit(0.0), lambda s, x: s + F.exp(x) * x) / F.exp(lz)
    h = _softmax(logits, lambda sh, lz: bound(lz, lambda z: z - mean(sh, z)))
    return bound(h, lambda v: F.when(finite(v), v).otherwise(F.lit(0.0)))


def chosen_logprob(logits: Column, token: Column) -> Column:
    """Log probability of the token (0-based) under the softmax of logits; -1e9 where it isn't finite."""
    lp = _softmax(logits, lambda sh, lz: F.get(sh, token) - lz)
    return bound(lp, lambda v: F.when(finite(v), v).otherwise(F.lit(NAN_LOGPROB)))


def clipped(p: Column, clip: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(clip), p))


def betting(p: Column, gamma: float, clip: float = 1e-6) -> Column:
    """gamma * p ** (gamma - 1) of the clipped p; 1 where that isn't finite and positive."""
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    e = F.lit(gamma) * F.pow(clipped(p, clip), F.lit(gamma - 1))
    return F.when(finite(e) & (e > 0), e).otherwise(F.lit(1.0))


def mixture(p: Column, gammas: Sequence[float] = DetectorConfig.gammas, clip: float = 1e-6) -> Column:
    return reduce(Column.__add__, [betting(p, g, clip) for g in gammas]) / F.lit(float(len(gammas)))


def log_mixture(p: Column, gammas: Sequence[float] = DetectorConfig.gammas, clip: float = 1e-6) -> Column:
    """Log of the mixture, by its largest term."""
    x = F.log(clipped(p, clip))
    logs = [F.lit(math.log(g)) + F.lit(g - 1) * x for g in gammas]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return top + F.log(reduce(Column.__add__, [F.exp(v - top) for v in logs])) - F.lit(math.log(len(gammas)))


def window_score(w: ScoreConfig | None = None) -> Column:
    """Linear score of the columns of window features."""
    w = w or ScoreConfig()
    return (
        F.lit(w.entropy) * F.col("mean_entropy")
        + F.lit(w.logprob) * -F.col("mean_logprob")
        + F.lit(w.repetition) * F.col("repetition_rate")
        + F.lit(w.confident_loop) * F.col("confident_loop")
        + F.lit(w.local_pos) * F.col("local_pos")
        + F.lit(w.local_neg) * F.col("local_neg")
    )


def bucket_name(low: int, high: int | None) -> str:
    return f"{low}-{'inf' if high is None else high}"


def bucket(pos: Column, buckets: Sequence[tuple[int, int | None]] = BUCKETS) -> Column:
    """The bucket that holds a position; the last one for positions that none holds."""
    out = F.lit(bucket_name(*buckets[-1]))
    for low, high in reversed(buckets):
        inside = pos >= low if high is None else (pos >= low) & (pos < high)
        out = F.when(inside, bucket_name(low, high)).otherwise(out)
    return out


def mcnemar(corrections: Column, regressions: Column) -> Column:
    """Exact two-sided binomial p of discordant pairs, for any number of them; 1 without any.

    Terms of the tail grow up to the last one, C(n, k) / 2 ** n. Its logarithm is a sum over the terms, and
    the tail is kept as a multiple of the term reached, so nothing underflows.
    """
    n, k = (corrections + regressions).cast("double"), F.least(corrections, regressions).cast("long")

    def step(state: Column, i: Column) -> Column:
        ratio = (n - i + 1) / i
        return F.struct((state["log"] + F.log(ratio / 2)).alias("log"), (F.lit(1.0) + state["tail"] / ratio).alias("tail"))

    def p(state: Column) -> Column:
        return F.least(F.lit(1.0), 2 * F.exp(state["log"] + F.log(state["tail"]) - (n - k) * math.log(2)))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    folded = F.aggregate(terms, F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("tail")), step)
    return F.when(n == 0, F.lit(1.0)).otherwise(bound(folded, p))


def thresholds(n: int = 80, low: float = 1.01, high: float = 1e8) -> list[float]:
    """n thresholds, evenly spaced in their logarithm."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * i / (n - 1)) for i in range(n)]


def recovery(controlled: Column, plain: Column, full: Column) -> Column:
    d = full - plain
    return F.when(F.abs(d) < 1e-12, F.lit(0.0)).otherwise((controlled - plain) / d)


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of tokens that were seen, divided by the penalty if positive, else multiplied; once a token.

    The logits between seen tokens are taken as slices, so each is looked at once.
    """
    p, q = F.lit(penalty), logits.cast("array<double>")

    def joined(ids: Column) -> Column:
        def part(i: Column, at: Column) -> Column:
            before = F.coalesce(F.get(ids, at - 1), F.lit(-1))
            x = F.get(q, i)
            return F.concat(F.slice(q, before + 2, i - before - 1), F.array(F.when(x < 0, x * p).otherwise(x / p)))

        last = F.when(F.size(ids) > 0, F.element_at(ids, -1)).otherwise(F.lit(-1))
        return F.concat(F.flatten(F.transform(ids, part)), F.slice(q, last + 2, F.size(q)))

    inside = F.array_sort(F.array_distinct(F.filter(seen.cast("array<int>"), lambda i: (i >= 0) & (i < F.size(q)))))
    return bound(inside, joined)


def ngram_mask(logits: Column, tokens: Column, ngram: Column) -> Column:
    """Minus infinity for the token that would complete the n-gram after tokens (a 1-gram always)."""
    q, k, last = logits.cast("array<double>"), F.size(ngram) - 1, F.element_at(ngram, -1).cast("int")
    tail = F.when(k == 0, F.lit(True)).when(F.size(tokens) >= k, F.slice(tokens, -k, k) == F.slice(ngram, F.lit(1), k)).otherwise(F.lit(False))
    hit = tail & (last >= 0) & (last < F.size(q))
    return F.when(hit, F.concat(F.slice(q, F.lit(1), last), F.array(F.lit(float("-inf"))), F.slice(q, last + 2, F.size(q)))).otherwise(q)


def sampled(logits: Column, u: Column, temperature: float = 1.0) -> Column:
    """The token (0-based) at a uniform number u of [0, 1) in the distribution of the softmax of logits over the temperature.

    One pass for the largest logit, one for the sum and one for the place; a sum that rounding leaves below u gives the last token.
    """
    scaled = F.transform(logits.cast("array<double>"), lambda x: x / max(temperature, 1e-6))
    weights = lambda top: F.transform(scaled, lambda x: F.exp(x - top))

    def place(w: Column) -> Column:
        def walk(goal: Column) -> Column:
            # i counts the tokens whose running sum isn't beyond the goal.
            step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["i"] + F.when(s["sum"] + x > goal, 0).otherwise(1)).alias("i"))
            return F.aggregate(w, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i")), step)["i"]

        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        return F.least(bound(u * total, walk), F.size(w) - 1)

    return bound(F.array_max(scaled), lambda top: bound(weights(top), place))


def greedy(logits: Column) -> Column:
    """The first token with the largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def normalized_ascii(text: Column) -> Column:
    """White space of ASCII becomes one space, ends trimmed (see udfs.normalize for all of Unicode)."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def content_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def selection_key(seed: int, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), content), 256)


def item_seed(seed: int, item: Column) -> Column:
    """The first 8 bytes of a hash as a number, without the top bit."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), item), 256)
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(top.cast("string"), F.substring(h, 2, 15)), 16, 10).cast("long")


#: Fixed value: a number that isn't part of a word or a longer number, with grouped thousands or not.
NUMBER = r"(?U)(?<![\w.])([-+]?(?:(?:\d{1,3}(?:[ ,]\d{3})+)|\d+)(?:\.\d+)?)(?!\w)"


def canonical_number(raw: Column) -> Column:
    """Without separators, plus sign, leading zeros and trailing zeros of the fraction; zero has no sign."""
    x = F.regexp_replace(raw, "[ ,+]", "")
    x = F.regexp_replace(x, r"^(-?)0+(?=\d)", "$1")
    x = F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    return F.when(x == "-0", F.lit("0")).otherwise(x)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), canonical_number)


def _first(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.element_at(x, 1))


def _last(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.element_at(x, -1))


def after_marker(text: Column, marker: str = "####") -> Column:
    return F.substring_index(text, marker, -1)


def reference_answer(text: Column, marker: str = "####") -> Column:
    """The first number after the last marker (null if none); without a marker the last number."""
    return F.when(F.contains(text, F.lit(marker)), _first(numbers(after_marker(text, marker)))).otherwise(_last(numbers(text)))


def model_answer(text: Column, marker: str = "####") -> Column:
    """As reference_answer, but without a number after the marker the last one of all."""
    marked = F.when(F.contains(text, F.lit(marker)), _first(numbers(after_marker(text, marker))))
    return F.coalesce(marked, _last(numbers(text)))


# The texts of the two prompts.


def gsm_prompt(question: Column) -> Column:
    return F.concat(F.lit("Solve the following grade-school math problem step by step. Finish with a line in the form #### <answer>.\n\nQuestion: "), F.trim(question), F.lit("\n\nSolution:"))


def math_prompt(problem: Column) -> Column:
    return F.concat(F.lit("Solve the following math problem step by step. Finish with a line in the form #### <answer>.\n\nProblem: "), F.trim(problem), F.lit("\n\nSolution:"))


def completion(tokens: Column, prompt_len: Column, fallback: Column | None = None) -> Column:
    """The tokens after the prompt as text; the fallback where there is no token list."""
    own = F.array_join(F.slice(tokens, prompt_len + 1, F.greatest(F.lit(0), F.size(tokens) - prompt_len)), " ")
    return F.coalesce(own, fallback) if fallback is not None else own
