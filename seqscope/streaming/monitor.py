"""Online monitoring: one state a run walks its tokens through windows, p-values, detector and rollbacks.

The model stays behind a token source: a function from (run, tokens so far, overrides, rerolls) to the next
token with its log probability and entropy. `Monitor` is the state machine; `generate` drives it with a token
source for a batch of runs, `monitor_stream` with a stream of tokens that were sampled elsewhere.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import BUCKETS, Config
from ..functions.columns import bucket_name
from ..operators.detection import Detector
from ..operators.sequence import EPS

Token = tuple[int, float, float]


class Calibrator:
    """Positional tail p-values from sorted pools by bucket."""

    def __init__(self, pools: Mapping[str, Iterable[float]], buckets=BUCKETS, clip: float = 1e-6) -> None:
        self.buckets, self.clip = buckets, clip
        self.pools = {k: sorted(v for v in own if math.isfinite(v)) for k, own in pools.items()}
        self.all = sorted(v for own in self.pools.values() for v in own)
        if not self.all:
            raise ValueError("no finite reference score")
        self.ranges = [(a, math.inf if b is None else b, self.pools.get(bucket_name(a, b)) or self.all) for a, b in buckets]

    def p_value(self, score: float, end_pos: int) -> float:
        x = score if math.isfinite(score) else math.inf
        for low, high, pool in self.ranges:
            if low <= end_pos < high:
                break  # positions that no bucket holds belong to the last one
        return min(1.0, max(self.clip, (1 + len(pool) - bisect.bisect_left(pool, x)) / (len(pool) + 1)))


@dataclass
class Monitor:
    """Tokens, n-grams and windows of one run, the detector and the rollbacks so far."""

    config: Config
    calibrator: Calibrator
    prompt: tuple[int, ...] = ()
    schedule: list[tuple[int, int]] | None = None
    inject: tuple[int, ...] = ()
    tokens: list[Token] = field(default_factory=list)
    windows: list[dict[str, Any]] = field(default_factory=list)
    next_start: int = 0
    rerolls: int = 0
    events: int = 0
    sampled: int = 0
    deleted: int = 0
    indices: list[int] = field(default_factory=list)
    overrides: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.detector = Detector(self.config.detector, math.log(self.config.detector.threshold))
        self.schedule = sorted(self.schedule) if self.schedule is not None else None
        self._rebuild()

    def _rebuild(self) -> None:
        w = self.config.window
        self.seen: dict[tuple[int, ...], tuple[int, float]] = {}
        self.grams: list[tuple[int, int, tuple[int, ...], bool, float]] = []
        self.entropy = [0.0]  # running sums
        # The tokens' columns, so that n-grams and windows are slices.
        self.ids: list[int] = []
        self.logprobs: list[float] = []
        self.entropies: list[float] = []
        self.prompt_grams = {self.prompt[i : i + n] for n in range(w.ngram_min, w.ngram_max + 1) for i in range(len(self.prompt) - n + 1)} if w.exclude_prompt_ngrams else set()
        kept, self.tokens = self.tokens, []
        for t in kept:
            self._add(t)

    def _add(self, token: Token) -> None:
        self.tokens.append(token)
        ids, logprobs, seen, w = self.ids, self.logprobs, self.seen, self.config.window
        ids.append(token[0])
        logprobs.append(token[1])
        self.entropies.append(token[2])
        self.entropy.append(self.entropy[-1] + token[2])
        n = len(ids)
        for size in range(w.ngram_min, min(w.ngram_max, n) + 1):
            gram = tuple(ids[n - size :])
            if gram in self.prompt_grams:
                continue
            mean = sum(logprobs[n - size :]) / size
            old = seen.get(gram)
            if old is None:
                self.grams.append((n - size, n, gram, False, 0.0))
                seen[gram] = 1, mean
            else:
                self.grams.append((n - size, n, gram, True, max(0.0, mean - old[1] / old[0])))
                seen[gram] = old[0] + 1, old[1] + mean

    def within(self, low: int) -> list[tuple[int, int, tuple[int, ...], bool, float]]:
        """The n-grams that start at low or after, in order; they are in order of their ends, so older ones aren't looked at."""
        out = []
        for g in reversed(self.grams):
            if g[1] <= low:
                break
            if g[0] >= low:
                out.append(g)
        return out[::-1]

    def features(self, low: int) -> dict[str, Any]:
        w = self.config.window
        high = low + w.size
        inside, repeated, loop = 0, 0, 0.0
        for g in reversed(self.grams):  # in order of their ends
            if g[1] <= low:
                break
            if g[0] >= low and g[1] <= high:
                inside += 1
                if g[3]:
                    repeated += 1
                    loop = max(loop, g[4])
        mean = sum(self.entropies[low:high]) / w.size
        prefix = self.entropy[high] / high
        ratio = math.log((mean + EPS) / (prefix + EPS))
        out = {
            "window_index": len(self.windows),
            "start_pos": low,
            "end_pos": high,
            "mean_entropy": mean,
            "mean_logprob": sum(self.logprobs[low:high]) / w.size,
            "repetition_rate": repeated / inside if inside else 0.0,
            "confident_loop": loop,
            "local_pos": max(0.0, ratio),
            "local_neg": max(0.0, -ratio),
        }
        s = self.config.score
        out["score"] = round(s.entropy * mean - s.logprob * out["mean_logprob"] + s.repetition * out["repetition_rate"] + s.confident_loop * out["confident_loop"] + s.local_pos * out["local_pos"] + s.local_neg * out["local_neg"], 9)
        return out

    def faulty(self, low: int, high: int) -> list[tuple[int, ...]]:
        found = sorted((g for g in self.within(low) if g[3] and g[1] <= high), key=lambda g: -g[4])
        return list(dict.fromkeys(g[2] for g in found))[: self.config.backtrack.top_ngrams]

    def push(self, token: Token, backtrack: bool = True) -> list[dict[str, Any]]:
        """What a sampled token brings about: window, alarm and backtrack events, in order. After an alarm the
        windows that remain wait for the next token."""
        self.sampled += 1
        self._add(token)
        w, out = self.config.window, []
        while self.next_start + w.size <= len(self.tokens):
            f = self.features(self.next_start)
            self.windows.append(f)
            self.next_start += w.stride
            p = self.calibrator.p_value(f["score"], f["end_pos"])
            _, log_e, alarm, rest = self.detector.update(p)
            self.indices.append(f["window_index"])
            forced = None
            if self.schedule is not None:
                if self.events < len(self.schedule) and f["end_pos"] >= self.schedule[self.events][0]:
                    forced = self.schedule[self.events]
                    self.events += 1
                alarm = forced is not None
            out.append({"type": "window", **f, "p_value": p, "logE": log_e, "alarm": alarm, "refractory": rest})
            if not alarm:
                continue
            n = len(self.prompt)
            if forced is None:
                cp = self.indices[self.detector.changepoint()]
                start = next(x["start_pos"] for x in self.windows if x["window_index"] == cp)
                rollback = max(n, n + start - self.config.backtrack.margin)
            else:
                cp, rollback = f["window_index"], max(n, n + f["end_pos"] - max(1, forced[1]))
            out.append({"type": "alarm", "window_index": f["window_index"], "token_pos": n + f["end_pos"], "changepoint": cp, "rollback_pos": rollback, "logE": log_e})
            if backtrack:
                out += self.backtrack(n + f["end_pos"], rollback)
            break
        return out

    def backtrack(self, token_pos: int, rollback: int) -> list[dict[str, Any]]:
        """Truncates the run at the rollback position, unless its rerolls are used up."""
        b, n = self.config.backtrack, len(self.prompt)
        if self.rerolls >= b.max_rerolls:
            return [{"type": "refused", "reason": "max_rerolls_exhausted"}]
        if b.fixed_rollback is not None:
            rollback = token_pos - b.fixed_rollback
        cut = max(0, min(max(n, rollback), n + len(self.tokens)) - n)
        banned = self.faulty(cut, max(0, token_pos - n))
        span = len(self.tokens) - cut
        stale = [w["window_index"] for w in self.windows if w["end_pos"] > cut]
        self.truncate(cut)
        self.detector.reset()
        self.detector.rest()
        self.indices = []
        self.rerolls += 1
        self.deleted += span
        if self.inject:  # the kept tokens and the injected ones are the prompt from now on
            self.prompt = (*self.prompt, *(t[0] for t in self.tokens), *self.inject)
            self.tokens, self.windows, self.next_start = [], [], 0
            self._rebuild()
        self.overrides |= {"temperature": b.temperature, "repetition_penalty": b.repetition_penalty} | ({"banned": banned} if b.ban_ngrams else {})
        return [{"type": "backtrack", "rollback_pos": n + cut, "span": span, "stale": stale, "banned": banned, "reroll": self.rerolls}]

    def truncate(self, cut: int) -> None:
        w = self.config.window
        self.tokens = self.tokens[:cut]
        self._rebuild()
        self.windows = [x for x in self.windows if x["end_pos"] <= cut]
        self.next_start = 0 if len(self.tokens) < w.size else len(self.windows) * w.stride


TokenSource = Callable[[Any, list[Token], Mapping[str, Any], int], Token | None]


def looping_source(vocabulary: int = 50, loop_from: int = 40, period: int = 7, length: int = 200) -> TokenSource:
    """A seeded synthetic model that falls into a loop until it was rolled back once; None ends a run."""

    def draw(run: Any, tokens: list[Token], overrides: Mapping[str, Any], rerolls: int) -> Token | None:
        pos = len(tokens)
        if pos >= length:
            return None
        h = int.from_bytes(hashlib.blake2b(f"{run}:{pos}:{rerolls}".encode(), digest_size=8).digest(), "big")
        if pos >= loop_from and not overrides:
            return pos % period, -0.01, 0.05
        return h % vocabulary, -1.0 - (h >> 32) % 100 / 100, 1.0 + (h >> 40) % 100 / 100

    return draw


def generate_run(run: Any, source: TokenSource, monitor: Monitor, max_new_tokens: int, backtrack: bool = True, emit_on_end: bool = False) -> tuple[list[dict[str, Any]], str]:
    """Events of one run and why it ended; the budget counts sampled tokens, those deleted later too."""
    out: list[dict[str, Any]] = []
    for _ in range(max_new_tokens):
        token = source(run, monitor.tokens, monitor.overrides, monitor.rerolls)
        if token is None:
            return out, "eos"
        out += monitor.push(token, backtrack)
    return out, "max_new_tokens"


def plain_run(run: Any, source: TokenSource, max_new_tokens: int, temperature: float | None = None, repetition_penalty: float | None = None) -> tuple[list[Token], str]:
    """The loop without a monitor: all tokens of a run and why it ended. A temperature or penalty holds from the first token on."""
    given = {"temperature": temperature, "repetition_penalty": repetition_penalty}
    overrides = {k: v for k, v in given.items() if v is not None}
    tokens: list[Token] = []
    for _ in range(max_new_tokens):
        token = source(run, tokens, overrides, 0)
        if token is None:
            return tokens, "eos"
        tokens.append(token)
    return tokens, "max_new_tokens"


def scheduled_run(run: Any, source: TokenSource, schedule: list[tuple[int, int]], max_new_tokens: int) -> tuple[list[Token], list[tuple[int, int]], int]:
    """The baseline without a detector: at each trigger (tokens kept, tokens to drop) the tail is dropped and drawn
    again, at most one trigger a token. Returns the tokens, the (position, span) of the rollbacks and the tokens sampled."""
    tokens: list[Token] = []
    done: list[tuple[int, int]] = []
    events, sampled = sorted(schedule), 0
    for _ in range(max_new_tokens):
        token = source(run, tokens, {"scheduled": len(done)} if done else {}, len(done))
        if token is None:
            break
        sampled += 1
        tokens.append(token)
        if len(done) < len(events) and len(tokens) >= events[len(done)][0]:
            cut = max(0, len(tokens) - max(1, events[len(done)][1]))
            done.append((cut, len(tokens) - cut))
            tokens = tokens[:cut]
    return tokens, done, sampled


SUMMARY = "run_id string, sampled long, emitted long, deleted long, windows long, alarms long, rerolls long, termination_reason string, tokens array<int>"


def generate(runs: DataFrame, source: TokenSource, config: Config, pools: Mapping[str, list[float]], max_new_tokens: int = 400, backtrack: bool = True) -> DataFrame:
    """A row of accounts for each run_id, with tokens drawn from a source in the executors.

    Ids are few bytes and much work, so they are dealt to all cores whatever the table's splits are.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calibrator = Calibrator(pools, clip=config.detector.p_clip)
        for frame in frames:
            rows = []
            for run_id in frame["run_id"]:
                m = Monitor(config, calibrator)
                events, reason = generate_run(run_id, source, m, max_new_tokens, backtrack)
                count = lambda kind, events=events: sum(e["type"] == kind for e in events)
                rows.append((str(run_id), m.sampled, len(m.tokens), m.deleted, count("window"), count("alarm"), m.rerolls, reason, [t[0] for t in m.tokens]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    dealt = runs.select("run_id").repartition(4 * runs.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, SUMMARY)


EVENTS = "run_id string, window_index long, end_pos long, score double, p_value double, logE double, alarm boolean, changepoint long, rollback_pos long"


def _rows(run_id: str, events: list[dict[str, Any]]) -> list[tuple]:
    out, i = [], 0
    while i < len(events):
        e = events[i]
        after = events[i + 1] if i + 1 < len(events) else {}
        alarm = after if after.get("type") == "alarm" else {}
        if e["type"] == "window":
            out.append((run_id, e["window_index"], e["end_pos"], e["score"], e["p_value"], e["logE"], e["alarm"], alarm.get("changepoint"), alarm.get("rollback_pos")))
        i += 1
    return out


def monitor_stream(tokens: DataFrame, config: Config, pools: Mapping[str, list[float]]) -> DataFrame:
    """Window rows of a stream of tokens (run_id string, pos, token, logprob, entropy), one state a run.

    Tokens of a micro-batch are sorted by position; a position that was seen is skipped (a replayed source),
    one beyond the next is an error. Alarms don't roll back tokens that another system sampled. The state
    holds the run's tokens, so a restart goes on from the checkpoint.
    """
    calibrator = Calibrator(pools, clip=config.detector.p_clip)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Monitor(config, calibrator)
        if state.exists:
            ids, lps, hs, log_e, history, start, count = state.get
            m.tokens = list(zip(ids, lps, hs, strict=True))
            m._rebuild()
            m.detector.logE, m.detector.history = log_e, list(history)
            m.indices, m.next_start = list(range(count)), start
            m.windows = [{"window_index": i, "start_pos": i * config.window.stride, "end_pos": i * config.window.stride + config.window.size} for i in range(count)]
        events: list[dict[str, Any]] = []
        for _, row in pd.concat(list(frames)).sort_values("pos").iterrows():
            if row["pos"] < len(m.tokens):
                continue
            if row["pos"] > len(m.tokens):
                raise ValueError(f"run {key[0]} lacks position {len(m.tokens)}")
            events += m.push((int(row["token"]), float(row["logprob"]), float(row["entropy"])), backtrack=False)
        state.update(([t[0] for t in m.tokens], [t[1] for t in m.tokens], [t[2] for t in m.tokens], m.detector.logE, m.detector.history, m.next_start, len(m.windows)))
        yield pd.DataFrame(_rows(key[0], events), columns=[c.split()[0] for c in EVENTS.split(", ")])

    kept = "ids array<int>, lps array<double>, hs array<double>, logE double, history array<double>, start long, count long"
    return tokens.groupBy("run_id").applyInPandasWithState(run, EVENTS, kept, "append", GroupStateTimeout.NoTimeout)


def monitor_batch(tokens: DataFrame, config: Config, pools: Mapping[str, list[float]]) -> DataFrame:
    """The same rows for a table of tokens."""
    calibrator = Calibrator(pools, clip=config.detector.p_clip)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m, events = Monitor(config, calibrator), []
        for row in frame.sort_values("pos").itertuples():
            events += m.push((int(row.token), float(row.logprob), float(row.entropy)), backtrack=False)
        return pd.DataFrame(_rows(str(frame["run_id"].iloc[0]), events), columns=[c.split()[0] for c in EVENTS.split(", ")])

    return tokens.withColumn("run_id", F.col("run_id").cast("string")).groupBy("run_id").applyInPandas(run, EVENTS)
