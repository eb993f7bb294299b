"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Emissions see features of the line and of the lines before and after it,
transitions see the labels of two adjacent lines. Marginals of forward-backward, weighted by the
lines' lengths, add up to a document's share of good text, which a logistic curve maps to its score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, text_of

#: At most so many labelled documents, of at most so many characters together, fit the model.
FIT_ROWS, FIT_CHARS = 4000, 8_000_000
THRESHOLD = 0.7
#: Lines that are padded into one block of chains, at most (a longer chain is a block of its own).
BLOCK_LINES = 1 << 16
UPPER, LOWER, DIGIT, STOP, PUNCT, BAR, SYMBOL, SPACE, OTHER = range(9)
N_OWN = 17
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point below 0x3000 (all above count as other letters)."""
    global _classes
    if _classes is None:
        table = np.full(0x3000, OTHER, np.uint8)
        for code in range(0x3000):
            kind = unicodedata.category(chr(code))
            if kind in ("Lu", "Lt"):
                table[code] = UPPER
            elif kind == "Ll":
                table[code] = LOWER
            elif kind[0] == "N":
                table[code] = DIGIT
            elif kind[0] in "ZC":
                table[code] = SPACE
            elif kind[0] in "PS":
                table[code] = SYMBOL
        for text, value in (("\t\n\r\v\f", SPACE), (".?!", STOP), (",;:'\"()-’“”«»¿¡", PUNCT), ("|", BAR)):
            table[[ord(c) for c in text]] = value
        _classes = table
    return _classes


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_OWN) and lengths of all lines of the texts that aren't blank, and the text of each."""
    lines, owner = [], []
    for k, text in enumerate(texts):
        own = [x for x in text.split("\n") if x and not x.isspace()]
        lines += own
        owner += [k] * len(own)
    if not lines:
        return np.zeros((0, N_OWN)), np.zeros(0), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 0x3000, classes()[np.minimum(codes, 0x2FFF)], OTHER)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), starts)

    n = {k: count(kinds == k) for k in range(9)}
    n[SPACE] = n[SPACE] - (np.arange(len(lines)) < len(lines) - 1)  # the joining line ends
    spaced = kinds == SPACE
    before_space = np.r_[spaced[1:], True]
    odd_end = count(((kinds == SYMBOL) | (kinds == BAR)) & before_space)
    stop_end = count(((kinds == STOP) | (kinds == PUNCT)) & before_space)
    double_stop = count((kinds == STOP) & np.r_[False, kinds[:-1] == STOP])
    repeats, unique, words, longest = np.zeros((4, len(lines)))
    for i, line in enumerate(lines):
        own = line.split()
        words[i], unique[i] = len(own), len(set(own))
        repeats[i] = sum(map(eq, own, own[1:]))
        longest[i] = max(map(len, own), default=0)
    words = np.maximum(words, 1)
    letters = np.maximum(n[UPPER] + n[LOWER] + n[OTHER], 1)
    rates = [n[UPPER] / letters, n[DIGIT] / lengths, n[STOP] / lengths, n[PUNCT] / lengths, n[BAR] / words, n[SYMBOL] / lengths, n[SPACE] / lengths, odd_end / words, stop_end / words, double_stop / words]
    shape = [repeats / words, unique / words, np.log1p(words) / 5, np.minimum(longest, 40) / 20, lengths / words / 10]
    ends = np.isin(kinds[starts + lengths - 1], (STOP,)).astype(float)
    begins = (kinds[starts] == UPPER).astype(float)
    return np.column_stack([*rates, *shape, ends, begins]), lengths.astype(float), np.array(owner, np.int64)


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after it in its text (zero beyond the ends), and a bias."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        same = (owner[1:] == owner[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    first = np.r_[True, owner[1:] != owner[:-1]][:n] if n else np.zeros(0, bool)
    last = np.r_[owner[1:] != owner[:-1], True][:n] if n else np.zeros(0, bool)
    return np.column_stack([own, np.minimum(own, 0.3) * 3, before, after, first, last, np.ones(n)])


def chains(owner: np.ndarray) -> list[np.ndarray]:
    """Blocks of padded chains: index[chain, step] of the lines of each text, -1 beyond its end."""
    if not len(owner):
        return []
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[start, len(owner)])
    order = np.argsort(-size, kind="stable")
    blocks, at = [], 0
    while at < len(order):
        width = int(size[order[at]])
        rows = order[at : at + max(1, BLOCK_LINES // width)]
        step = np.arange(width)[None, :]
        blocks.append(np.where(step < size[rows][:, None], start[rows][:, None] + step, -1))
        at += len(rows)
    return blocks


def forward_backward(emit: np.ndarray, trans: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals P(good) (chain, step), expected transitions (2, 2) and the log of the partition functions' product.

    emit is the emission score of good (bad has 0) of each line, trans the transitions' scores.
    """
    live = index >= 0
    n, width = index.shape
    score = np.where(live, emit[np.maximum(index, 0)], 0.0)
    shift = np.maximum(score, 0)
    e = np.exp(np.stack([-shift, score - shift], axis=2))
    m = np.exp(trans)
    alpha, scale = np.empty((n, width, 2)), np.ones((n, width))
    state = e[:, 0]
    for t in range(width):
        if t:
            state = np.where(live[:, t, None], (state @ m) * e[:, t], state)
        scale[:, t] = np.where(live[:, t], state.sum(1), 1.0)
        state = state / state.sum(1, keepdims=True)
        alpha[:, t] = state
    beta, back = np.ones((n, width, 2)), np.ones((n, 2))
    pair = np.zeros((2, 2))
    for t in range(width - 1, 0, -1):
        on = live[:, t]
        right = e[on, t] * back[on]
        joint = alpha[on, t - 1][:, :, None] * m[None] * right[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        new = right @ m.T
        back[on] = new / new.sum(1, keepdims=True)
        beta[:, t - 1] = back
    both = alpha * beta
    return both[:, :, 1] / both.sum(2), pair, float(np.log(scale)[live].sum() + shift[live].sum())


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    trans: np.ndarray
    slope: float
    bias: float
    prior: float

    def marginals(self, own: np.ndarray, owner: np.ndarray) -> np.ndarray:
        emit = ((with_neighbours(own, owner) - self.mean) / self.scale) @ self.weights
        out = np.zeros(len(own))
        for index in chains(owner):
            good, _, _ = forward_backward(emit, self.trans, index)
            out[index[index >= 0]] = good[index >= 0]
        return out

    def shares(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good; a text without lines has the prior."""
        own, lengths, owner = lines_of(texts)
        weight = np.bincount(owner, lengths, len(texts))
        good = np.bincount(owner, lengths * self.marginals(own, owner), len(texts))
        return np.where(weight > 0, good / np.maximum(weight, 1), self.prior)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.slope == 0:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.shares(texts) + self.bias, -30, 30)))


def ascend(gradient, n: int, steps: int, rate: float) -> np.ndarray:
    """Adam ascent from zero."""
    x, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(texts: list[str], labels: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Model:
    """Fits the field to documents' labels.

    Documents are labelled, lines are not: lines of good documents are good; of a bad document those
    lines are bad that a logistic model, fitted with the documents' labels, finds likelier bad (the
    likeliest one at least). The field is fitted to these by its exact gradient, the score's curve to
    the documents' labels. Without labels of both kinds all scores are the share of label 1 (0.5 if none).
    """
    prior = float(np.mean(labels)) if len(labels) else 0.5
    own, lengths, owner = lines_of(texts)
    x = with_neighbours(own, owner)
    width = with_neighbours(np.zeros((1, N_OWN)), np.zeros(1, np.int64)).shape[1]
    if not len(own) or prior in (0.0, 1.0):
        return Model(np.zeros(width), np.zeros(width), np.ones(width), np.zeros((2, 2)), 0.0, 0.0, prior)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    inherited = labels[owner].astype(float)
    weight = np.where(inherited == 1, 0.5 / max(1, (inherited == 1).sum()), 0.5 / max(1, (inherited == 0).sum()))

    def logistic(w: np.ndarray) -> np.ndarray:
        return x.T @ (weight * (inherited - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - ridge * w

    z = x @ ascend(logistic, width, steps, 0.1)
    worst = np.full(len(texts), np.inf)
    np.minimum.at(worst, owner, z)
    y = np.where(inherited == 1, 1, ((z > 0) & (z > worst[owner])).astype(int))
    blocks = chains(owner)
    gold = np.zeros((2, 2))
    inside = owner[1:] == owner[:-1]
    np.add.at(gold, (y[:-1][inside], y[1:][inside]), 1)

    def field(p: np.ndarray) -> np.ndarray:
        w, trans = p[:width], p[width:].reshape(2, 2)
        emit, good, pair = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for index in blocks:
            g, joint, _ = forward_backward(emit, trans, index)
            good[index[index >= 0]] = g[index >= 0]
            pair += joint
        return np.r_[x.T @ (y - good), (gold - pair).ravel()] / len(x) - ridge * p

    p = ascend(field, width + 4, steps, 0.1)
    model = Model(p[:width], mean, scale, p[width:].reshape(2, 2), 1.0, 0.0, prior)
    share = model.shares(texts)
    s = np.column_stack([share - 0.5, np.ones(len(share))])

    def curve(w: np.ndarray) -> np.ndarray:
        return s.T @ (labels - 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))) / len(s) - 1e-4 * w

    slope, bias = ascend(curve, 2, 600, 0.2)
    model.slope, model.bias = max(float(slope), 1e-6), float(bias - 0.5 * slope)
    return model


def held_out(id: str = "doc_id"):
    """Whether crc32 of the id as text has remainder 2 by 4 (a null id: it hasn't)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """A model fitted on at most `rows` labelled documents that aren't held out, of at most `chars` characters together.

    The labels with the smallest hashes of their ids are taken, so a rerun takes the same ones, and only
    they are broadcast (rows is their bound): no text is shuffled. In the order of these hashes, documents are taken as long as
    their characters stay within `chars`; one that alone is too long for what is left is passed over, and of a document
    whose id comes twice all rows count. Labels that are null or whose document is missing aren't used.
    """
    known = labels.where(~held_out() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), "quality")
    chosen = known.orderBy(F.xxhash64("__id"), "quality").limit(rows)
    own = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.coalesce(F.length("text"), F.lit(0)).alias("__n"), text_of("text").alias("text"))
    joined = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    sizes = joined.select("doc_id", "__h", "quality", "__n").orderBy(F.xxhash64("doc_id"), "__h", "quality").limit(rows).collect()
    left, ids = chars, set()
    for r in sizes:
        if r["__n"] <= left:
            left -= r["__n"]
            ids.add((r["doc_id"], r["__h"], r["quality"]))
    if not ids:
        return fit([], np.zeros(0))
    taken = docs.sparkSession.createDataFrame(sorted(ids), "__id long, __t long, quality int")
    texts = own.join(F.broadcast(taken), (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__t")))
    sample = texts.select("doc_id", "__h", "text", "quality").dropDuplicates(["doc_id", "__h", "quality"]).toPandas()
    sample = sample.sort_values(["doc_id", "__h", "quality"])
    return fit(sample["text"].tolist(), (sample["quality"].to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score is THRESHOLD or more) from the whole text alone.

    A null text counts as empty; texts without a line of other than white space get the prior's score.
    """
    name = "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_size(whole, whole.schema.get_field_index(name))):
            found = model.scores([t or "" for t in batch.column(name).to_pylist()])
            columns = [batch.column(c) for c in batch.schema.names if c != name]
            names = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    clash = [c for c in docs.columns if c in ("score", "predicted")]
    base = docs.drop(*clash)
    out = base.limit(0).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return base.withColumn(name, text_of("text")).mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose documents are predicted good, with the columns of docs.

    A null or empty text has the prior's score, the share of good documents in the fit, and stays or
    goes by that; equal rows stay or go together; an empty table gives none.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_size(whole, whole.schema.get_field_index("text"))):
            found = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(found >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
