"""Token counts by finite-state transducers whose chunk maps compose by a prefix scan."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, text_of
from .pretoken import BLANK, LETTER, QUOTE, SPECIAL, SYMBOL, VOCABULARY, WHITE, path, pieces, table

LIMIT = 512
#: Code points of a chunk, and those before it that tell in which state it is entered, mostly.
CHUNK, WARM_UP = 4096, 64
#: Transitions and pre-tokens' counts that a worker keeps; it starts anew beyond.
STEPS, WORDS = 800_000, 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary's file: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """A deterministic transducer over the bytes of a pre-token that emits token counts.

    After each prefix of a pre-token, the encoding of the prefix ends with exactly one token: that
    which ends here, begins where some earlier prefix's encoding ended, and doesn't merge across that
    border. So what follows depends only on the places that a token of the vocabulary may still start
    from: for each its node in the vocabulary's trie, the last token before it and how many tokens
    lie between it and here. Tuples of these are the states; a transition carries the change of the
    number of tokens. States are compiled when first reached.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        with open(path(f"{vocabulary}.json"), encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        self._ranks: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self._ranks[a, b] = i
        self._tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in self._ranks]
        # The trie: child[node << 8 | byte], and the token that ends at a node.
        self._child: dict[int, int] = {}
        self._ends: list[int] = [-1]
        self._inner: set[int] = set()
        for number, token in enumerate(self._tokens):
            node = 0
            for b in token:
                self._inner.add(node)
                if (key := node << 8 | b) not in self._child:
                    self._child[key] = len(self._ends)
                    self._ends.append(-1)
                node = self._child[key]
            self._ends[node] = number
        self._words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple[int, ...]] = [(self._place(0, -1, 0),)]
        self._number: dict[tuple[int, ...], int] = {self._states[0]: 0}
        self._steps: dict[int, int] = {}
        self._apart: dict[int, bool] = {}

    @staticmethod
    def _place(node: int, last: int, since: int) -> int:
        """A place in a state as one number: trie node, last token before it (-1: none), tokens since."""
        return node << 40 | (last + 1) << 16 | since + 0x8000

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The merges of the vocabulary by rank, lowest first."""
        ranks = self._ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: none): the bytes of both encode as just these two."""
        key = (a + 1) << 32 | b
        if key not in self._apart:
            pair = [self._tokens[a], self._tokens[b]] if a >= 0 else [self._tokens[b]]
            self._apart[key] = self.merged([bytes([x]) for x in b"".join(pair)]) == pair
        return self._apart[key]

    def step(self, state: int, byte: int) -> int:
        """The transition from a state by a byte: the next state * 64 + 32 + the change of the number of tokens."""
        key = state << 8 | byte
        live, token, emitted = [], -1, 0
        for place in self._states[state]:
            node = self._child.get(place >> 40 << 8 | byte)
            if node is None:
                continue
            last, since = (place >> 16 & 0xFFFFFF) - 1, (place & 0xFFFF) - 0x8000
            live.append((node, last, since))
            if token < 0 and self._ends[node] >= 0 and self.apart(last, self._ends[node]):
                token, emitted = self._ends[node], 1 - since
        after = tuple(self._place(n, last, since + emitted) for n, last, since in live if n in self._inner) + (self._place(0, token, 0),)
        if after not in self._number:
            self._number[after] = len(self._states)
            self._states.append(after)
        if not -32 <= emitted < 32:
            raise OverflowError("a byte changes the number of tokens by more than a transition can carry")
        self._steps[key] = self._number[after] << 6 | emitted + 32
        return self._steps[key]

    def feed(self, state: int, text: str) -> tuple[int, int]:
        """The state after the bytes of a text, and the change of the number of tokens."""
        total, steps = 0, self._steps
        for byte in text.encode("utf-8"):
            found = steps.get(state << 8 | byte) or self.step(state, byte)
            state = found >> 6
            total += (found & 63) - 32
        return state, total

    def renew(self) -> None:
        """Forgets transitions and pre-tokens if there are too many; states from before are void then."""
        if len(self._steps) > STEPS:
            self._reset()
        if len(self._words) > WORDS:
            self._words.clear()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        words, counts = pieces(texts)
        known = self._words
        for word in set(words):
            if word not in known:
                known[word] = self.feed(0, word)[1]
        each = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), out=each[1:])
        ends = np.cumsum([0, *counts])
        return np.diff(each[ends]).tolist()


#: A state of the whole machine: what goes on (a class of code points, or one of the modes below), the
#: transducer's state, and a code point that is held back.
State = tuple[int, int, str]
#: Modes beside the classes LETTER, NUMBER and SYMBOL of a run that goes on: nothing yet, white space (the last
#: of which is held back), a quote that begins a pre-token, and such a quote with one letter held back.
FRESH, SPACES, QUOTED, HALF = 10, 11, 12, 13
START: State = (FRESH, 0, "")
#: The ends of contractions.
SHORT, LONG = frozenset("sdmt"), {"r": "e", "v": "e", "l": "l"}


def advance(machine: Transducer, state: State, char: str, kind: int) -> tuple[State, int]:
    """One transition of the whole machine (pre-tokenizer and transducer): the next state and the number of tokens emitted.

    Where only the next code points tell whether one belongs to the pre-token, it is held back, so
    the machine reads each code point once.
    """
    mode, inner, held = state
    white = kind in (BLANK, WHITE)
    sign = kind in (SYMBOL, QUOTE)
    before = 0
    if mode == HALF:
        if LONG[held] == char:
            return START, machine.feed(inner, held + char)[1]
        mode, (inner, before) = LETTER, machine.feed(0, held)
    elif mode == QUOTED:
        if char in SHORT:
            return START, machine.feed(inner, char)[1]
        if char in LONG:
            return (HALF, inner, char), 0
        mode = SYMBOL
    elif mode == SPACES:
        if white:
            inner, n = machine.feed(inner, held)
            return (SPACES, inner, char), n
        inner, before = machine.feed(0, held)
        mode = kind if held == " " and not sign else SYMBOL if held == " " else FRESH
        if mode != FRESH:
            inner, n = machine.feed(inner, char)
            return (mode, inner, ""), before + n
    if white:
        return (SPACES, 0, char), before
    if mode == kind or (mode == SYMBOL and sign):
        inner, n = machine.feed(inner, char)
        return (mode, inner, ""), before + n
    inner, n = machine.feed(0, char)
    return (QUOTED if kind == QUOTE else kind, inner, ""), before + n


def final(machine: Transducer, state: State) -> int:
    """The number of tokens that the end of the text adds: those of what is held back."""
    mode, inner, held = state
    return machine.feed(inner if mode == SPACES else 0, held)[1]


class ChunkMap:
    """The state map of a chunk: for each state in which it is entered, the state in which it is left and the tokens emitted.

    Where white space follows another code point the machine's state doesn't depend on what came before. So the
    map is constant but for the chunk's head, up to the first such place; from there on the
    tokens of whole pre-tokens are summed up, and only what follows the last such place is walked to
    the state at the end. A chunk without such a place is walked once from the state `expected`, and from any other
    state only until the walk meets that path. Entries are tabulated as they are asked for.
    """

    def __init__(self, machine: Transducer, head: str, expected: State, rest: tuple[State, int] | None) -> None:
        self._machine, self._head, self.expected, self._rest = machine, head, expected, rest
        self._kinds = table()[np.frombuffer(head.encode("utf-32-le"), np.uint32)].tolist()
        self._path: list[tuple[State, int]] = []
        self._known: dict[State, tuple[State, int]] = {}

    def at(self, entry: State) -> tuple[State, int]:
        if entry not in self._known:
            self._known[entry] = self._walk(entry)
        return self._known[entry]

    def _walk(self, entry: State) -> tuple[State, int]:
        state, total = entry, 0
        keep = self._rest is None and not self._path
        path: list[tuple[State, int]] = []
        for i, (char, kind) in enumerate(zip(self._head, self._kinds, strict=True)):
            state, n = advance(self._machine, state, char, kind)
            total += n
            if keep:
                path.append((state, total))
            elif self._path and self._path[i][0] == state:  # from here on as on the known path
                return self._path[-1][0], total + self._path[-1][1] - self._path[i][1]
        if keep:
            self._path = path
        return (self._rest[0], total + self._rest[1]) if self._rest else (state, total)


class Composed(ChunkMap):
    """The map of two adjacent chunks, or of two such maps: composition is associative."""

    def __init__(self, first: ChunkMap, second: ChunkMap) -> None:
        self._first, self._second, self.expected = first, second, first.expected
        self._known = {}
        self.at(self.expected)

    def _walk(self, entry: State) -> tuple[State, int]:
        middle, n = self._first.at(entry)
        end, m = self._second.at(middle)
        return end, n + m


def chunk_maps(chunks: list[tuple[str, str | None, bool]], machine: Transducer) -> list[ChunkMap]:
    """The maps of chunks (text, what is before it in its text, None for the first one, and whether it is the last one).

    The state in which a chunk is expected to be entered is found by a walk over the end of what is before
    it; a wrong one costs a second walk and not the result. The last chunk's map counts to the end of the text and has no state.
    """
    kind = table()[np.frombuffer("".join(c for c, _, _ in chunks).encode("utf-32-le"), np.uint32)]
    white = (kind == BLANK) | (kind == WHITE)
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    ends = np.cumsum([len(c) for c, _, _ in chunks])
    starts = ends - [len(c) for c, _, _ in chunks]
    low, high = np.searchsorted(at, starts, "right"), np.searchsorted(at, ends, "left")
    cuts = []  # the end of the head, and the start of the tail, of each chunk
    for (text, before, last), s, a, b in zip(chunks, starts.tolist(), low, high, strict=True):
        first, final_cut = (int(at[a] - s), int(at[b - 1] - s)) if a < b else (len(text), len(text))
        cuts.append((0 if before is None else first, len(text) if last else final_cut if a < b else 0 if before is None else len(text)))
    inner = machine.count([text[a:b] if a < b else "" for (text, _, _), (a, b) in zip(chunks, cuts, strict=True)])
    out = []
    for (text, before, last), (a, b), n in zip(chunks, cuts, inner, strict=True):
        if a >= len(text) and before is not None:
            out.append(ChunkMap(machine, text, expected(machine, before), None))
            continue
        state, more = walk(machine, START, text[b:]) if not last else (START, 0)
        # The head is left by a step into white space, which ends whatever goes on; it emits no token itself.
        out.append(ChunkMap(machine, text[: a + 1] if before is not None else "", expected(machine, before), (state, n + more)))
    return out


def walk(machine: Transducer, state: State, text: str) -> tuple[State, int]:
    total = 0
    for char, kind in zip(text, table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist(), strict=True):
        state, n = advance(machine, state, char, kind)
        total += n
    return state, total


def expected(machine: Transducer, before: str | None) -> State:
    """The state after a text by its last code points, from the last place among them at which states don't depend on what came before."""
    if before is None:
        return START
    end = before[-WARM_UP:]
    kinds = table()[np.frombuffer(end.encode("utf-32-le"), np.uint32)]
    white = (kinds == BLANK) | (kinds == WHITE)
    places = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return walk(machine, START, end[int(places[-1]) :] if len(places) else end)[0]


def counts_by_chunks(texts: list[str], machine: Transducer, chunk: int = CHUNK) -> list[int]:
    """Tokens of each text from its chunks' maps, composed pairwise in rounds (the scan's up-sweep).

    A round composes all pairs of all texts, so the number of rounds is the logarithm of the number
    of chunks of the longest text. Only the whole text's map, its scan's last entry, is needed.
    """
    machine.renew()
    cuts = [list(range(0, len(text), chunk)) or [0] for text in texts]
    flat = [(text[i : i + chunk], text[max(0, i - WARM_UP) : i] if i else None, i == own[-1]) for text, own in zip(texts, cuts, strict=True) for i in own]
    found = iter(chunk_maps(flat, machine))
    maps = [[next(found) for _ in own] for own in cuts]
    while any(len(own) > 1 for own in maps):
        maps = [[*(Composed(own[i], own[i + 1]) for i in range(0, len(own) - 1, 2)), *own[len(own) // 2 * 2 :]] for own in maps]
    out = []
    for (whole,) in maps:
        state, n = whole.at(START)
        out.append(n + final(machine, state))
    return out


_machines: dict[str, Transducer] = {}


def machine_of(vocabulary: str = VOCABULARY) -> Transducer:
    if vocabulary not in _machines:
        _machines[vocabulary] = Transducer(vocabulary)
    return _machines[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text, a null text as an empty one.

    The special string in a text is one token, as in the vocabulary's library; its places cut a text
    into parts that are counted on their own. Equal rows give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(vocabulary)
        for batch in (part for whole in batches for part in by_size(whole, 1)):
            texts = batch.column(1).to_pylist()
            parts = [t.split(SPECIAL) for t in texts]
            flat = iter(counts_by_chunks([p for own in parts for p in own], machine))
            n = [sum(next(flat) for _ in own) + len(own) - 1 for own in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
