"""Functions that need Python for exact parity, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import unicodedata
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def normalize_text(text: str | None) -> str | None:
    """NFKC, one space for each run of white space, ends trimmed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(normalize_text, na_action="ignore")


def stable_seed(*parts: Any) -> int:
    """31-bit seed of the parts, joined by two colons, by an 8-byte BLAKE2b hash."""
    raw = hashlib.blake2b("::".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") % 2**31


def stable_seed_udf(*before: Any):
    """A column function: the seed of fixed parts and one of a column."""

    @F.pandas_udf(LongType())
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda v: stable_seed(*before, v)).astype("int64")

    return run


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_sha(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_json_sha(rows: pd.DataFrame) -> pd.Series:
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return pd.Series([canonical_sha({k: plain(v) for k, v in r.items()}) for r in rows.to_dict("records")])


#: The marker and the phrases that announce an answer, in order, and the pairs that enclose one.
MARKER, PHRASES = "####", ("final answer is", "answer is", "therefore")
ENCLOSED = (("$$", "$$"), ("$", "$"), (r"\(", r"\)"), (r"\[", r"\]"))
#: The LaTeX that a normal form knows; a command is known by how it begins.
LATEX = re.compile(
    r"(?P<none>\\left|\\right|\\[!,;:])|(?P<frac>\\[dt]?frac)|(?P<sqrt>\\sqrt)|(?P<text>\\(?:text|mathrm))|(?P<open>\{)|(?P<close>\})"
    r"|(?P<space>\s+)|(?P<sign>.)",
    re.DOTALL,
)
BOX = re.compile(r"(?P<box>\\(?:boxed|fbox)\s*\{)|(?P<open>\{)|\}")


def boxed(text: str) -> str | None:
    """What the last box holds whose braces are balanced; None if that is nothing, or there is no box."""
    open_at: list[tuple[int, bool]] = []
    last = (-1, -1)
    for m in BOX.finditer(text):
        if m.lastgroup:
            open_at.append((m.end(), m.lastgroup == "box"))
        elif open_at:
            start, box = open_at.pop()
            if box:
                last = max(last, (start, m.start()))
    return text[last[0] : last[1]].strip() or None


def first_line(text: str) -> str | None:
    """The first line that isn't blank, without white space around it."""
    lines = text.strip().splitlines()
    return lines[0].rstrip() if lines else None


def math_answer_of(text: str | None) -> str | None:
    """After the last marker, else the last box, else after the last of the first phrase found, else the last line."""
    text = (text or "").strip()
    _, marked, answer = text.rpartition(MARKER)
    if not marked:
        if answer := boxed(text):
            return answer
        said = (re.split(phrase, text, flags=re.IGNORECASE) for phrase in PHRASES)
        answer = next((parts[-1] for parts in said if len(parts) > 1), text.splitlines()[-1] if text else "")
    return first_line(answer)


@dataclass
class Group:
    """A group of LaTeX: its parts, and the command and the groups before it that it may be an argument of.

    Groups are resolved in rounds of three turns: fractions, roots, and braces that are dropped. In a
    turn those groups take part that held no group before it. gone is the turn at which a group goes, and -1 is before all rounds.
    """

    parts: list[str | Group] = field(default_factory=list)
    command: str = ""
    fellow: Group | None = None
    gone: int | None = None

    def free(self) -> int:
        """The turn after which it holds no group."""
        return max((p.gone or 0 for p in self.parts if isinstance(p, Group) and p.gone != -1), default=-1)


FRACTIONS, ROOTS, BRACES = range(3)


def turn_after(turn: int, kind: int) -> int:
    """The first turn of a kind after a turn."""
    return turn + 1 + (kind - turn - 1) % 3


def resolve(group: Group) -> list[str]:
    """The group as text parts, with its inner groups resolved and their turns known (see Group)."""
    out: list[str] = []
    inner = [p for p in group.parts if isinstance(p, Group)]
    texts = {id(g): resolve(g) for g in inner}
    free = {id(g): g.free() for g in inner}
    for g in inner:
        full = any(texts[id(g)])
        if g.command == "text" and not any(isinstance(p, Group) for p in g.parts):
            g.gone = -1
        elif g.command == "sqrt" and full and turn_after(free[id(g)], ROOTS) < turn_after(free[id(g)], BRACES):
            g.gone = turn_after(free[id(g)], ROOTS)
        elif g.gone is None:
            g.gone = turn_after(free[id(g)], BRACES)
        if g.command == "frac" and g.fellow:
            both = turn_after(max(free[id(g)], free[id(g.fellow)]), FRACTIONS)
            drop = min(turn_after(free[id(x)], BRACES) for x in (g, g.fellow))
            if full and any(texts[id(g.fellow)]) and both < drop:
                g.gone = g.fellow.gone = both
    for p in group.parts:
        if not isinstance(p, Group):
            out.append(p)
            continue
        own = texts[id(p)]
        if p.command == "text" and p.gone == -1:
            out[-1:] = own
        elif p.command == "sqrt" and p.gone % 3 == ROOTS:
            out[-1:] = ["sqrt(", *own, ")"]
        elif p.command == "frac" and p.gone % 3 == FRACTIONS:
            out[-1:] = [*own, "/"]
        else:
            out += own
    return out


def parsed(text: str) -> Group:
    """The text as nested groups; a brace without its other one is a sign."""
    stack, opened = [Group()], []
    commands = {"frac": "\\frac", "sqrt": "\\sqrt"}
    command, after = "", None  # a command that waits for its argument, and a fraction's first argument
    for m in LATEX.finditer(text):
        kind = m.lastgroup
        if kind == "none" or (kind == "space" and (command or after)):
            continue  # neither parts a command from its argument
        if kind == "open":
            stack.append(Group(command=command))
            opened.append(after)
            command, after = "", None
        elif kind == "close" and len(stack) > 1:
            group, first = stack.pop(), opened.pop()
            stack[-1].parts.append(group)
            if first is not None and not group.command:
                first.fellow = group
            command, after = "", group if group.command == "frac" else None
        else:
            command, after = (kind, None) if kind in ("frac", "sqrt", "text") else ("", None)
            stack[-1].parts.append(commands.get(kind, m[0]))
    while len(stack) > 1:  # a brace that stays open is a sign among what follows it
        rest = stack.pop()
        stack[-1].parts += ["{", *rest.parts]
    return stack[0]


#: What signs become at last.
SIGNS = re.compile(r"(?P<none>\^?\\circ)|(?P<times>\\cdot|\\times)|(?P<minus>−)")


@lru_cache(1 << 16)
def normalize_math_text(answer: str | None) -> str | None:
    """A LaTeX answer without its mark-up, in a form in which equal answers are equal; None if nothing is left.

    Fractions are a/b, roots sqrt(a), and braces, spacing, degree signs and white space are dropped; plain decimals are
    canonical and all else is in lower case.
    """
    text = (answer or "").strip()
    for left, right in ENCLOSED:
        if text.startswith(left) and text.endswith(right):
            text = text.removeprefix(left)
            text = text.removesuffix(right).strip()
            break
    text = (boxed(text) or text).strip().rstrip(".")
    text = re.sub(r"^(?:the\s+)?(?:final\s+)?answer\s*(?:is|=)\s*", "", text, flags=re.IGNORECASE)
    if "\\" in text or "{" in text or "−" in text:
        text = "".join(resolve(parsed(text)))
        text = SIGNS.sub(lambda m: {"none": "", "times": "*", "minus": "-"}[m.lastgroup], text)
    text = "".join(text.split()).strip("$")
    if re.fullmatch(r"[-+]?\d+(\.\d+)?", text):
        return f"{Decimal(text).normalize() + 0:f}"
    return text.lower() or None


@F.pandas_udf(StringType())
def math_answer(text: pd.Series) -> pd.Series:
    return pd.Series([math_answer_of(t) for t in text], dtype=object)


@F.pandas_udf(StringType())
def normalize_math(text: pd.Series) -> pd.Series:
    return pd.Series([normalize_math_text(t) for t in text], dtype=object)


@F.pandas_udf(StringType())
def normal_math_answer(text: pd.Series) -> pd.Series:
    """The normal form of a text's answer, in one pass over a batch."""
    return pd.Series([normalize_math_text(math_answer_of(t)) for t in text], dtype=object)


def exact_mcnemar(corrections: int, regressions: int) -> float:
    """The p of columns.mcnemar with whole numbers, for any number of pairs."""
    n = corrections + regressions
    tail = sum(math.comb(n, i) for i in range(min(corrections, regressions) + 1))
    return min(1.0, 2 * tail / 2**n) if n else 1.0


def shuffled(n: int, seed: int) -> list[int]:
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def random_positions(lengths: list[int], reference: int, seed: int, least: int = 64) -> list[tuple[int, int]]:
    """Sorted random positions from least to the reference length, one for each rollback length (1 at least)."""
    draw, high = random.Random(seed), max(least + 1, reference)
    return list(zip(sorted(draw.randint(least, high) for _ in lengths), (max(1, v) for v in lengths), strict=True))


def sample_token(logits: np.ndarray, temperature: float, seed: int) -> int:
    """A token by the inverse of the softmax's distribution function, at a uniform number of the seed."""
    x = logits / max(temperature, 1e-6)
    p = np.exp(x - x.max())
    return int(np.searchsorted(np.cumsum(p) / p.sum(), np.random.default_rng(seed).random(), "right"))
