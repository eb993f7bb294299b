"""The pre-tokenizer of the byte-level vocabulary as marks on code points, and a vocabulary's files."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import regex

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
SYMBOL, LETTER, NUMBER, BLANK, WHITE, QUOTE, END = range(7)
#: Unicode's white space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_table: np.ndarray | None = None


def path(name: str) -> str:
    return public_tokenizers.path(name)


def table() -> np.ndarray:
    """The class of every code point."""
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                shift = lambda i: i + 0x800 * (i >= 0xD800)
                out[shift(a) : shift(b - 1) + 1] = value
        out[WHITE_SPACE], out[0x20], out[0x27] = WHITE, BLANK, QUOTE
        _table = out
    return _table


def borders() -> np.ndarray:
    """Whether a piece begins at a code point, by 49 * class before it + 7 * its class + class after it."""
    before, kind, after = (x.ravel() for x in np.indices((7, 7, 7)))
    signs, whites = (SYMBOL, QUOTE), (BLANK, WHITE)
    goes_on = (before == BLANK) | (before == kind) | (np.isin(kind, signs) & np.isin(before, signs))
    white = ~np.isin(before, whites) | ~np.isin(after, (*whites, END))
    return np.where(np.isin(kind, whites), white, ~goes_on) | (kind == END)


def pieces(texts: list[str]) -> tuple[list[str], list[int]]:
    """The pre-tokens of all texts in order, and the number of those of each text.

    The same pieces as those of the pattern of contractions, runs of letters, numbers and other signs
    (each with one leading blank) and white space: a piece begins where the classes of a code point and
    its neighbours say so, and after a contraction.
    """
    if not texts:
        return [], []
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = table()[codes]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind[ends] = END
    turn = kind.astype(np.uint16) * 7
    turn[1:] += kind[:-1] * np.uint16(49)
    turn[0] += END * 49
    turn[:-1] += kind[1:]
    turn[-1] += END
    begin = borders()[turn]
    quotes = np.flatnonzero(kind == QUOTE)
    quotes = quotes[begin[quotes]]
    if len(quotes):
        padded = np.r_[codes, np.zeros(3, np.uint32)]
        first, second = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(first, [ord(c) for c in "sdmt"])
        two = ((first == ord("l")) & (second == ord("l"))) | (np.isin(first, [ord("v"), ord("r")]) & (second == ord("e")))
        begin[quotes[one | two] + 1] = False
        begin[quotes[one] + 2] = True
        begin[quotes[two] + 3] = True
    starts = np.flatnonzero(begin)
    keep = kind[starts] != END
    stops = np.r_[starts[1:], len(codes)][keep]
    starts = starts[keep]
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    return [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())], counts.tolist()  # noqa: B905
