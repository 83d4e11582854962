"""Statistics of one whole text, counted on its UTF-8 bytes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

#: Exact counts first (integers), model features after them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "stop_share",
    "accent_share", "distinct_share", "top_word_share", "top_three_share", "short_word_share", "long_word_share", "longest_word", "words_a_line", "word_bits",
    "byte_bits", "pair_bits", "rare_pair_share", "title_share", "length_spread", "blank_share",
)
SPACE, UPPER, LOWER, DIGIT, SYMBOL, MARK, STOP, MORE, LEAD, OTHER = range(10)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for i in range(256):
        c = chr(i)
        if c == " " or "\t" <= c <= "\r":
            kind[i] = SPACE
        elif i >= 0xC0:
            kind[i] = LEAD
        elif i >= 0x80:
            kind[i] = MORE
        elif c in "#*$%&|<>":
            kind[i] = SYMBOL
        elif c in ".,":
            kind[i] = STOP
        elif c in "!?":
            kind[i] = MARK
        elif c.isdigit():
            kind[i] = DIGIT
        elif c.isupper():
            kind[i] = UPPER
        elif c.islower():
            kind[i] = LOWER
    return kind


KIND = _classes()


def repeated_words(codes: np.ndarray) -> int:
    """Word positions inside three-word windows that occur at least twice in the text."""
    n = len(codes)
    if n < 4:
        return 0
    span = int(codes.max()) + 1
    if span < 2_000_000:
        windows = (codes[:-2] * span + codes[1:-1]) * span + codes[2:]
    else:
        pairs = np.unique(codes[:-2] * span + codes[1:-1], return_inverse=True)[1]
        windows = pairs * span + codes[2:]
    ranked = np.sort(windows)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def _bits(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def describe(data: bytes) -> tuple[tuple[int, ...], list[float]]:
    """Exact counts and model features of one text; the empty text has zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0), [0.0] * (len(FEATURES) - 1) + [1.0 if data else 0.0]
    octets = np.frombuffer(data, np.uint8)
    kind = KIND[octets]
    kinds = np.bincount(kind, minlength=10)
    blank = np.concatenate(([True], kind == SPACE, [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    codes = np.array([number[w] for w in words], np.int64)
    repeats = repeated_words(codes)
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    chars = len(data) - int(kinds[SPACE]) - int(kinds[MORE])
    symbols = int(kinds[SYMBOL])
    of_word = np.bincount(codes)
    top = np.sort(of_word)[-3:]
    histogram = np.bincount(octets, minlength=256)
    ordered = np.sort(octets[:-1].astype(np.uint16) << 8 | octets[1:])
    pairs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))) if len(ordered) else np.ones(1)
    title = int((kind[starts] == UPPER).sum())
    at_least = max(chars, 1)
    return (n, chars, symbols, dup, repeats), [
        float(np.log1p(n)), chars / n, symbols / at_least, dup / max(len(lines), 1), repeats / n,
        kinds[UPPER] / at_least, kinds[DIGIT] / at_least, kinds[MARK] / at_least, kinds[STOP] / at_least, kinds[LEAD] / at_least,
        len(number) / n, top[-1] / n, top.sum() / n, float((lengths <= 2).mean()), float((lengths >= 14).mean()), float(np.log1p(lengths.max())),
        n / max(len(lines), 1), _bits(of_word) / max(np.log2(n), 1.0), _bits(histogram), _bits(pairs), float((pairs == 1).sum() / len(data)),
        title / n, float(lengths.std()), int(kinds[SPACE]) / len(data),
    ]


def describe_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [describe(t) for t in texts]
    return np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS)), np.array([b[1] for b in both], float).reshape(-1, len(FEATURES))

