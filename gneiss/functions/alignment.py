"""Folded text that knows where it came from: for every character of the folded form, the place of the raw character behind it."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1 << 16)
def fold_character(c: str) -> str:
    """No marks, lower case; the stroked d counts as d. May be empty (a loose mark) or several characters (a ligature)."""
    plain = unicodedata.normalize("NFKD", {"đ": "d", "Đ": "D"}.get(c, c))
    return "".join(x for x in plain if not unicodedata.combining(x)).lower()


def fold_with_offsets(text: str | None) -> tuple[str, np.ndarray]:
    """The folded text (single spaces, none at the ends) and, for each of its characters, the place in the raw text that it comes from.

    Each distinct character is folded once; the rest is array work. Null counts as empty.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, which = np.unique(codes, return_inverse=True)
    forms = [fold_character(chr(c)) for c in kinds.tolist()]
    size = np.array([len(f) for f in forms], dtype=np.int64)
    begin = np.cumsum(size) - size
    letters = np.array([ord(x) for f in forms for x in f], dtype="<u4")
    blank = np.array([x.isspace() for f in forms for x in f], dtype=bool)
    times = size[which]
    raw = np.repeat(np.arange(len(codes)), times)
    at = begin[which][raw] + np.arange(len(raw)) - np.repeat(np.cumsum(times) - times, times) if len(raw) else raw
    out, space = letters[at], blank[at]
    out = np.where(space, np.uint32(32), out)
    kept = ~space | ~np.concatenate([[True], space[:-1]]) if len(out) else np.zeros(0, dtype=bool)
    out, raw = out[kept], raw[kept]
    if len(out) and out[-1] == 32:
        out, raw = out[:-1], raw[:-1]
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), raw


def raw_span(offsets: np.ndarray, start: int, end: int) -> tuple[int, int] | None:
    """The raw places behind folded ones; null for an empty span or one that is not inside the text."""
    if start < 0 or end <= start or end > len(offsets):
        return None
    return int(offsets[start]), int(offsets[end - 1]) + 1
