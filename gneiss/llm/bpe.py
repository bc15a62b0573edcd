"""Byte-level BPE ids for whole texts, cached by word.

The vocabulary is read from a public tokenizer file (a parameter, never copied). A text is cut at each single space that
follows a non-space character: the vocabulary's split pattern always starts a new token there, so each part can be encoded
alone and its ids reused. Words repeat, so most parts come from the cache.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_UNEVEN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """An encoder over the vocabulary in `path`; special tokens' strings in a text are ordinary text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", ())}
    letters = _byte_alphabet()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The strings that the vocabulary in `path` adds beside its pieces, and their ids."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", ())}


class Encoder:
    """Ids of whole texts; keeps the ids of up to `most` parts, and starts anew when there are more.

    With `added`, an added token's string in a text has that token's id, as in tokenizers by default; else it is ordinary text.
    """

    def __init__(self, path: str = VOCABULARY, most: int = 500_000, added: bool = False):
        self.added = {x: np.array([i], dtype="<u4").tobytes() for x, i in added_tokens(path).items()} if added else {}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")  # the longest first
        self.encode, self.most = encoding(path).encode_to_numpy, most
        pieces = encoding(path)
        self.n_bytes = np.array([len(pieces.decode_single_token_bytes(i)) for i in range(pieces.max_token_value + 1)], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit numbers."""
        if self.added and self.cut_added.search(text):
            return b"".join(self.added.get(x) or self._plain_ids(x) for x in self.cut_added.split(text) if x)
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        parts = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, parts))
        found[0] = b""  # the first part has no space before it
        unknown = list(dict.fromkeys(p for p, x in zip(parts, found, strict=True) if x is None))
        head = self._learn(parts[0], unknown)
        if unknown:
            fresh = self.fresh
            found = [fresh[p] if x is None else x for p, x in zip(parts, found, strict=True)]
        return head + b"".join(found)

    def _learn(self, head: str, unknown: list[str]) -> bytes:
        """Encodes the head and all unknown parts at once, cuts the ids where the parts end, and returns the head's."""
        ids = self.encode(" ".join([head, *unknown]), disallowed_special=()).astype("<u4", copy=False)
        raw = ids.tobytes()
        if not unknown:
            self.fresh = {}
            return raw
        ends = np.cumsum(self.n_bytes[ids])
        parts_end = np.cumsum([len(head.encode()), *(len(p.encode()) + 1 for p in unknown)])
        cuts = (4 * np.searchsorted(ends, parts_end, side="right")).tolist()
        self.fresh = {p: raw[a:b] for p, a, b in zip(unknown, cuts, cuts[1:], strict=False)}
        self.known.update((p, x) for p, x in self.fresh.items() if len(p) <= 40)
        return raw[: cuts[0]]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    """One cache for each Python worker and kind."""
    return Encoder(path, added=added)
