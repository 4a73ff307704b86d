"""Character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20


def pieces(texts: list[str], overlap: int, most: int = PIECE, whole: bool = False) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of about `most` characters: index of each text, a part of it, and the number of leading characters that
    an earlier part had too. Long texts come in several parts that overlap, so that no n-gram is lost or counted twice; with
    `whole`, they come as they are, each in a group of its own or as the last of one."""
    index: list[int] = []
    part: list[str] = []
    known: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            piece = text if whole else text[at : at + most]
            index.append(k)
            part.append(piece)
            known.append(overlap if at else 0)
            size += len(piece)
            if size >= most:
                yield index, part, known
                index, part, known, size = [], [], [], 0
            if whole or at + most >= len(text):
                break
            at += most - overlap
    if part:
        yield index, part, known


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and where each starts (with the end as last entry)."""
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), cuts


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class HashTable:
    """Values by 64-bit keys whose bits are spread, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        #: Where the keys of each leading bits start; few keys share them.
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0 for unknown ones) and whether it is known."""
        out, found = np.zeros(len(wanted), self.values.dtype), np.zeros(len(wanted), bool)
        if not len(self.keys):
            return out, found
        lead = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        rest = np.flatnonzero(at < end)
        at, end = at[rest], end[rest]
        while len(rest):
            same = self.keys[at] == wanted[rest]
            out[rest[same]], found[rest[same]] = self.values[at[same]], True
            at = at + 1
            more = ~same & (at < end)
            rest, at, end = rest[more], at[more], end[more]
        return out, found
