"""Words of a batch of texts and 64-bit hashes of them, as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: ASCII letters and digits, and every byte of a character beyond ASCII
ALPHANUMERIC = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: everything but ASCII white space
VISIBLE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """``data``: lower-cased bytes of all texts; words of text i are ``first[i]:first[i + 1]``."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def split_words(texts: list[bytes], inside: np.ndarray) -> Words:
    """Lower-case A-Z and find the runs of bytes that ``inside`` marks; no word crosses from one text into the next."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    mask = inside[data]
    mask[bounds[1:] - 1] = False
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, bounds))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans must not be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    into = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(into, size)
    value = (data[np.repeat(start, size) + inner].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inner]
    return mix(np.add.reduceat(value, into) + size.astype(np.uint64))


def by_bytes(texts: Iterable[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes, each with the place of its first text."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if run and size + len(b) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(b)
        size += len(b)
    if run:
        yield at, run
