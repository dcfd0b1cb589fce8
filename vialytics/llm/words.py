"""Words of whole texts as numpy arrays: bytes, places and hashes of any part of them, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

#: ASCII characters that are no letters separate words; all bytes of other characters belong to them.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Texts are taken in batches of so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_KEPT: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; those that batches of the usual size need are kept."""
    if _KEPT and len(_KEPT[0]) > n:
        return _KEPT[0], _KEPT[1]
    made = []
    for x in (_BASE, _INVERSE):
        power = np.full(max(n, 2 * BATCH_BYTES) + 1, x, dtype=np.uint64)
        power[0] = 1
        made.append(np.cumprod(power))
    if n <= 2 * BATCH_BYTES:
        _KEPT[:] = made
    return made[0], made[1]


class Words:
    """The lower-cased words of some texts. Word i of text k has first[k] <= i < first[k + 1]; raw[start:end] are its bytes."""

    def __init__(self, texts: list[str]):
        coded = [(t or "").lower().encode() for t in texts]
        raw = np.frombuffer(b"  " + b" ".join(coded).translate(LETTERS) + b"    ", dtype=np.uint8)
        inside = raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.raw, self.start, self.end = raw, edges[::2], edges[1::2]
        begin = np.cumsum([2, *(len(c) + 1 for c in coded)])
        self.first = np.searchsorted(self.start, begin)
        self._total = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
        if self._total is None:
            n = len(self.raw)
            power, self._inverse = _powers(n)
            self._total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.raw + np.uint64(1)) * power[:n], out=self._total[1:])
        return mix64((self._total[end] - self._total[start]) * self._inverse[start])


def slices(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
