"""Words of many texts at once, as numpy arrays over their joined UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are joined up to about this many bytes, which bounds a task's memory (a longer text stands alone).
JOIN_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


class Joined:
    """The words of several texts: byte ranges, text numbers and 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool):
        self.n_texts = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first_byte = np.concatenate([[0], np.cumsum(sizes)])
        self.space = SPACE[self.bytes]
        edge = np.diff(np.concatenate([[True], self.space]).astype(np.int8))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        self.first_word = np.searchsorted(self.starts, self.first_byte)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(self.first_word))
        up, down = _powers(len(self.bytes) + 1)
        terms = (_VALUES_LOWER if lower else _VALUES)[self.bytes] * up[: len(self.bytes)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.first_byte[1:]] - total[self.first_byte[:-1]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``width`` words within one text, and the number of their first words."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = np.zeros(n, np.uint64)
        for j in range(width):
            value = value * np.uint64(_FACTOR) + self.hashes[j : j + n]
        whole = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return mix(value[whole]), whole


def batches(texts: Iterable[str | None], most: int = 1 << 30) -> Iterator[list[bytes]]:
    """Texts in their order as UTF-8, in groups of about ``JOIN_BYTES`` and ``most`` texts at most; null counts as empty."""
    group, size = [], 0
    for text in texts:
        data = (text or "").encode()
        if group and (size + len(data) > JOIN_BYTES or len(group) == most):
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield group


def joined(texts: Iterable[str | None], lower: bool = False) -> Iterator[Joined]:
    """The words of such groups."""
    for group in batches(texts):
        yield Joined(group, lower)
