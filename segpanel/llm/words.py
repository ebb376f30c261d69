"""Word hashes of whole texts by array arithmetic."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
SEGMENT = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(SPACES)] = True
    return out


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z if ``lower``."""
    codes = np.arange(256)
    if lower:
        codes[65:91] += 32
    return mix((codes + 1).astype(_U) * _STEP)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT + 1)
            base = 0xD6E8FEB86659FD93
            up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its text's number and its first byte's place in the joined texts.

    Words are runs of bytes other than ``SPACES``. Texts are joined by a line break; the joined bytes are
    hashed segment by segment, so memory doesn't follow the longest text.
    """
    joined = b"\n".join(texts) + b"\n"
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes, places, at = [], [], 0
    raw = np.frombuffer(joined, np.uint8)
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        if end < len(raw):
            cut = _last_space(joined, at, end)
            end = cut if cut > at else _next_space(joined, end, len(raw))
        part = raw[at:end]
        space = _is_space()[part]
        edge = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _POWERS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_byte_values(lower)[part] * up[:len(part)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix(found ^ (ends - starts).astype(_U) * _STEP))
        places.append(starts + at)
        at = end
    out, where = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, _U), (places, np.int64)))
    return out, np.searchsorted(begins, where, side="right") - 1, where


def _last_space(data: bytes, a: int, b: int) -> int:
    return max(data.rfind(bytes([s]), a, b) for s in SPACES)


def _next_space(data: bytes, a: int, n: int) -> int:
    return min((p for s in SPACES if (p := data.find(bytes([s]), a)) >= 0), default=n)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence hashed as ``a`` followed by ``b``."""
    return mix(a * _U(0xFF51AFD7ED558CCD) + b)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of each text, ascending, one text after another, and how many each has.

    A text of fewer words has the whole sequence as its one shingle; one without words has none. A-Z count as a-z.
    """
    words, text, _ = word_hashes(texts, lower=True)
    n_words = np.bincount(text, minlength=len(texts))
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    long = np.flatnonzero(text[:len(words) - width + 1] == text[width - 1:]) if len(words) >= width else np.empty(0, np.int64)
    out = words[long]
    for k in range(1, width):
        out = fold(out, words[long + k])
    shingles = np.empty(int(n.sum()), _U)
    ends = np.cumsum(n)
    place = np.ones(len(shingles), bool)
    first = np.cumsum(n_words) - n_words
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        h = words[first[i]:first[i] + 1]
        for k in range(1, n_words[i]):
            h = fold(h, words[first[i] + k:first[i] + k + 1])
        shingles[ends[i] - 1] = mix(h ^ _U(n_words[i]))[0]
        place[ends[i] - 1] = False
    shingles[place] = out
    for a, b in zip(ends - n, ends):
        if b - a > 1:
            shingles[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), n)
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(texts))


def by_size(texts: list[bytes], most: int = 3_000_000):
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
