"""Per-word results remembered by a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distinct words that a worker remembers, at some 30 bytes each; beyond it only those of the latest texts stay.
WORD_CACHE = 1_200_000
#: Bytes that are hashed at once.
BLOCK = 1 << 20
#: A random odd value for each byte of a word; words end at spaces and line feeds.
VALUES = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BREAK = np.isin(np.arange(256), [10, 32])
BASE = 0x9E3779B97F4A7C15 | 5


class Powers:
    """Powers of BASE and of its inverse modulo 2^64."""

    up = np.ones(0, np.uint64)
    down = np.ones(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            made = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                made.append(np.cumprod(factors, dtype=np.uint64))
            cls.up, cls.down = made
        return cls.up, cls.down


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that follow each other.

    The hash is a polynomial of the bytes, taken block by block; a span that goes over
    the end of a block adds up what it has in each.
    """
    total = np.zeros(len(start), np.uint64)
    for at in range(0, len(data), BLOCK):
        end = min(at + BLOCK, len(data))
        first, last = np.searchsorted(stop, at, side="right"), np.searchsorted(start, end)
        if first == last:
            continue
        up, down = Powers.of(end - at)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(VALUES[data[at:end]] * up[: end - at], out=sums[1:])
        a, b = np.maximum(start[first:last], at) - at, np.minimum(stop[first:last], end) - at
        part = (sums[b] - sums[a]) * down[a]
        if start[first] < at:  # the rest of a span: its first byte has the power of its place in the span
            part[0] = np.uint64(int(part[0]) * pow(BASE, at - int(start[first]), 1 << 64) % (1 << 64))
        total[first:last] += part
    # the length tells spans apart that differ by bytes of a value that is a multiple of a power
    return finished(total ^ (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of every word of a text, in order."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~BREAK[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    return span_hashes(data, start, stop), start, stop


class WordMemo:
    """Maps whole texts to bytes, word by word.

    ``learn`` gives the bytes of many space-separated words at once, a multiple of four
    for each. A word here is what stands between spaces or line feeds; ``learn`` deals
    with whatever else it holds, so that the bytes of a text are those of its words in
    turn. Words are told apart by 64-bit hashes, and their bytes lie in one array, from
    which those of many texts are taken at once.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], cache: int = WORD_CACHE):
        self.learn, self.cache = learn, cache
        # sorted hashes and the number of each, then by number the place of its bytes; numbers are given as words come
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.first, self.size, self.store = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _add(self, keys: np.ndarray, found: list[bytes]) -> None:
        """Remembers the bytes of new words, by sorted keys."""
        size = np.array([len(x) for x in found], np.int64) // 4
        at = np.searchsorted(self.keys, keys)
        self.number = np.insert(self.number, at, np.arange(len(self.size), len(self.size) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.append(self.first, len(self.store) + np.cumsum(size) - size)
        self.size = np.append(self.size, size.astype(np.int32))
        self.store = np.append(self.store, np.frombuffer(b"".join(found), np.uint32))

    def _trim(self, used: np.ndarray) -> None:
        """Forgets all words but those at ``used`` of the sorted ones."""
        number = self.number[used]
        size = self.size[number].astype(np.int64)
        self.store = self.store[_places(self.first[number], size)]
        self.keys, self.number = self.keys[used], np.arange(len(used), dtype=np.int32)
        self.first, self.size = np.cumsum(size) - size, size.astype(np.int32)

    def spans(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one, hashes, starts and stops of their words, and where each text ends."""
        raw = b"\n".join(parts)
        return raw, *word_spans(raw), np.cumsum([len(p) + 1 for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        raw, hashes, start, stop, ends = self.spans([t.encode("utf-8", "surrogatepass") for t in texts])
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
        keys = ranked[new]
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        missing = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            some = order[new[missing]]
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)]
            self._add(keys[missing], self.learn(words))
        place = np.searchsorted(self.keys, keys)
        number = np.empty(len(hashes), np.int32)
        number[order] = np.repeat(self.number[place], np.diff(np.append(new, len(ranked))))
        size = self.size[number].astype(np.int64)
        out = self.store[_places(self.first[number], size)].tobytes()
        # where the words of each text begin, then their bytes
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, ends)].tolist()
        if len(self.keys) > self.cache:
            self._trim(place)
        return [out[4 * a : 4 * b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def slices(texts: list[str], rows: int = 256, chars: int = 4_000_000):
    """Consecutive runs (start, stop) of few rows and characters; a longer text stands alone."""
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and (at - start >= rows or size + len(text) > chars):
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
