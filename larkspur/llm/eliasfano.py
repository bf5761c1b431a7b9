"""Elias-Fano sequences over memory-mapped arrays, searched many at a time."""

from __future__ import annotations

import json
import mmap
import os
import uuid

import numpy as np
from pyarrow import fs

#: Place of the r-th set bit of a byte (8: it has fewer), at byte * 8 + r.
PLACE = np.array([next((i for i in range(8) if b >> i & 1 and bin(b & ((1 << i) - 1)).count("1") == r), 8) for b in range(256) for r in range(8)], np.int64)
ONES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
PAIRS, FOURS, LOWS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def nth_bit(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each word: byte sums side by side, then a table."""
    sums = words - (words >> np.uint64(1) & PAIRS)
    sums = (sums & FOURS) + (sums >> np.uint64(2) & FOURS)
    ahead = (sums + (sums >> np.uint64(4)) & LOWS) * ONES
    r = r.astype(np.uint64)
    shift = np.bitwise_count((r * ONES | TOPS) - ahead & TOPS).astype(np.uint64) * np.uint64(8)
    rest = r - (ahead << np.uint64(8) >> shift & np.uint64(255))
    return shift.astype(np.int64) + PLACE[((words >> shift & np.uint64(255)) * np.uint64(8) + rest).astype(np.int64)]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with ranks per word."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width, self.buckets = (int(x) for x in arrays[f"{name}.shape"])
        self.low, self.high, self.ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones"))
        self.zeros = arrays[f"{name}.zeros"]

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        """Arrays of sorted values below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        buckets = (max(universe - 1, 0) >> width) + 1
        bits = np.zeros((-(-(n + buckets + 1) // 64) + 1) * 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        kind = np.uint32 if len(high) < 1 << 26 else np.int64
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            shifts = np.arange(width, dtype=np.uint64)
            for at in range(0, n, 65536):
                part = (values[at : at + 65536, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel()
                packed = np.packbits(np.pad(part, (0, -len(part) % 64)), bitorder="little").view(np.uint64)
                low[at * width // 64 : at * width // 64 + len(packed)] = packed
        return {f"{name}.shape": np.array([n, width, buckets]), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones.astype(kind), f"{name}.zeros": (np.arange(len(ones)) * 64 - ones).astype(kind)}

    def _select(self, counts: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        k = k.astype(counts.dtype)  # or the counts would be copied to the type of k
        word = np.searchsorted(counts, k, side="right") - 1
        bits = self.high[word]
        return word * 64 + nth_bit(bits if ones else ~bits, k - counts[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        carried = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (self.low[word] >> shift | carried) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(self.ones, i, True) - i).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 if it is not there: the successor search ends in its bucket."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        bucket = (values >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero((bucket >= 0) & (bucket < self.buckets))
        bucket = bucket[inside]
        # the first bucket starts at 0; every other after the zero that ends the one before
        before = np.maximum(bucket - 1, 0)
        bit = np.where(bucket > 0, self._select(self.zeros, before, False) + 1, 0)
        start = bit - bucket
        # its members are the ones up to the next zero
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        ahead = self.high[word] >> shift | np.where(shift > 0, self.high[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        run = np.bitwise_count(ahead & ~(ahead + np.uint64(1))).astype(np.int64)
        stop = start + run
        if (long := run == 64).any():
            stop[long] = self._select(self.zeros, bucket[long], False) - bucket[long]
        wanted = values[inside] & np.uint64((1 << self.width) - 1)
        keep = start < stop
        inside, start, stop, wanted = inside[keep], start[keep], stop[keep], wanted[keep]
        stop_at = stop.copy()
        # the first member that is not smaller, by halving what is left of each bucket
        low, end = start.copy(), stop
        go = np.arange(len(inside))
        while len(go):
            middle = low[go] + end[go] >> 1
            less = self._low(middle) < wanted[go]
            low[go[less]] = middle[less] + 1
            end[go[~less]] = middle[~less]
            go = go[low[go] < end[go]]
        there = np.flatnonzero(low < stop_at)
        there = there[self._low(low[there]) == wanted[there]]
        out[inside[there]] = low[there]
        return out


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (file:/ has one slash there)."""
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays as one file that can be mapped.

    It is written under a name of its own and then renamed, on any store: of several
    attempts of a task each leaves a whole file, and equal ones at that.
    """
    store, path = located(uri)
    entries, at = {}, 0
    for name, a in arrays.items():
        entries[name] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 64)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + bytes(-len(raw) % 64))
    try:
        store.move(own, path)
    except OSError:  # some stores do not rename onto a file: another attempt's is there
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(own)


#: Arrays by file, the latest used last, and how many bytes of them are held in memory.
_MAPPED: dict[str, tuple[dict[str, np.ndarray], int]] = {}
#: Bytes of files of remote stores that a worker holds, and the number of mapped files.
HELD_BYTES, HELD_FILES = 256 << 20, 10_000


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped, or held in memory within HELD_BYTES where the store has no local path."""
    if (found := _MAPPED.pop(uri, None)) is None:
        store, path = located(uri)
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as f:
                raw, held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), 0
        else:
            with store.open_input_stream(path) as source:
                raw = source.read()
            held = len(raw)
        size = int.from_bytes(raw[:8], "little")
        entries = json.loads(raw[8 : 8 + size])
        found = {k: np.frombuffer(raw, np.dtype(d), int(np.prod(shape)), 8 + size + at).reshape(shape) for k, (d, shape, at) in entries.items()}, held
        while _MAPPED and (len(_MAPPED) >= HELD_FILES or sum(n for _, n in _MAPPED.values()) + held > HELD_BYTES):
            del _MAPPED[next(iter(_MAPPED))]
    _MAPPED[uri] = found
    return found[0]


def forget(prefix: str) -> None:
    """Unmaps the files of a model that is no longer used."""
    for uri in [u for u in _MAPPED if not u.startswith(prefix)]:
        del _MAPPED[uri]
