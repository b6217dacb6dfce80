"""Text columns of Arrow batches as flat byte arrays, and hashes of their segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is worked on alone.
BLOCK = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents of about ``most`` bytes."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit hashes of any segments of a byte array: prefix sums of random byte values times powers of an odd base."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.unpowers = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("powers", self.base), ("unpowers", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.unpowers[start]


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+size."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def sort_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by integer keys of 0 or more, the first key first.

    As many bits as fit are sorted at once, with a row's place in the low bits of a word.
    """
    n = len(keys[0])
    if n < 2:
        return np.arange(n)
    place = n.bit_length()
    room, mask = 64 - place, np.uint64((1 << place) - 1)
    # Pieces of at most ``room`` bits, the least first; small neighbours share one.
    pieces: list[list] = []
    for key in reversed(keys):
        key = key.astype(np.uint64, copy=False)
        left, at = int(key.max()).bit_length(), 0
        while at < left:
            used = pieces[-1][1] if pieces else room
            take = min(left - at, room - used)
            if take < left - at and take < 16:  # rather a new piece than a sliver
                take, used = min(left - at, room), room
            if used >= room:
                pieces.append([[], 0])
                used = 0
            pieces[-1][0].append((key, at, take, used))
            pieces[-1][1] += take
            at += take
    order = None
    for some, _ in pieces:
        word = np.zeros(n, np.uint64)
        for key, at, take, used in some:
            x = key if order is None else key[order]
            word |= (x >> np.uint64(at) & np.uint64((1 << take) - 1)) << np.uint64(used)
        word <<= np.uint64(place)
        word |= np.arange(n, dtype=np.uint64)
        word.sort()
        found = (word & mask).astype(np.int64)
        order = found if order is None else order[found]
    return np.arange(n) if order is None else order


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct key, number of each row's key), keys in rising order."""
    order = sort_order(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number
