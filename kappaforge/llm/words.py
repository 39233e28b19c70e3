"""Vectorised word spans and hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a few documents at a time. ``blocks``
cuts a batch so that temporaries stay small whatever the batch size; a single
long document is one block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)


def byte_table(pattern_bytes) -> np.ndarray:
    """Boolean table over the 256 byte values: True for bytes of words."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: words [^\x20\x09-\x0D]+
NON_SPACE = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z, non-ASCII
ALNUM_LOWER = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string without nulls (null reads as empty)."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets start at 0."""
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with about ``max_bytes`` of text: (slice, bytes, offsets)."""
    if not batch.num_rows:
        return
    text = text_column(batch, name)
    _, offsets = raw(text)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        stop = min(max(stop, at + 1), batch.num_rows)
        buf, off = raw(text.slice(at, stop - at))
        yield batch.slice(at, stop - at), buf, off
        at = stop


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per document, the number of its first word (and a total)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = table[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number a code point (its UTF-8 bytes, packed), and where each document's begin."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = buf[at].astype(np.uint64)
    if len(at) < len(buf):
        length = np.diff(np.append(at, len(buf)))
        for k in range(1, 4):
            more = np.flatnonzero(length > k)
            points[more] |= buf[at[more] + k].astype(np.uint64) << U(8 * k)
    return points, np.searchsorted(at, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def padded(data: bytes | np.ndarray) -> np.ndarray:
    """A copy of the bytes with eight zeros behind, so that eight can be read from any place."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[:-8] = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return out


#: masks that keep the first 0 to 8 bytes of a lane
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes (fewer where ``sizes`` has less) from each place of a padded buffer, as one number."""
    every = np.ndarray(len(room) - 7, "<u8", room, strides=(1,))
    return every[starts] & _FIRST[np.minimum(sizes, 8)]


def same_bytes(room_a: np.ndarray, at_a: np.ndarray, room_b: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes at places of two padded buffers are equal."""
    equal = np.ones(len(sizes), bool)
    left, k = np.flatnonzero(sizes > 0), 0
    while len(left):
        n = sizes[left] - k
        equal[left] = lanes(room_a, at_a[left] + k, n) == lanes(room_b, at_b[left] + k, n)
        k += 8
        left = left[equal[left] & (sizes[left] > k)]
    return equal


class Hash:
    """Seeded 64-bit hashes of byte strings and of runs of numbers.

    Every step mixes before the next one adds to it, so that no sum or product of
    the parts decides the hash: a polynomial modulo 2**64 is equal for some short
    strings of two letters whatever its base.
    """

    #: bytes of a string that is hashed beside others; a longer one is hashed by itself
    SHORT = 256

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.key = rng.bytes(16)
        self.seed, self.pair, self.step = (U(int(x) * 4 + 3) for x in rng.integers(0, 1 << 62, 3))

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = left * self.pair + right
        x ^= x >> U(32)
        x *= self.step
        return x

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of buf[start:end] for every pair."""
        room, sizes = padded(buf), ends - starts
        out = mix(sizes.astype(np.uint64) * _MULT + self.seed)
        # most have eight bytes at most, so the first step takes all at once
        out = np.where(sizes > 0, self._joined(out, lanes(room, starts, sizes)), out)
        left, k = np.flatnonzero((sizes > 8) & (sizes <= self.SHORT)), 8
        while len(left):
            out[left] = self._joined(out[left], lanes(room, starts[left] + k, sizes[left] - k))
            k += 8
            left = left[sizes[left] > k]
        for i in np.flatnonzero(sizes > self.SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(room[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return mix(out)

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for every pair, from hashes of runs of 1, 2, 4, ... values."""
        sizes = ends - starts
        out = np.full(len(starts), self.seed)
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size) if len(sizes) and (sizes[0] != size or sizes.min() != sizes.max()) else slice(None)
            at, have, run, part = starts[rows], 0, values ^ self.seed, 1
            found = np.full(len(at), U(size))
            while True:
                if size & part:
                    found = self._joined(found, run[at + have])
                    have += part
                if have == size:
                    break
                run = self._joined(run[:-part], run[part:])
                part *= 2
            out[rows] = mix(found)
        return out


class Remembered:
    """A bounded table of byte strings. A string is known only if its bytes are those of the table."""

    def __init__(self, bits: int, room: int):
        self.bits, self.room = bits, room
        self.forget()

    def forget(self) -> None:
        self.size = np.full(1 << self.bits, -1, np.int64)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int64)
        self.text = np.zeros(self.room + 8, np.uint8)
        self.filled = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & U((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of every string of a padded buffer, -1 for one that is not known."""
        slot = self.slots(keys)
        slot[(self.key[slot] != keys) | (self.size[slot] != sizes)] = -1
        may = np.flatnonzero(slot >= 0)
        slot[may[~same_bytes(self.text, self.at[slot[may]], room, starts[may], sizes[may])]] = -1
        return slot

    def put(self, keys: np.ndarray, room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slots that strings take now, or -1 for those that do not stay: of one slot the last, and none that the table has no room for."""
        slot = self.slots(keys)
        _, last = np.unique(slot[::-1], return_index=True)
        stays = np.zeros(len(slot), bool)
        stays[len(slot) - 1 - last] = True
        stays[np.cumsum(np.where(stays, sizes, 0)) > self.room - self.filled] = False
        rows = np.flatnonzero(stays)
        n = sizes[rows]
        at = self.filled + np.cumsum(n) - n
        total = int(n.sum())
        self.text[self.filled : self.filled + total] = room[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(total)]
        self.filled += total
        self.key[slot[rows]], self.size[slot[rows]], self.at[slot[rows]] = keys[rows], n, at
        return np.where(stays, slot, -1)


def distinct(keys: np.ndarray, room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of distinct strings of a padded buffer, for every row the place of its string among them)."""
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    odd = np.flatnonzero((sizes != sizes[first[which]]) | ~same_bytes(room, starts, room, starts[first[which]], np.minimum(sizes, sizes[first[which]])))
    which[odd] = len(first) + np.arange(len(odd))  # equal keys of different strings
    return np.append(first, odd), which


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside one document, and their documents."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    shift = first[:-1] - (np.cumsum(counts) - counts)
    return np.arange(counts.sum()) + shift[doc], doc


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
