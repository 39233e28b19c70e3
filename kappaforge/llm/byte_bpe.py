"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: it resolves, for all
pieces of a block at once, those that are tokens themselves. Tier two merges
the bytes of every other piece, kept as a linked list, in the order of a heap
of pair ranks. Results of tier two are remembered in a bounded table. Hashes
only point at a token or a remembered piece: its bytes are then compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kappaforge.llm import pieces
from kappaforge.llm.words import Hash, Remembered, U, blocks, distinct, mix, padded, same_bytes

#: slots of the table of remembered pieces, bytes of their texts, and their ids
MEMO_BITS, MEMO_TEXT = 20, 1 << 24
ARENA = 1 << 22
BLOCK = 1 << 19
#: leaves of the heaps that stand side by side; longer pieces have a heap of their own
WIDTHS = (4, 8, 16, 32, 64)
_STEP = U(0xD6E8FEB86659FD93)
_NONE = np.int64(1 << 62)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by displacement: n keys, n slots."""

    def __init__(self, keys: np.ndarray):
        n = self.n = max(1, len(keys))
        m = self.buckets = max(1, n // 2)
        self.seed = np.zeros(m, np.int64)
        self.slot_key = np.zeros(n, np.uint64)
        self.slot_item = np.full(n, -1, np.int64)
        bucket = (mix(keys) % U(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=m))
        groups = [order[a:b] for a, b in zip(ends - np.diff(ends, prepend=0), ends)]
        used = np.zeros(n, bool)
        free_from = 0
        for k in sorted(range(m), key=lambda i: -len(groups[i])):
            g = groups[k]
            if not len(g):
                break
            if len(g) == 1:  # any free slot, kept as a negative displacement
                while used[free_from]:
                    free_from += 1
                slots, self.seed[k] = np.array([free_from]), -free_from - 1
            else:
                d, tries = 0, np.arange(64, dtype=np.uint64)[:, None]
                while True:
                    each = (mix(keys[g] + (tries + U(d)) * _STEP) % U(n)).astype(np.int64)
                    ok = ~used[each].any(1)
                    ok &= (np.diff(np.sort(each, 1), axis=1) > 0).all(1)
                    if ok.any():
                        break
                    d += 64
                self.seed[k] = d + int(ok.argmax())
                slots = each[ok.argmax()]
            used[slots] = True
            self.slot_key[slots], self.slot_item[slots] = keys[g], g

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key among those it was built from; -1 for any other."""
        d = self.seed[(mix(keys) % U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, (mix(keys + d.astype(np.uint64) * _STEP) % U(self.n)).astype(np.int64))
        return np.where(self.slot_key[slot] == keys, self.slot_item[slot], -1)


class Pairs:
    """A table of numbers by pairs of token numbers, looked up side by side: slots taken in turn, from the pair's own on."""

    def __init__(self, found: dict[tuple[int, int], int]):
        keys = np.fromiter((a << 32 | b for a, b in found), np.uint64, len(found))
        values = np.fromiter(found.values(), np.int64, len(found))
        self.mask = (1 << max(4, (2 * len(found)).bit_length())) - 1
        self.key = np.full(self.mask + 1, U(2**64 - 1))
        self.value = np.full(self.mask + 1, -1, np.int64)
        slot = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.value[slot] < 0)
            self.key[slot[free]], self.value[slot[free]] = keys[free], values[free]
            left = np.flatnonzero(self.key[slot] != keys)
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys * _STEP) & U(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of every pair, -1 for those that have none."""
        keys = left.astype(np.uint64) << U(32) | right.astype(np.uint64)
        slot = self._first(keys)
        out = np.where(self.key[slot] == keys, self.value[slot], -1)
        going = np.flatnonzero((self.key[slot] != keys) & (self.value[slot] >= 0))
        while len(going):
            at = (slot[going] + 1) & self.mask
            slot[going] = at
            there = self.key[at] == keys[going]
            out[going[there]] = self.value[at[there]]
            going = going[~there & (self.value[at] >= 0)]
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(tokens))
        self.room = padded(b"".join(tokens))
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        for seed in count(11):  # the first seed that tells all tokens apart
            self.hashing = Hash(seed)
            keys = self.hashing.words(self.room[:-8], self.start, self.start + self.size)
            if len(np.unique(keys)) == len(keys):
                break
        self.hash = PerfectHash(keys)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = [b""] * (int(self.ids.max()) + 1)
        for t, i in self.ranks.items():
            self.bytes_of[i] = t
        get = self.ranks.get
        pairs = ((get(t[:k]), get(t[k:]), i) for t, i in self.ranks.items() for k in range(1, len(t)))
        self.pairs = Pairs({(a, b): i for a, b, i in pairs if a is not None and b is not None})
        self.memo = Remembered(MEMO_BITS, MEMO_TEXT)
        self._forget()

    def _forget(self) -> None:
        self.memo.forget()
        self.memo_at = np.zeros(1 << MEMO_BITS, np.int64)
        self.memo_n = np.zeros(1 << MEMO_BITS, np.int64)
        self.arena = np.zeros(ARENA, np.uint32)
        self.filled = 0

    def tokens(self, keys: np.ndarray, room: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of the token that has the bytes of each piece, -1 for pieces that are none."""
        item = self.hash.find(keys)
        item[self.size[item] != sizes] = -1
        may = np.flatnonzero(item >= 0)
        item[may[~same_bytes(self.room, self.start[item[may]], room, starts[may], sizes[may])]] = -1
        return item

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the heap gives the lowest-ranked pair, leftmost first."""
        get, n = self.ranks.get, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        shift = n.bit_length()
        mask = (1 << shift) - 1
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n))
        best = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the pair that begins here
        best[n - 1] = -1
        heap = [r << shift | i for i, r in enumerate(best) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & mask
            if best[i] != top >> shift:
                continue
            j = after[i]  # the part at j goes into the part at i
            end = after[i] = after[j]
            best[j] = -1
            if end < n:
                before[end] = i
                best[i] = r = get(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                best[h] = r = get(piece[h:end], -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(get(piece[i:j]))
            i = j
        return out

    def merge_all(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, ids per piece), by heaps of equal width side by side."""
        size = ends - starts
        n = np.zeros(len(starts), np.int64)
        done, low = [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            if len(rows):
                ids, n[rows] = self._merge_side_by_side(buf, starts[rows], size[rows], width)
                done.append((rows, ids))
            low = width
        rows = np.flatnonzero(size > low)
        if len(rows):
            parts = [self.merge(buf[a:b].tobytes()) for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
            n[rows] = [len(x) for x in parts]
            done.append((rows, np.fromiter((x for p in parts for x in p), np.uint32)))
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        for rows, ids in done:
            k = n[rows]
            out[np.repeat(at[rows] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, n

    def _merge_side_by_side(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short pieces at once.

        Each piece has a row of ``width`` bytes linked by ``after`` and ``before``
        and a tournament heap over the ranks of its pairs, whose leaves are
        updated in place: every round merges the pair at each heap's root.
        """
        rows = len(starts)
        col = np.arange(width)
        valid = col < size[:, None]
        part = self.byte_id[buf[np.minimum(starts[:, None] + col, len(buf) - 1)]]
        part = part.ravel()
        alive = valid.ravel().copy()
        after = np.tile(col + 1, rows)
        before = np.tile(col - 1, rows)
        leaf = np.full(rows * width, _NONE)

        def rank(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Leaf of the pair of parts that begin at a and b."""
            found = self.pairs.find(part[row * width + a], part[row * width + b])
            return np.where(found >= 0, found << 6 | a, _NONE)

        row, a = np.nonzero(col + 1 < size[:, None])
        leaf[row * width + a] = rank(row, a, a + 1)
        row = np.arange(rows)
        while len(row):
            heap = leaf.reshape(rows, width)[row] if len(row) < rows else leaf.reshape(rows, width)
            while heap.shape[1] > 1:
                heap = np.minimum(heap[:, ::2], heap[:, 1::2])
            root = heap[:, 0]
            more = root != _NONE
            row, root = row[more], root[more]
            base = row * width
            i = root & 63
            j = after[base + i]
            end = after[base + j]
            after[base + i] = end
            part[base + i] = root >> 6
            alive[base + j] = False
            leaf[base + j] = leaf[base + i] = _NONE
            inner = np.flatnonzero(end < size[row])
            r, x, e = row[inner], i[inner], end[inner]
            before[r * width + e] = x
            leaf[r * width + x] = rank(r, x, e)
            h = before[base + i]
            inner = np.flatnonzero(h >= 0)
            r, x = row[inner], h[inner]
            leaf[r * width + x] = rank(r, x, i[inner])
        return part[alive].astype(np.uint32), alive.reshape(rows, width).sum(1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids per text)."""
        starts = pieces.split(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        sizes, room = ends - starts, padded(buf)
        keys = self.hashing.words(buf, starts, ends)
        item = self.tokens(keys, room, starts, sizes)
        known = item >= 0
        n = np.ones(len(keys), np.int64)
        at = np.zeros(len(keys), np.int64)
        out_of = np.flatnonzero(~known)
        if len(out_of):
            slot = self.memo.find(keys[out_of], room, starts[out_of], sizes[out_of])
            at[out_of], n[out_of] = self.memo_at[slot], self.memo_n[slot]
            missed = out_of[slot < 0]
            if len(missed):
                rows, which = distinct(keys[missed], room, starts[missed], sizes[missed])
                new = missed[rows]
                merged, own = self.merge_all(buf, starts[new], ends[new])
                if self.filled + len(merged) > len(self.arena) or self.memo.filled + int(sizes[new].sum()) > self.memo.room:
                    if self.filled:
                        self._forget()
                        return self.encode(buf, offsets)
                    if len(merged) > len(self.arena):
                        self.arena = np.zeros(len(merged), np.uint32)
                self.arena[self.filled : self.filled + len(merged)] = merged
                where = self.filled + np.cumsum(own) - own
                self.filled += len(merged)
                at[missed], n[missed] = where[which], own[which]
                slot = self.memo.put(keys[new], room, starts[new], sizes[new])
                stays = slot >= 0
                self.memo_at[slot[stays]], self.memo_n[slot[stays]] = where[stays], own[stays]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(int(total[-1]), np.uint32)
        ids[total[:-1][known]] = self.ids[item[known]]
        if len(out_of):
            k = n[out_of]
            inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            ids[np.repeat(total[out_of], k) + inner] = self.arena[np.repeat(at[out_of], k) + inner]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, once per worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids (array of int) of every text; null reads as empty, empty has no ids."""
    return _mapped(docs, path, text, keep, with_ids=True)


def digest(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every text.

    Null reads as empty; repeated rows stay; an empty table gives an empty result.
    Columns beyond ``keep`` are dropped.
    """
    return _mapped(docs, path, text, keep, with_ids=False)


def _mapped(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], with_ids: bool) -> DataFrame:
    part = docs.select(*keep, docs[text].alias("_text"))
    schema = part.drop("_text").schema
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text", BLOCK):
                ids, n = c.encode(buf, offsets)
                ends = np.cumsum(n)
                kept = [rows.column(k) for k in keep]
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keep, "ids"])
                    continue
                each = [ids[a:b] for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in each])],
                    names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return part.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text of every list of ids; null ids read as none, bytes that are no UTF-8 become U+FFFD."""
    part = encoded.select(*keep, encoded[ids].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return part.mapInArrow(run, part.drop("_ids").schema.add("text", "string"))
