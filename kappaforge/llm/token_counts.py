"""Token counts with overlap resynchronisation for huge documents.

Texts are split into the pieces that the tokenizer merges separately. The
tokenizers library counts each distinct piece once; a bounded table remembers
the counts with the pieces' bytes. Special strings of the tokenizer are one
token each, and what stands between them is counted by itself.

A document longer than ``chunk`` bytes is encoded as overlapping chunks with
offsets. Neighbours are spliced at a position inside their overlap where both
have a boundary that no context can move: a single space between two ASCII
letters, where a new piece begins whatever else stands around it, and both
chunks have equal pieces and counts on its two sides. If there is no such
position, the chunk is encoded again with twice the overlap, up to the whole
rest of the document. Counts equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kappaforge.llm import pieces
from kappaforge.llm.words import Hash, Remembered, blocks, byte_table, distinct, padded

CHUNK, OVERLAP, AGREE = 1 << 16, 256, 2
MEMO_BITS, MEMO_TEXT = 20, 1 << 24
BLOCK = 1 << 19
_LETTER = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])


class Counter:
    """Token counts of one byte-level tokenizer.json file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added if t.content]
        #: whether special strings take nothing of the text around them, so that a text may be cut there
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added) and self.library.normalizer is None
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.hashing = Hash(81)
        self.memo = Remembered(MEMO_BITS, MEMO_TEXT)
        self.count = np.zeros(1 << MEMO_BITS, np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of every piece, its number of tokens)."""
        starts = pieces.split(buf, offsets)
        if not len(starts):
            return starts, np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(buf))
        keys, room, sizes = self.hashing.words(buf, starts, ends), padded(buf), ends - starts
        slot = self.memo.find(keys, room, starts, sizes)
        counts = self.count[slot]
        missed = np.flatnonzero(slot < 0)
        if len(missed):
            rows, which = distinct(keys[missed], room, starts[missed], sizes[missed])
            new = missed[rows]
            text = buf.tobytes()
            got = self.library.encode_batch_fast([text[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())], add_special_tokens=False)
            n = np.fromiter(map(len, got), np.int64, len(got))
            counts[missed] = n[which]
            if self.memo.filled + int(sizes[new].sum()) > self.memo.room:
                self.memo.forget()
            slot = self.memo.put(keys[new], room, starts[new], sizes[new])
            self.count[slot[slot >= 0]] = n[slot >= 0]
        return starts, counts

    def totals(self, buf: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Tokens of every text."""
        size = np.diff(offsets)
        out = np.zeros(len(size), np.int64)
        huge = np.flatnonzero(size > chunk).tolist()
        for a, b in zip([-1, *huge], [*huge, len(size)]):  # the texts between huge ones
            own = offsets[a + 1 : b + 1] - offsets[a + 1]
            starts, counts = self.encode(buf[offsets[a + 1] : offsets[b]], own)
            out[a + 1 : b] = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, own)])
        for d in huge:
            out[d] = count_spliced(self, buf[offsets[d] : offsets[d + 1]], chunk, overlap)
        text = buf.tobytes()
        if self.cut.search(text):
            for d in range(len(size)):
                own = text[offsets[d] : offsets[d + 1]]
                if self.cut.search(own):
                    out[d] = self._around(own, chunk, overlap) if self.plain else len(self.library.encode(own.decode("utf-8", "replace"), add_special_tokens=False))
        return out

    def _around(self, text: bytes, chunk: int, overlap: int) -> int:
        """Tokens of a text with special strings: the leftmost, of those the longest, count one each."""
        between, special = self.cut.split(text), len(self.cut.findall(text))
        ends = np.cumsum([len(x) for x in between])
        return special + int(self.totals(np.frombuffer(b"".join(between), np.uint8), np.append(0, ends), chunk, overlap).sum())


def _cut(buf: np.ndarray, at: int) -> int:
    """``at``, or the first byte of the character there."""
    while 0 < at < len(buf) and buf[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _splice(buf: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], low: int, high: int, done: int) -> tuple[int, int] | None:
    """(pieces of left, pieces of right) before the middle-most proven boundary in [low, high), if any."""
    both, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    fits = (both > low) & (both < high - 1) & (i >= max(done, AGREE)) & (j >= AGREE) & (i + AGREE < len(left[0])) & (j + AGREE < len(right[0]))
    both, i, j = both[fits], i[fits], j[fits]
    stable = (buf[both] == 0x20) & _LETTER[buf[both - 1]] & _LETTER[buf[both + 1]]
    for k in sorted(np.flatnonzero(stable).tolist(), key=lambda x: abs(both[x] - (low + high) // 2)):
        a, b = slice(i[k] - AGREE + 1, i[k] + AGREE), slice(j[k] - AGREE + 1, j[k] + AGREE)
        if np.array_equal(left[0][a], right[0][b]) and np.array_equal(left[1][a], right[1][b]):
            return int(i[k]), int(j[k])
    return None


def count_spliced(counter: Counter, buf: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, from overlapping chunks."""
    n = len(buf)

    def encode(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        starts, counts = counter.encode(buf[a:b], np.array([0, b - a]))
        return starts + a, counts

    at, end = 0, _cut(buf, min(chunk, n))
    left, done, total = encode(at, end), 0, 0  # pieces of ``left`` already counted
    while end < n:
        wide = overlap
        while True:
            right_at = _cut(buf, max(at, end - wide))
            if right_at <= at:  # the overlap is the whole chunk: encode it again with what follows
                end = _cut(buf, min(n, end + max(chunk, end - at)))
                left = encode(at, end)
                break
            right_end = _cut(buf, min(n, right_at + max(chunk, 2 * wide)))
            right = encode(right_at, right_end)
            if found := _splice(buf, left, right, right_at, end, done):
                total += int(left[1][done : found[0]].sum())
                left, at, end, done = right, right_at, right_end, found[1]
                break
            wide *= 2
    return total + int(left[1][done:].sum())


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, once per worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay repeated;
    an empty table gives an empty result. Columns beyond ``keep`` are dropped, so
    clashing names do not matter. Special strings in texts are handled as the
    tokenizer file says; no tokens are added around a text.
    """
    part = docs.select(*keep, docs[text].alias("_text"))
    schema = part.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text", BLOCK):
                n = c.totals(buf, offsets, chunk, overlap)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return part.mapInArrow(run, schema)
