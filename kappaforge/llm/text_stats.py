"""Per-document counts over blocks of text, vectorised."""

from __future__ import annotations

import numpy as np

from kappaforge.llm.words import NON_SPACE, U, Hash, byte_table, mix, spans, window_starts

_WORD, _LINE, _SEQ = Hash(21), Hash(22), Hash(23)
_SYMBOLS = byte_table(b"#*$%&|<>")
_UPPER = byte_table(range(0x41, 0x5B))
_DIGIT = byte_table(range(0x30, 0x3A))
_PUNCT = byte_table([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_STOP = byte_table(b".!?")
_LEAD = byte_table([*range(0x80), *range(0xC0, 0x100)])  # first bytes of code points
_HIGH = byte_table(range(0xC0, 0x100))
REPEAT_WORDS = 5


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between documents."""
    return mix(keys + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def repeated(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of words inside a window of five words that its document has twice or more."""
    at, doc = window_starts(first, REPEAT_WORDS)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        keys = _own(_SEQ.slices(_WORD.words(buf, starts, ends), at, at + REPEAT_WORDS), doc)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WORDS, -1)
    return np.cumsum(covered[:-1]) > 0


def duplicate_lines(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and lines with a word."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin = np.zeros(len(buf) + 1, bool)
    begin[offsets] = True
    newline = np.flatnonzero(buf == 0x0A)
    begin[newline + 1] = True
    at = np.flatnonzero(begin[:-1])
    end = np.append(at[1:], len(buf))
    end = np.where(buf[end - 1] == 0x0A, end - 1, end)
    with_word = np.searchsorted(starts, end) > np.searchsorted(starts, at)
    at, end = at[with_word], end[with_word]
    doc = np.searchsorted(offsets, at, "right") - 1
    lines = np.bincount(doc, minlength=n)
    _, one = np.unique(_own(_LINE.words(buf, at, end), doc), return_index=True)
    return lines - np.bincount(doc[one], minlength=n), lines


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words per document."""
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    again = repeated(buf, starts, ends, first)
    dup, _ = duplicate_lines(buf, offsets, starts)
    return {
        "n_words": np.diff(first),
        "word_chars": per_doc(_LEAD[buf] & NON_SPACE[buf], offsets),
        "n_symbols": per_doc(_SYMBOLS[buf], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": per_doc(again, first),
    }


FEATURES = (
    "log_words", "word_len", "long_words", "short_words", "symbols", "upper", "upper_words", "digits", "punct", "exclaim", "bars", "high", "stops", "newlines",
    "dup_lines", "repeat", "distinct_words", "line_words", "marked_words", "capital_words",
)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A float32 row of FEATURES per document; empty texts get zeros."""
    n = len(offsets) - 1
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    words = np.diff(first)
    size = np.maximum(np.diff(offsets), 1)
    some = np.maximum(words, 1)
    length = ends - starts
    doc = np.repeat(np.arange(n), words)
    dup, lines = duplicate_lines(buf, offsets, starts)
    hashes = _WORD.words(buf, starts, ends)
    _, one = np.unique(_own(hashes, doc), return_index=True)
    head, tail = buf[starts], buf[ends - 1]
    second = buf[np.minimum(starts + 1, max(len(buf) - 1, 0))]
    share = lambda flags: per_doc(flags, offsets) / size
    of_words = lambda flags: per_doc(flags, first) / some
    columns = [
        np.log1p(words), per_doc(length, first) / some, of_words(length > 12), of_words(length <= 3), share(_SYMBOLS[buf]), share(_UPPER[buf]), of_words(_UPPER[head] & _UPPER[second] & (length > 1)), share(_DIGIT[buf]), share(_PUNCT[buf]),
        share(buf == 0x21), share(buf == 0x7C), share(_HIGH[buf]), share(_STOP[buf]) * size / some, share(buf == 0x0A) * size / some, dup / np.maximum(lines, 1), per_doc(repeated(buf, starts, ends, first), first) / some,
        np.bincount(doc[one], minlength=n) / some, words / np.maximum(lines, 1), of_words(_SYMBOLS[tail] | _SYMBOLS[head]), of_words(_UPPER[head]),
    ]
    return np.stack(columns, 1).astype(np.float32)
