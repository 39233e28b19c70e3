"""Vectorised pre-tokenisation for byte-level BPE.

Splits UTF-8 bytes as the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

does, from runs of equal character class and three local rules: a last plain
space joins the run after it, any other last white space stands alone, and an
apostrophe that begins a piece takes a contraction's letters.
"""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
#: code points with the Unicode property White_Space
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_table: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, made once per worker."""
    global _table
    if _table is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                if a < 0xD800 < b:
                    table[a:0xD800] = kind
                    a = 0xD800
                shift = 0x800 if a >= 0xD800 else 0
                table[a + shift : b + shift] = kind
        table[_WHITE] = SPACE
        _table = table
    return _table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = classes()
    kind = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int64)
        at = np.minimum(lead[:, None] + np.arange(1, 4), len(buf) - 1)
        c1, c2, c3 = (buf[at[:, k]].astype(np.int64) & 0x3F for k in range(3))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = np.where(size == 2, (b0 & 0x1F) << 6 | c1, np.where(size == 3, (b0 & 0x0F) << 12 | c1 << 6 | c2, (b0 & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        of = table[np.minimum(code, 0x10FFFF)]
        kind[lead] = of
        for k in range(1, 4):
            more = size > k
            kind[lead[more] + k] = of[more]
    return kind


def split(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts in ``buf``; no piece crosses an offset."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(buf)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut |= begin
    # white space before anything else of the same text
    b = np.flatnonzero(cut[1:n] & ~begin[1:n] & (kind[: n - 1] == SPACE)) + 1
    plain = buf[b - 1] == 0x20
    cut[b[plain]] = False
    cut[b[plain] - 1] = True
    rest = b[~plain]
    last = rest - 1
    for _ in range(3):  # back to the first byte of the last character
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    cut[last] = True
    # contractions
    q = np.flatnonzero((buf[: n - 1] == 0x27) & cut[: n - 1] & ~begin[1:n])
    if len(q):
        one = buf[q + 1]
        two = buf[np.minimum(q + 2, n - 1)]
        inside = (q + 2 < n) & ~begin[np.minimum(q + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        cut[q[short | long] + 1] = False
        cut[q[short] + 2] = True
        cut[q[long] + 3] = True
    return np.flatnonzero(cut[:n])
