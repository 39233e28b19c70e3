"""Which of many short probes each text contains, in one pass over the texts.

Windows of a text are looked up in two tables of fixed size, made by Spark from
all probes and broadcast: one tells for the first ``LEAST`` bytes of a window how
long the probes are that begin so, the other whether a window of that length
hashes like a probe. What passes both is emitted as it stands and joined with the
probes as a string, so the result is exact whatever the tables let through, and
no text and no common word is ever shuffled. More probes than the tables have
places for only mean that more windows reach the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: shortest and longest probe
LEAST, MOST = 12, 60
#: places of the tables, as powers of two: lengths by first bytes (eight bytes each), and bits by whole windows
PLACES = (20, 24)
#: bytes looked at together
STEP = 1 << 20
_A, _B = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_UPTO = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; zeros follow the data."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[:-8] = data
    return np.ndarray(len(data), "<u8", room, strides=(1,)).copy()


def _firsts(eights: np.ndarray) -> np.ndarray:
    """Hash of the ``LEAST`` bytes from every place on (the last places have fewer)."""
    rest = np.zeros_like(eights)
    rest[:-8] = eights[8:] & _UPTO[LEAST - 8]
    return _mixed(_mixed(eights) + rest)


def _wholes(eights: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from places on."""
    out = np.full(len(at), np.uint64(size))
    for k in range(0, size, 8):
        out = _mixed((out ^ (eights[at + k] & _UPTO[min(8, size - k)])) + _A)
    return out


def _low(x: np.ndarray, bits: int) -> np.ndarray:
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def _tables(probes: DataFrame, places: tuple[int, int] = PLACES) -> Broadcast:
    """The two tables for ``probes``, a column ``probe``. At most 2**20 + 2**18 rows come to the driver."""
    first, whole = places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                eights = _eights(data)
                bit = int(_low(_wholes(eights, np.zeros(1, np.int64), len(data)), whole)[0])
                slots = [int(_low(_firsts(eights)[:1], first)[0]), (1 << first) + (bit >> 6)]
                bits = np.array([1 << (len(data) - LEAST), 1 << (bit & 63)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(bits)], names=["slot", "bits"])

    got = probes.select("probe").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    both = np.zeros((1 << first) + (1 << (whole - 6)), np.int64)
    both[np.asarray(got.column("slot"), np.int64)] = np.asarray(got.column("bits"), np.int64)
    return probes.sparkSession.sparkContext.broadcast(both.view(np.uint64))


def _windows(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray, places: tuple[int, int] = PLACES, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, place, length) of windows that both tables let through; of equal windows of a text one in each step."""
    lengths, bits = tables[: 1 << places[0]], tables[1 << places[0] :]
    for begin in range(0, len(data), step):
        part = data[begin : begin + step + MOST]
        eights = _eights(part)
        may = lengths[_low(_firsts(eights), places[0])]
        at = np.flatnonzero(may[:step])
        may = may[at]
        text = np.searchsorted(offsets, at + begin, "right") - 1
        room = offsets[text + 1] - begin - at
        for size in range(LEAST, MOST + 1):
            go = np.flatnonzero((may >> np.uint64(size - LEAST) & np.uint64(1)).astype(bool) & (room >= size))
            if len(go):
                whole = _wholes(eights, at[go], size)
                low = _low(whole, places[1])
                hit = bits[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1) == 1
                go, whole = go[hit], whole[hit]
                _, one = np.unique(np.stack([text[go].astype(np.uint64), whole]), axis=1, return_index=True)
                yield text[go[one]], at[go[one]] + begin, size


def contained(texts: DataFrame, text: str, probes: DataFrame, places: tuple[int, int] = PLACES, step: int = STEP) -> DataFrame:
    """``texts`` without the column ``text``, with ``probe``: one row for each distinct probe that a row's text contains.

    ``probes`` has a column probe: strings of ``LEAST`` to ``MOST`` ASCII characters.
    Texts and probes are compared byte by byte. Null texts contain nothing.
    """
    asked = probes.select("probe").where(F.length("probe").between(LEAST, MOST)).distinct()
    tables = _tables(asked, places)
    kept = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            found = set()
            for row, at, size in _windows(data, offsets - offsets[0], tables.value, places, step):
                found.update((r, data[a : a + size].tobytes()) for r, a in zip(row.tolist(), at.tolist()))
            if found:
                rows, strings = zip(*sorted(found))
                out = batch.select(kept).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([s.decode("utf-8", "replace") for s in strings])], names=[*kept, "probe"])

    schema = texts.select(*kept).schema.add("probe", "string")
    return texts.select(*kept, text).mapInArrow(run, schema).join(asked, "probe")
