"""Near-duplicate detection with ProbMinHash.

Texts are weighted sets of five-word shingles, weight 1 + ln(occurrences).
ProbMinHash: a shingle of weight w arrives as a Poisson process of rate w; each
arrival falls on a random register, and a shingle stops as soon as its next
arrival is later than the latest register. Two texts agree in a register with
probability equal to their probability Jaccard. Registers are banded; texts of
a band's bucket are candidates, verified on their shingles. A link needs a
probability Jaccard, or a plain Jaccard (which it equals where no shingle
repeats), of ``SIMILARITY`` or more. As the two differ widely where one text
repeats a line, texts with repeated shingles also have the bands of weight 1.

Buckets are not expanded into pairs. Equal texts are one node. In every bucket
each member meets a leader, for ``STAR_ROUNDS`` rounds with another leader,
first the most central member: that whose buckets hold most texts. What is then
left, the members of buckets that still hold several components, goes through
an exact prefix join: two linked texts lack so little of each other that the
first shingle they share, rare ones first, stands near the beginning of both.
So texts alike only by common passages never meet, whatever a bucket's size.

Before any text is looked at, a pair must pass a bound that no link fails:
the parity bits of two texts' shingles (``Sketch``) differ in no more places
than their sets do. Verification ships each text of a pair once, and a leader's
text once for ``LED`` of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.llm.components import components
from kappaforge.llm.store import dropped, release, unused, written
from kappaforge.llm.words import NON_SPACE, Hash, U, blocks, mix, spans, window_starts

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, BANDS = 96, 24
STAR_ROUNDS = 3
#: longs of a text's parity bits
SKETCH = 16
#: slots of the table that orders shingles, and pairs of one leader in a task
SLOTS, LED = 1 << 18, 200
_WORD, _SHINGLE = Hash(91), Hash(92)
_STEP = U(0xA0761D6478BD642F)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with weights; a text of one to four words is one shingle."""
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    words = _WORD.words(buf, starts, ends)
    at, doc = window_starts(first, SHINGLE)
    keys = _SHINGLE.slices(words, at, at + SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    keys = np.append(keys, _SHINGLE.slices(words, first[short], first[short + 1]))
    doc = np.append(doc, short)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    one = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[: len(keys)])
    count = np.diff(np.append(one, len(keys)))
    return doc[one], keys[one], 1 + np.log(count)


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers of ``n`` texts: the shingle that arrived first in each."""
    time = np.full(n * REGISTERS, np.inf)
    out = np.zeros(n * REGISTERS, np.uint64)
    at, arrivals = np.zeros(len(key)), 0
    while len(key):
        batch = int(np.clip(8192 // len(key), 1, 64))
        x = mix(key[:, None] + np.arange(arrivals + 1, arrivals + batch + 1).astype(np.uint64) * _STEP)
        arrivals += batch
        gap = -np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        when = at[:, None] + np.cumsum(gap, 1) / weight[:, None]
        register = doc[:, None] * REGISTERS + (mix(x) % U(REGISTERS)).astype(np.int64)
        at = when[:, -1]
        when, register = when.ravel(), register.ravel()
        np.minimum.at(time, register, when)
        won = time[register] == when
        out[register[won]] = np.repeat(key, batch)[won]
        latest = time.reshape(n, REGISTERS).max(1)
        go = at < latest[doc]
        doc, key, weight, at = doc[go], key[go], weight[go], at[go]
    return out.reshape(n, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band, different between bands."""
    rows = registers.reshape(len(registers), BANDS, -1)
    keys = np.broadcast_to(np.arange(1, BANDS + 1).astype(np.uint64) * _STEP, rows.shape[:2])
    for k in range(rows.shape[2]):
        keys = mix(keys ^ rows[:, :, k])
    return keys.view(np.int64)


def candidate_keys(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct band keys of ``n`` texts, and where each text's begin.

    Where no shingle repeats, the registers of weight 1 are the same; other texts
    have the keys of both. One space of keys serves both, so that all texts meet.
    """
    keys = band_keys(signatures(doc, key, weight, n))
    own = np.ones((n, 2 * BANDS), bool)
    own[:, BANDS:] = False
    both = np.concatenate([keys, keys], 1)
    repeats = np.unique(doc[weight > 1])
    if len(repeats):
        some = np.isin(doc, repeats)
        plain = band_keys(signatures(np.searchsorted(repeats, doc[some]), key[some], np.ones(some.sum()), len(repeats)))
        both[repeats, BANDS:] = plain
        own[repeats, BANDS:] = plain != keys[repeats]
    return both[own], np.append(0, np.cumsum(own.sum(1)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard of two weighted sets (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    union = len(a[0]) + len(b[0]) - len(i)
    wa, wb = np.zeros(union), np.zeros(union)
    wa[: len(a[0])] = a[1]
    wb[i] = b[1][j]
    wb[len(a[0]) :] = np.delete(b[1], j)
    ratio, which = np.unique(np.round(a[1][i] / b[1][j], 12), return_inverse=True)
    total = np.array([np.maximum(wa, r * wb).sum() for r in ratio])
    return max(float((a[1][i] / total[which]).sum()), len(i) / union)


def _node(text: bytes) -> bytes | None:
    """Sixteen bytes for the word sequence; none for a text without words."""
    words = text.split()
    return hashlib.sha256(b" ".join(words)).digest()[:16] if words else None


def with_nodes(docs: DataFrame, text: str = "text", bands: bool = True, names: tuple[str, str] = ("node", "bands")) -> DataFrame:
    """``docs`` with the node and, if wanted, the bands of every text, in columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, text):
                raw = buf.tobytes()
                nodes = pa.array([_node(raw[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
                extra = [nodes]
                if bands:
                    keys, begin = candidate_keys(*shingles(buf, offsets), rows.num_rows)
                    extra.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys)))
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, *names][: len(rows.columns) + len(extra)])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.BinaryType())])
    if bands:
        schema.add(names[1], T.ArrayType(T.LongType()))
    return docs.mapInArrow(run, schema)


def sketches(docs: DataFrame, text: str = "_text") -> DataFrame:
    """``docs`` with node, sketch (parity bits), size (distinct shingles) and weight of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, text):
                raw, n = buf.tobytes(), rows.num_rows
                nodes = pa.array([_node(raw[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
                doc, key, weight = shingles(buf, offsets)
                extra = [nodes, _longs(parity(doc, key, n)), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(np.bincount(doc, weight, n))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "node", "sketch", "size", "weight"])

    schema = T.StructType([*docs.schema.fields, *_fields("node binary, sketch array<long>, size long, weight double")])
    return docs.mapInArrow(run, schema)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _longs(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def parity(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """``SKETCH`` longs a text: bit k is the parity of its shingles that fall on k.

    A shingle of one text only flips one bit, so two texts' bits differ in at most
    as many places as their sets have elements that are not shared.
    """
    bits = SKETCH * 64
    odd = np.bincount(doc * bits + (mix(key ^ _STEP) % U(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def unshared(size_a: Column, weight_a: Column, size_b: Column, weight_b: Column) -> Column:
    """The most shingles that two linked texts may not share.

    A plain Jaccard of t leaves (1 - t) / (1 + t) of both sizes. Where a shingle
    repeats, let a and b be the shares of weight that each text has alone: the
    probability Jaccard is at most (1 - a)(1 - b) / (1 - ab), and as a shingle
    weighs 1 at least, a * weight_a + b * weight_b bounds their number.
    """
    t = SIMILARITY
    plain = (size_a + size_b) * ((1 - t) / (1 + t))
    weighted = weight_a + weight_b - F.pow(F.sqrt(weight_a) + F.sqrt(weight_b), 2) / (1 + 1 / t)
    repeats = (weight_a > size_a + 1e-9) | (weight_b > size_b + 1e-9)
    return F.when(repeats, F.greatest(plain, weighted)).otherwise(plain) + 1e-6


def _may_link(a: str, b: str) -> Column:
    """No pair with a link fails it. ``a`` and ``b`` have sketch, size and weight."""
    x, y = (lambda name, side=side: F.col(f"{side}.{name}") for side in (a, b))
    differ = sum((F.bit_count(x("sketch")[k].bitwiseXOR(y("sketch")[k])) for k in range(1, SKETCH)), F.bit_count(x("sketch")[0].bitwiseXOR(y("sketch")[0])))
    return F.greatest(differ, F.abs(x("size") - y("size"))) <= unshared(x("size"), x("weight"), y("size"), y("weight"))


def prefixes(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, shingles before it, share of weight before it) of the beginnings of ``n`` texts.

    Shingles are in one order for all texts: by the count of their slot, then by
    hash. Two linked texts have 1 - t of their shingles, or of their weight, alone
    at most, and all that stand before the first shared one are alone.
    """
    order = np.lexsort((key, counts[(mix(key) % U(len(counts))).astype(np.int64)], doc))
    doc, key, weight = doc[order], key[order], weight[order]
    begin = np.searchsorted(doc, np.arange(n + 1))
    before = np.arange(len(doc)) - begin[doc]
    size = np.diff(begin)
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    share = (upto[:-1] - upto[begin[doc]]) / (upto[begin[doc + 1]] - upto[begin[doc]])
    go = np.minimum(before / size[doc], share) <= 1 - SIMILARITY + 1e-9
    return doc[go], key[go], before[go], np.maximum(share[go], 0.0)


def _slots(texts: DataFrame) -> np.ndarray:
    """How many shingles of ``texts`` fall on each of ``SLOTS`` slots: a table of fixed size, for the order of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, buf, offsets in blocks(batch, "text"):
                total += np.bincount((mix(shingles(buf, offsets)[1]) % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[np.asarray(got.column("slot"), np.int64)] = np.asarray(got.column("n"), np.int64)
    return counts


def _beginnings(texts: DataFrame) -> DataFrame:
    """(shingle, node, before, share) of the prefixes of ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(_slots(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "text"):
                doc, key, before, share = prefixes(*shingles(buf, offsets), rows.num_rows, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows.column("node").take(pa.array(doc)), pa.array(before), pa.array(share)], names=["shingle", "node", "before", "share"])

    return texts.select("node", "text").mapInArrow(run, "shingle long, node binary, before long, share double")


def _shares_enough() -> Column:
    """Whether two texts, x and y, whose first common shingle may be this one can be linked."""
    t = SIMILARITY
    most = F.least(F.col("x.size") - F.col("x.before"), F.col("y.size") - F.col("y.before"))
    plain = most * (1 + t) >= (F.col("x.size") + F.col("y.size")) * t - 1e-6
    a, b = F.col("x.share"), F.col("y.share")
    repeats = (F.col("x.weight") > F.col("x.size") + 1e-9) | (F.col("y.weight") > F.col("y.size") + 1e-9)
    return plain | (repeats & ((1 - a) * (1 - b) >= (1 - a * b) * t - 1e-6))


def _by_prefix(nodes: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``nodes`` (node, label, text) with different labels that may be linked."""
    begin = _beginnings(nodes).join(nodes.select("node", "label"), "node")
    begin = written(begin, "prefixes")
    sizes = begin.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    # a shingle whose texts are all of one component is done; its largest component only meets the rest
    most = sizes.groupBy("shingle").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most"))
    most = written(most.where("labels > 1").select("shingle", F.col("most.label").alias("largest")), "mixed")
    open_ = written(begin.join(most, "shingle").join(light, "node"), "beginnings")
    x, y = open_.where("label <> largest").alias("x"), open_.alias("y")
    found = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & _shares_enough() & _may_link("x", "y"))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough.

    A task reads the text of ``a`` once, then those of up to about ``LED`` of its b.
    """
    # the pairs of a text that leads many go to several tasks
    led = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts")), "led")
    own = pairs.join(led, "a").join(texts.select(F.col("node").alias("b"), "text"), "b")
    own = own.select("a", F.pmod(F.hash("b"), "parts").alias("part"), "b", "text")
    lead = led.join(texts.select(F.col("node").alias("a"), "text"), "a")
    lead = lead.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "text")
    # nulls first: the leader stands before those it leads
    both = lead.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(text.encode(), np.uint8)
        return shingles(buf, np.array([0, len(buf)]))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            b, text = batch.column("b"), batch.column("text")
            for k in range(batch.num_rows):
                if b[k].is_valid:
                    ok[k] = similarity(leader, weighted(text[k].as_py())) >= SIMILARITY
                else:
                    leader = weighted(text[k].as_py())
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components that ``links`` join became one."""
    label_a, label_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
    joined = components(links.join(label_a, "a").join(label_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return written(labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _candidates(part: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, text, sketch, size and weight: one text for every node that has a candidate at all."""
    wanted = members.select("node").distinct().join(nodes.select("node", "first_id"), "node").select(F.col("first_id").alias("doc_id"), F.col("node").alias("wanted"))
    # an equi-join finds no null ids; rows that have none are found by their node below
    own = part.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(part.where("doc_id is null"))
    found = sketches(own)
    found = found.join(wanted, (found.node == wanted.wanted) & found.doc_id.eqNullSafe(wanted.doc_id))
    return found.groupBy("node").agg(F.first("_text").alias("text"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("weight").alias("weight"))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, node and class_node of every row, as a written table; rows of one class_node are near copies.

    A row whose text is null or has no words is alone and has a null node.
    """
    spark = docs.sparkSession
    part = docs.select("doc_id", F.col(text).alias("_text"))
    rows = written(with_nodes(part, "_text").select("doc_id", "node", "bands"), "signatures")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    exploded = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    whole = written(exploded.join(shared, "bucket"), "buckets")
    # a text that many others are near to shares more and larger buckets than they do with each other
    central = written(whole.groupBy("node").agg(F.sum("n").alias("central")), "central")
    members = whole.drop("n")
    release(spark)
    texts = written(_candidates(part, nodes, members), "texts")
    light = texts.drop("text")
    release(spark)

    labels = central.select("node", F.col("node").alias("label"))
    tested = None
    for turn in range(STAR_ROUNDS + 1):
        # what members of buckets of several components are left; read from files, so that large buckets can be split
        mixed = members.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        now = members.join(written(mixed.select("bucket"), "mixed"), "bucket").join(labels, "node")
        if turn < STAR_ROUNDS:
            ranked = now.join(central, "node").withColumn("o", -F.col("central")) if not turn else now.withColumn("o", F.xxhash64("node", F.lit(turn)))
            lead = written(ranked.groupBy("bucket").agg(F.min(F.struct("o", F.col("node").alias("node"), "label")).alias("lead")), "leaders")
            pairs = now.join(lead, "bucket").where("label <> lead.label").select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
            x, y = light.alias("x"), light.alias("y")
            pairs = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_may_link("x", "y")).select("a", "b")
        else:
            left = now.select("node", "label").distinct()
            pairs = _ordered(_by_prefix(left.join(texts.select("node", "text"), "node"), light))
        if tested is not None:
            key = (F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
            pairs = pairs.withColumns({"low": key[0], "high": key[1]}).join(tested, ["low", "high"], "left_anti").select("a", "b")
        pairs = written(pairs, "pairs")
        done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tested = done if tested is None else tested.unionByName(done)
        links = written(_verified(pairs, texts), "verified")
        if links.take(1):
            labels = _merged(labels, links)
        release(spark)
    found = rows.select("doc_id", "node").join(labels.withColumnRenamed("label", "class_node"), "node", "left")
    found = written(found.select("doc_id", "node", F.coalesce("class_node", "node").alias("class_node")), "classes")
    dropped(rows, whole, central, texts)
    release(spark)
    return found


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its near copies, itself included) of every row.

    Texts without words, and null texts, are alone; a row without a doc_id takes
    the class of its copies if one of them has a doc_id. Repeated rows stay, and
    an empty table gives an empty result. Other columns are not read.
    """
    found = classes(docs, text)
    ids = found.where("class_node is not null").groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    ids = written(ids, "ids")  # beside a table that is read, the rows of a large class can be split
    return found.join(ids, "class_node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("class_size"))


def first_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, all columns unchanged, of every class: that with the smallest doc_id.

    Texts without words all stay; of repeated rows one stays. Columns may have any names.
    """
    found = classes(docs, text)
    stay = found.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("s"))
    own_node, first_id, first_node = unused(docs.columns, "node", "first_id", "first_node")
    stay = stay.select(F.col("s.doc_id").alias(first_id), F.col("s.node").alias(first_node))
    own = with_nodes(docs, text, bands=False, names=(own_node, ""))
    none = own.where(F.col(own_node).isNull()).select(*docs.columns)
    kept = own.join(stay, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(own_node) == F.col(first_node))).dropDuplicates([first_id, first_node])
    return kept.select(*docs.columns).unionByName(none)
