"""Passages of many words that occur more than once, removed wherever they stand.

Windows are hashed; no suffix is sorted and no suffix tree is built, as only repeats
of one length, ``window`` words, are asked for. The key of a window is its minimizer:
of the n-grams of half a window inside it, the one with the least hash, wherever it
stands. Equal windows have equal minimizers, so a window whose minimizer stands
nowhere else is not repeated and goes no further. The others are dealt by the
minimizer to groups that fit memory, and there compared by one 64-bit hash of all
their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import HEAVY_SHARE, own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import Words, mixed, text_words, window_hashes
from tidemark.storage import measured

# Bits of the sketch of shared n-grams: 32 MB at any corpus size. It only spares
# work; a bit set by chance costs rows, never a result.
SKETCH_BITS = 28
GRAM_BASE = np.uint64(0xA0761D6478BD642F)
# Bytes of window hashes that one task compares.
GROUP_BYTES = 16_000_000

PIECES = "key bigint, did bigint, th bigint, pos int, n int, hashes binary"


def _sliding(values: np.ndarray, size: int, pick: np.ufunc, filler: np.uint64) -> np.ndarray:
    """``pick`` over each ``size`` values from each place on."""
    out, length = values.copy(), 1
    while length < size:
        step = min(length, size - length)
        ahead = np.full_like(out, filler)
        ahead[:-step] = out[step:]
        out = pick(out, ahead)
        length += step
    return out


class Sampled:
    """The minimizer of each window of a slice of texts."""

    def __init__(self, words: Words, window: int):
        n = len(words.hashes)
        gram = (window + 1) // 2
        inside = window - gram + 1  # n-grams of a window
        counts = np.diff(words.bounds)
        left = np.repeat(words.bounds[1:], counts) - np.arange(n)
        self.whole = left >= window  # a window starts here
        top = np.uint64(2**64 - 1)
        grams = window_hashes(words.hashes, gram, GRAM_BASE)
        self.grams = np.where(left >= gram, grams, top)
        least = _sliding(self.grams, inside, np.minimum, top) if n else self.grams
        self.least = least
        # An n-gram is sampled if it is the least one of some window around it.
        shown = np.where(self.whole, least, np.uint64(0))
        around = _sliding(shown[::-1], inside, np.maximum, np.uint64(0))[::-1] if n else shown
        self.sampled = (around == self.grams) & (left >= gram) & (around > 0)


def _runs(*changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches in which none of the arrays changes."""
    n = len(changes[0])
    cut = np.zeros(n, bool)
    if n:
        cut[0] = True
        for values in changes:
            cut[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.append(starts, n))


def substring_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35
) -> DataFrame:
    """Remove every word covered by ``window`` words that start anywhere else too.

    Returns ``doc_id, n_words, n_removed, kept, removed``: one row per row of
    ``docs``; ``kept`` are the other words joined by one blank, ``removed`` the
    stretches of removed words (first word, number of words). A word is a run of
    characters other than white space, unchanged. All occurrences go, the first
    one too, also within one document; windows are judged on the input. A null
    text has no words; a text of fewer than ``window`` words keeps all. Repeated
    rows repeat one another. A null id comes back as null.
    """
    spark = docs.sparkSession
    ship(spark)
    base = texts(docs, id_column, text_column)
    shared = spark.sparkContext.broadcast(_shared_grams(spark, base, window))
    pieces, size = measured(
        _pieces(base, window, shared), "windows",
        bytes=F.sum(F.octet_length("hashes")),
    )
    shared.destroy()
    groups = int((size["bytes"] or 0) // GROUP_BYTES) + 1
    groups = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = pieces.where("hashes is not null").repartition(groups, "key").mapInArrow(
        _resolve, "did bigint, th bigint, pos int, n int"
    )
    known = pieces.where("hashes is null").select("did", "th", "pos", "n")
    removed = (
        known.unionByName(found).groupBy("did", "th")
        .agg(F.collect_set(F.struct("pos", "n")).alias("windows"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, window)

    return (
        base.join(removed, ["did", "th"], "left")
        .select("did", "text", F.col("windows.pos").alias("at"), F.col("windows.n").alias("n"))
        .mapInArrow(
            cut, "did bigint, n_words bigint, n_removed bigint, kept string, "
            "removed array<struct<first: bigint, n: bigint>>",
        )
        .withColumn("did", own_id("did")).withColumnRenamed("did", "doc_id")
    )


def _shared_grams(spark: SparkSession, base: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit sketch of sampled n-grams that stand twice or more, and the very common ones.

    Both have a fixed bound: ``2 ** SKETCH_BITS`` bits, ``HEAVY_SHARE`` n-grams.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s := Sampled(w, window)).grams[s.sampled] for w in text_words(batch.column("text"))]
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counts = (
        base.select("text").mapInArrow(sample, "gram bigint, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    )
    shared, seen = measured(counts, "grams", total=F.sum("n"))
    bit = F.shiftrightunsigned("gram", 64 - SKETCH_BITS) + 1
    parts = (
        shared.groupBy(F.bitmap_bucket_number(bit).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    )
    sketch = np.zeros(2**SKETCH_BITS // 8, np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        sketch[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    common = shared.where(F.col("n") > (seen["total"] or 0) // HEAVY_SHARE).select("gram").toArrow()
    return sketch, np.sort(common.column("gram").to_numpy().view(np.uint64))


def _pieces(base: DataFrame, window: int, shared: Broadcast) -> DataFrame:
    """Stretches of windows below one shared n-gram.

    A row with ``did`` and ``hashes`` asks whether these windows stand elsewhere; one
    with ``hashes`` alone tells that they stand twice already; one without ``hashes``
    is a stretch found repeated within the batch. Windows of very common n-grams are
    dealt one by one, by their own hash.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for batch in batches:
            yield from _deal(batch, window, bits, hot)

    return base.mapInArrow(deal, PIECES)


def _deal(batch: pa.RecordBatch, window: int, bits: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    docs, places, keys, hashes = [], [], [], []
    for words in text_words(batch.column("text")):
        sampled = Sampled(words, window)
        bit = sampled.least >> np.uint64(64 - SKETCH_BITS)
        known = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(sampled.whole & (known == 1))
        if len(at):
            doc = np.searchsorted(words.bounds, at, side="right") - 1
            docs.append(doc + words.first)
            places.append(at - words.bounds[doc])
            keys.append(sampled.least[at])
            hashes.append(window_hashes(words.hashes, window)[at])
    if not docs:
        return
    doc, place = np.concatenate(docs), np.concatenate(places)
    key, hashed = np.concatenate(keys), np.concatenate(hashes)
    is_hot = np.isin(key, hot)
    key = np.where(is_hot, mixed(hashed ^ key), key)
    distinct, first, which, n = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    twice = n[which] > 1
    did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()

    def rows(key=None, who=None, pos=None, n=None, hashes=None) -> pa.RecordBatch:
        size = len(key) if key is not None else len(who)
        none = lambda kind: pa.nulls(size, kind)
        return pa.record_batch([
            pa.array(key.view(np.int64)) if key is not None else none(pa.int64()),
            pa.array(did[who]) if who is not None else none(pa.int64()),
            pa.array(th[who]) if who is not None else none(pa.int64()),
            pa.array(pos.astype(np.int32)) if pos is not None else none(pa.int32()),
            pa.array(n.astype(np.int32)) if n is not None else none(pa.int32()),
            hashes if hashes is not None else none(pa.binary()),
        ], names=["key", "did", "th", "pos", "n", "hashes"])

    gap = place - np.arange(len(place))  # constant while places follow one another
    starts, lengths = _runs(doc, gap, twice)
    done = twice[starts]
    yield rows(who=doc[starts[done]], pos=place[starts[done]], n=lengths[done])
    open_ = np.flatnonzero(~twice)
    if len(open_):
        starts, lengths = _runs(doc[open_], gap[open_], open_ - np.arange(len(open_)), key[open_])
        yield rows(key[open_][starts], doc[open_][starts], place[open_][starts], lengths,
                   _cells(hashed[open_], starts, lengths))
    told = first[n > 1]
    if len(told):
        told = told[np.argsort(key[told], kind="stable")]
        starts, lengths = _runs(key[told])
        yield rows(key[told][starts], hashes=_cells(hashed[told], starts, lengths))


def _cells(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary cells that hold the hashes of each stretch."""
    offsets = np.append(starts, starts[-1] + lengths[-1]).astype(np.int32) * 8
    data = np.ascontiguousarray(hashes)
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of this group that stand twice, as stretches of their documents."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    cells = table.column("hashes").to_pylist()
    hashes = np.frombuffer(b"".join(cells), np.uint64)
    sizes = np.array([len(c) // 8 for c in cells], np.int64)
    asks = np.array(table.column("did").is_valid())
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    told = np.zeros(len(n), bool)
    told[which[~asks[row]]] = True
    repeated = np.flatnonzero(((n > 1) | told)[which] & asks[row])
    if not len(repeated):
        return
    r, w = row[repeated], within[repeated]
    starts, lengths = _runs(r, w - np.arange(len(w)))
    at = pa.array(r[starts])
    yield pa.record_batch([
        pa.array(np.array(table.column("did").take(at))), pa.array(np.array(table.column("th").take(at))),
        pa.array((np.array(table.column("pos").take(at)) + w[starts]).astype(np.int32)),
        pa.array(lengths.astype(np.int32)),
    ], names=["did", "th", "pos", "n"])


def _cut(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("first", pa.int64()), ("n", pa.int64())])
    out: list[tuple] = []
    size = 0
    for did, text, at, n in zip(*(batch.column(c) for c in ("did", "text", "at", "n"))):
        words = text.as_py().encode().split()
        keep = np.ones(len(words) + 1, bool)
        if at.is_valid:
            step = np.zeros(len(words) + 1, np.int64)
            first = np.asarray(at.values)
            np.add.at(step, first, 1)
            np.add.at(step, first + np.asarray(n.values) + window - 1, -1)
            keep = np.cumsum(step) == 0
        spans = [
            {"first": int(s), "n": int(m)} for s, m in zip(*_runs(keep[:-1])) if not keep[s]
        ]
        kept = b" ".join(compress(words, keep.tolist())).decode()
        removed = int(len(words) - keep[:-1].sum())
        out.append((did.as_py(), len(words), removed, kept, spans))
        size += len(kept)
        if size > 4_000_000:
            yield _kept_rows(out, span)
            out, size = [], 0
    if out:
        yield _kept_rows(out, span)


def _kept_rows(out: list[tuple], span: pa.DataType) -> pa.RecordBatch:
    did, words, removed, kept, spans = zip(*out)
    return pa.record_batch(
        [pa.array(did, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))],
        names=["did", "n_words", "n_removed", "kept", "removed"],
    )
