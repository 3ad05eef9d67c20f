"""Periodic runs of words within each document, by seeds and extension along diagonals.

A run is a stretch of words with smallest period ``q``, at least ``least`` and
``2 q`` words long, that cannot grow on either side and keep that period. Words ``q``
apart are then equal over ``max(least - q, q)`` positions: a stretch of the diagonal
of lag ``q``. Lags are taken in classes that double. Every diagonal stretch of a class
holds a whole aligned ``h``-gram, so

1. ``h``-grams are indexed per document under exact names, those of ``2 h`` words being
   pairs of those of ``h``, and only positions whose ``h``-gram comes again are kept;
2. every aligned ``h``-gram looks up its occurrences at the lags of the class, ``4 h`` of
   them at most, so there are never more pairs than a fixed multiple of the words;
3. per lag, seeds that lie in what the seeds before them cover are dropped, and the
   rest is extended to both ends, by the names of ever fewer words.

A multiple of a run's period covers the very same words, so of equal stretches the
one with the smallest lag is the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import SLICE_BYTES, SPACE

LEAST = 12


def _repeated(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions ``at`` those whose ``key`` occurs again, and names (from 0) for their keys."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    lone = new.copy()
    lone[:-1] &= new[1:]
    name = np.cumsum(new & ~lone) - 1
    return at[order[~lone]], name[~lone]


def _stretch(words, levels, x, lag, room, sign) -> np.ndarray:
    """How far words ``lag`` apart agree from ``x`` on (``sign`` 1) or before it (-1), up to ``room``.

    ``levels`` are pairs of a size and the names of that many words from each place on
    (-1 where they do not come again), by size; the answer is below twice the last size.
    """
    done = np.zeros(len(x), np.int64)
    for size, names in reversed(levels):
        left = np.flatnonzero(done + size <= room)
        i = x[left] + done[left] if sign > 0 else x[left] - done[left] - size
        name = names[i]
        done[left[(name >= 0) & (name == names[i + lag[left]])]] += size
    for _ in range(levels[0][0] - 1 if levels else 0):  # word by word below the smallest size
        left = np.flatnonzero(done < room)
        i = x[left] + done[left] if sign > 0 else x[left] - done[left] - 1
        done[left[words[i] == words[i + lag[left]]]] += 1
    return done


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of many documents.

    ``words`` are word numbers (from 0) and document ``i`` has those from ``bounds[i]`` to
    ``bounds[i + 1]``; starts count from the beginning of ``words``, in ascending order.
    """
    n, sizes = len(words), np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first, last = bounds[:-1][doc], bounds[1:][doc]
    kinds = int(words.max(initial=0)) + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    h = ((least + 1) // 2 + 1) // 2
    at = np.arange(n)
    name = doc * kinds + words
    for size in range(2, h + 1):  # names of h words, each word appended in turn
        fits = at + size <= last[at]
        at, name = at[fits], name[fits]
        at, name = _repeated(name * kinds + words[at + size - 1], at)
    if h == 1:
        at, name = _repeated(name, at)
    low, levels = 1, []
    while len(at) and low <= sizes.max(initial=0):
        index = np.sort(name * n + at)
        # Aligned seeds, and their occurrences at lags from low up to 4 h.
        seed = at % h == 0
        x, base = at[seed], name[seed] * n
        begin = np.searchsorted(index, base + np.minimum(x + low, n))
        count = np.searchsorted(index, base + np.minimum(x + 4 * h, n)) - begin
        total = int(count.sum())
        if total:
            y = index[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)] % n
            x = np.repeat(x, count)
            lag_x = np.sort((y - x) * n + x)  # by lag, then place
            start = np.flatnonzero(np.diff(lag_x, prepend=-h - 1) != h)
            lag, s = lag_x[start] // n, lag_x[start] % n
            e = lag_x[np.append(start[1:], len(lag_x)) - 1] % n + h
            wanted = np.maximum(lag, least - lag)
            may = e - s + 2 * (h - 1) >= wanted
            lag, s, e, wanted = lag[may], s[may], e[may], wanted[may]
            # Less than h on either side, or the next aligned seed would have been found there.
            room = np.minimum(h - 1, last[s] - lag - e), np.minimum(h - 1, s - first[s])
            grown = levels or [(h, np.full(n, -1, np.int32))]
            e = e + _stretch(words, grown, e, lag, room[0], 1)
            s = s - _stretch(words, grown, s, lag, room[1], -1)
            long = e - s >= wanted
            found.append((s[long], (e + lag - s)[long], lag[long]))
        # Names of twice as many words.
        low = 4 * h
        names = np.full(n, -1, np.int32)
        names[at] = name
        levels.append((h, names))
        other = np.where(at + h < last[at], names[np.minimum(at + h, n - 1)], -1).astype(np.int64)
        at, name, other = (c[other >= 0] for c in (at, name, other))
        at, name = _repeated(name * (int(name.max(initial=0)) + int(other.max(initial=0)) + 2) + other, at)
        h *= 2

    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    same = (np.diff(start, prepend=-1) == 0) & (np.diff(length, prepend=-1) == 0)
    start, length, period = start[~same], length[~same], period[~same]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last (excluded) text, their bytes, and where each text begins and the last ends."""
    wide = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = column.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, their numbers, and the first word of each text."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]  # a text may end without white space
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(np.append(inside[:-1] & (begins[1:] | ~inside[1:]), inside[-1:])) + 1
    cuts = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )
    numbers = packed.dictionary_encode().indices.to_numpy().astype(np.int64)
    return starts, ends, numbers, np.searchsorted(starts, offsets)


def _joined(data, starts, ends, bounds, keep) -> pa.Array:
    """The kept words of each text, with one blank between them."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    starts, lengths = starts[keep], (ends - starts)[keep] + 1
    lengths[np.append(doc[1:] != doc[:-1], True)[: len(doc)]] -= 1  # none after the last word of a text
    stops = np.cumsum(lengths)
    size = int(stops[-1]) if len(stops) else 0
    source = np.repeat(starts - stops + lengths, lengths) + np.arange(size)
    out = data[np.minimum(source, len(data) - 1)] if size else np.zeros(0, np.uint8)
    out[stops[:-1][doc[1:] == doc[:-1]] - 1] = 0x20
    per_text = np.bincount(doc, lengths, len(bounds) - 1).astype(np.int64)
    cuts = np.append(0, np.cumsum(per_text)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(cuts), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST
) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every row of ``docs``.

    ``runs`` are the runs of at least ``least`` words and twice their period, as
    ``struct<start, length, period>`` by start and period, words numbered from 0.
    ``kept`` are the words that stay if of every run only the first period does,
    joined by blanks: a word goes if any run holds it after its first period.

    A null text has no words, like an empty one or one of white space. Repeated rows,
    rows with equal ids and rows without an id each give a row. Other columns of
    ``docs`` are not looked at. No rows give no rows. A document is looked at by one
    task, in some 400 bytes for each of its words; nothing is shuffled.
    """
    if least < 2:
        raise ValueError("least must be at least 2.")
    ship(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("did")
            for first, last, data, offsets in _slices(batch.column("text")):
                if len(data):
                    starts, ends, numbers, bounds = _numbered(data, offsets)
                else:
                    starts = ends = numbers = np.zeros(0, np.int64)
                    bounds = np.zeros(last - first + 1, np.int64)
                s, length, period = find_runs(numbers, bounds, least)
                covered = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(covered, s + period, 1)
                np.add.at(covered, s + length, -1)
                keep = np.cumsum(covered[:-1]) == 0
                cuts = np.searchsorted(s, bounds)
                own = np.repeat(np.arange(last - first), np.diff(cuts))
                runs = pa.StructArray.from_arrays(
                    [pa.array(s - bounds[own]), pa.array(length), pa.array(period)], fields=list(run)
                )
                yield pa.record_batch(
                    [
                        ids.slice(first, last - first),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs),
                        _joined(data, starts, ends, bounds, keep),
                    ],
                    names=["did", "n_words", "runs", "kept"],
                )

    found = texts(docs, id_column, text_column).select("did", "text").mapInArrow(
        search,
        "did bigint, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, kept string",
    )
    return found.select(own_id("did").alias("doc_id"), "n_words", "runs", "kept")
