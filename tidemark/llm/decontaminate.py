"""Passages of test items in documents: rare n-grams and counts of words find them, alignment scores them."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import PLAIN, text_words, window_hashes
from tidemark.storage import measured

# Items looked for in one pass over the documents; this bounds what a task holds.
BLOCK_ITEMS = 20_000
SEED_WORDS = 3
# A seed is rare if independent words would give it less often than this.
RARE = 1e-7
# An item with fewer rare seeds uses all its n-grams.
LEAST_SEEDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
# Cost of an alignment, in anchors found in a document; only speed depends on it.
ALIGN_COST = 100_000
# Cells of an alignment that are held together.
CELLS_AT_ONCE = 500_000
# Anchors of items that a task looks at together.
ANCHORS_AT_ONCE = 400_000


def item_words(text: str) -> list[bytes]:
    """Words as they are compared: punctuation apart, A-Z in lower case."""
    return text.encode().translate(PLAIN.tobytes()).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return next(text_words(pa.array([b" ".join(words)], pa.binary()))).hashes


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Smith-Waterman score of the best local alignment of two word sequences."""
    # Kept are scores less the gaps from the first place on, so a run of gaps is a running maximum.
    none = -GAP * np.arange(len(passage) + 1, dtype=np.int32)
    row, best = none, 0
    at_once = max(1, CELLS_AT_ONCE // len(none))
    for first in range(0, len(item), at_once):
        words = item[first : first + at_once, None]
        gains = np.where(words == passage, np.int32(MATCH - GAP), np.int32(MISMATCH - GAP))
        rows = np.zeros((len(words), len(none)), np.int32)
        for gain, new in zip(gains, rows):
            np.maximum(row[:-1] + gain, row[1:] + GAP, out=new[1:])
            np.maximum.accumulate(new, out=new)
            np.maximum(new, none, out=new)
            row = new
        best = max(best, int((rows - none).max()))
    return best


class Seeds:
    """Rare n-grams of a block of items, in arrays sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], frequency: dict[int, float], least: float):
        self.items = items
        entries = []
        for index, (_, words) in enumerate(items):
            size = min(SEED_WORDS, len(words))
            if not size:
                continue
            grams = window_hashes(words, size)[: len(words) - size + 1]
            p = np.array([frequency.get(int(w), least) for w in words])
            chance = reduce(np.multiply, [p[i : len(p) - size + 1 + i] for i in range(size)])
            chosen = np.flatnonzero(chance < RARE)
            if len(chosen) < LEAST_SEEDS:
                chosen = np.arange(len(chance))
            entries += [(int(grams[i]), index, size) for i in chosen]
        entries.sort()
        self.sizes = sorted({size for _, _, size in entries})
        self.hashes = np.array([h for h, _, _ in entries], np.uint64)
        self.owner = np.array([i for _, i, _ in entries], np.int64)
        self.marks = np.zeros(2**20, bool)
        self.marks[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of seeds in a sequence of words, each with its item."""
        for size in self.sizes:
            grams = window_hashes(words, size)[: max(0, len(words) - size + 1)]
            near = np.flatnonzero(self.marks[(grams >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(self.hashes, grams[near], "left")
            high = np.searchsorted(self.hashes, grams[near], "right")
            for at, start, end in zip(near.tolist(), low.tolist(), high.tolist()):
                for entry in range(start, end):
                    yield at, int(self.owner[entry])


def least_matches(length: int, threshold: float) -> int:
    """Words of an item that an alignment of ``threshold`` matches at least."""
    return max(1, math.ceil(threshold * length - 1e-9))


def longest_passage(length: int, threshold: float) -> int:
    """Words that an alignment of ``threshold`` spans at most: other words and gaps cost their score."""
    return max(length, math.floor((3 - 2 * threshold) * length + 1e-9))


class Anchors:
    """Words of which every alignment that reaches the threshold matches some, per item.

    Such an alignment leaves few words of the item unmatched. Of any so many and ``k``
    more it matches ``k`` or more, within a passage of bounded length. The rarest ones
    are taken, and ``k`` such that little is found by chance; no choice loses a passage.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], frequency: dict[int, float], least: float, threshold: float):
        self.spans = np.array([longest_passage(len(words), threshold) for _, words in items], np.int64)
        self.wanted = np.zeros(len(items), np.int64)
        values, owners, times = [], [], []
        for index, (_, words) in enumerate(items):
            need = least_matches(len(words), threshold)
            # An item of fewer words than a seed is found as a whole only.
            if len(words) < SEED_WORDS or need > len(words):
                continue
            p = np.array([frequency.get(int(w), least) for w in words])
            order = np.argsort(p, kind="stable")
            spare = len(words) - need
            k = np.arange(1, need + 1)
            _, first = np.unique(words[order], return_index=True)
            share = np.zeros(len(words))
            share[first] = p[order[first]]
            rate = np.cumsum(share)[spare:]
            more = (k - 1) * np.log(rate * self.spans[index]) - np.array([math.lgamma(n) for n in k])
            best = int(np.argmin(rate * (1 + ALIGN_COST * np.exp(np.minimum(more, 0)))))
            self.wanted[index] = k[best]
            chosen, n = np.unique(words[order[: spare + k[best]]], return_counts=True)
            times.append(n)
            values.append(chosen)
            owners.append(np.full(len(chosen), index, np.int64))
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by_value = np.argsort(value, kind="stable")
        self.owner = owner[by_value]
        self.times = np.concatenate(times)[by_value] if times else owner
        self.words, counts = np.unique(value, return_counts=True)
        self.starts = np.append(0, np.cumsum(counts))
        self.marks = np.zeros(2**20, bool)
        self.marks[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places from which on enough anchors follow within one text, each with the item."""
        at = np.flatnonzero(self.marks[(words >> np.uint64(44)).astype(np.int64)])
        if not len(self.words) or not len(at):
            return
        found = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        same = self.words[found] == words[at]
        at, found = at[same], found[same]
        sizes = self.starts[found + 1] - self.starts[found]
        total = np.append(0, np.cumsum(sizes))
        longest = int(self.spans.max())
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(total, total[first] + ANCHORS_AT_ONCE, side="right")) - 1)
            end = int(np.searchsorted(at, at[last - 1] + longest))
            n = sizes[first:end]
            place = np.repeat(at[first:end], n)
            entry = np.arange(len(place)) + np.repeat(self.starts[found[first:end]] - (total[first:end] - total[first]), n)
            item = self.owner[entry]
            key = item * len(words) + place
            order = np.argsort(key, kind="stable")
            key, item, place, entry = key[order], item[order], place[order], entry[order]
            text_end = bounds[np.searchsorted(bounds, place, side="right")]
            stop = item * len(words) + np.minimum(place + self.spans[item], text_end)
            stop = np.searchsorted(key, stop)
            start = np.flatnonzero((stop - np.arange(len(key)) >= self.wanted[item]) & (place <= at[last - 1]))
            stop = stop[start]
            total_after = np.append(0, np.cumsum(stop - start))
            done = 0
            while done < len(start):
                upto = max(done + 1, int(np.searchsorted(total_after, total_after[done] + ANCHORS_AT_ONCE, side="right")) - 1)
                here = start[done:upto][self._distinct(start[done:upto], stop[done:upto], entry, item)]
                yield from zip(place[here].tolist(), item[here].tolist())
                done = upto
            first = last

    def _distinct(self, start: np.ndarray, stop: np.ndarray, entry: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether a stretch has enough anchors when none counts more often than the item has it."""
        n = stop - start
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(which)) + np.repeat(start - (np.cumsum(n) - n), n)
        pairs, counts = np.unique(which * len(self.owner) + entry[inside], return_counts=True)
        counts = np.minimum(counts, self.times[pairs % len(self.owner)])
        return np.bincount(pairs // len(self.owner), counts, len(n)) >= self.wanted[item[start]]


def _can_reach(item: np.ndarray, shared: np.ndarray, threshold: float) -> bool:
    """Whether words that a passage shares with an item are as many as the threshold asks for."""
    need = least_matches(len(item), threshold)
    if len(shared) < need:
        return False
    have, wanted = Counter(shared.tolist()), Counter(item.tolist())
    return sum(min(n, wanted[w]) for w, n in have.items()) >= need


def _scores(
    words: np.ndarray, hits: list[tuple[int, int, bool]], items: list, threshold: float
) -> Iterator[tuple[int, float]]:
    """Best alignment of each item found in a document, as a share of a full match.

    Where anchors alone have found it, passages that cannot reach ``threshold`` are left out.
    """
    places, seeded = defaultdict(list), set()
    for at, item, by_seed in hits:
        places[item].append(at)
        if by_seed:
            seeded.add(item)
    for index, found in places.items():
        item_id, item = items[index]
        found = np.unique(found)
        reach = max(2 * len(item), longest_passage(len(item), threshold))
        best = 0
        for group in np.split(found, np.flatnonzero(np.diff(found) > reach) + 1):
            passage = words[max(0, group[0] - reach) : group[-1] + reach]
            shared = np.flatnonzero(np.isin(passage, item))
            if len(shared) and (index in seeded or _can_reach(item, passage[shared], threshold)):
                # The best alignment starts and ends with a match.
                best = max(best, align(item, passage[shared[0] : shared[-1] + 1]))
        if best:
            yield item_id, best / (MATCH * len(item))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    threshold: float = 0.5,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Which documents hold a passage of a test item, copied, edited or paraphrased.

    Returns ``doc_id, contaminated, item_id, score, item_ids, th`` (hash of the text):
    one row per row of ``docs``. ``score`` is the best Smith-Waterman score over words (2 for a match, -1
    for another word or a gap) as a share of the item's full score, ``item_id`` the item
    that has it (the smallest of equals), ``item_ids`` all items of ``threshold`` or
    more. Words ignore punctuation and the case of A-Z. Every item whose score reaches
    ``threshold`` is found; an item of one or two words only as a whole. Lower scores are
    those of documents that share a seed or many words with an item; others have score 0
    and no item, and so have null texts. Items without words or id are never found; repeated items
    count once. A null document id comes back null.

    Seeds are three words of an item that independent words would hardly give, by the
    counts of its words in all documents. A passage with many copies makes its own words
    common, so an item with few such seeds uses all its n-grams, and the threshold does
    not rest on seeds: passages that match enough words to reach it (:class:`Anchors`)
    are aligned as well. Items are taken in blocks, each against all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    base = texts(docs, id_column, text_column)
    wanted = (
        items.select(F.col(item_id_column).cast("bigint").alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
        .where("item_id is not null and text is not null").distinct()
    )
    n_items = wanted.count()
    blocks = n_items // block_items + 1
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found, sent = None, []
    for block in range(blocks):
        rows = wanted.where(block_of == block).orderBy("item_id", "text").collect()
        hits, shared = _find(base, [(r["item_id"], item_words(r["text"])) for r in rows], threshold)
        sent.append(shared)
        found = hits if found is None else found.unionByName(hits)
    best, _ = measured(
        found.groupBy("did", "th").agg(
            F.max("score").alias("score"),
            F.min_by("item_id", F.struct(-F.col("score"), F.col("item_id"))).alias("item_id"),
            F.array_sort(F.collect_set(F.when(F.col("score") >= threshold, F.col("item_id")))).alias("item_ids"),
        ),
        "contaminated",
    )
    for shared in sent:
        shared.destroy()
    none = F.array().cast("array<bigint>")
    return base.select("did", "th").join(best, ["did", "th"], "left").select(
        own_id("did").alias("doc_id"),
        F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("contaminated"),
        "item_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("item_ids", none).alias("item_ids"), "th",
    )


def _find(base: DataFrame, items: list[tuple[int, list[bytes]]], threshold: float) -> tuple[DataFrame, Broadcast]:
    """Scores of documents and items, and what is to be destroyed when they have been computed."""
    spark = base.sparkSession
    hashed = [(item_id, _hashes(words)) for item_id, words in items if words]
    known = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
    vocabulary = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, total = vocabulary.value, Counter(), 0
        for batch in batches:
            for words in text_words(batch.column("text"), PLAIN):
                total += len(words.hashes)
                at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
                if len(known):
                    at = at[known[at] == words.hashes]
                    values, n = np.unique(at, return_counts=True)
                    counts.update(dict(zip(values.tolist(), n.tolist())))
        yield pa.record_batch(
            [pa.array([-1, *counts], pa.int64()), pa.array([total, *counts.values()], pa.int64())], names=["word", "n"]
        )

    counts = base.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # as many rows as the block has words
    vocabulary.destroy()
    total = max(seen.pop(-1, 0), 1)
    frequency = {int(known[at]): n / total for at, n in seen.items()}
    shared = spark.sparkContext.broadcast(
        (Seeds(hashed, frequency, 1 / total), Anchors(hashed, frequency, 1 / total, threshold))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, anchors = shared.value
        for batch in batches:
            rows = []
            for words in text_words(batch.column("text"), PLAIN):
                by_doc = defaultdict(list)
                found = [(*hit, True) for hit in seeds.hits(words.hashes)]
                found += [(*hit, False) for hit in anchors.hits(words.hashes, words.bounds)]
                for at, item, by_seed in found:
                    doc = int(np.searchsorted(words.bounds, at, side="right")) - 1
                    by_doc[doc].append((at - int(words.bounds[doc]), item, by_seed))
                for doc, hits in by_doc.items():
                    own = words.hashes[words.bounds[doc] : words.bounds[doc + 1]]
                    did, th = (batch.column(c)[words.first + doc].as_py() for c in ("did", "th"))
                    rows += [(did, th, item_id, score) for item_id, score in _scores(own, hits, seeds.items, threshold)]
            if rows:
                did, th, item, score = zip(*rows)
                yield pa.record_batch(
                    [pa.array(did), pa.array(th), pa.array(item), pa.array(score)], names=["did", "th", "item_id", "score"]
                )

    return base.mapInArrow(search, "did bigint, th bigint, item_id bigint, score double"), shared
