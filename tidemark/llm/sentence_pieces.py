"""SentencePiece BPE models: encoding by vectorised merge rounds, and decoding.

Such a model merges, again and again, the adjacent pair of symbols whose union is the
piece of the best score, the leftmost of equals. No piece goes on from another
character to a blank, so words (up to the next blank that follows something else) merge
independently. All distinct words of a run of texts stand in one flat array of symbols.
A round finds the best rank of every word, merges all its pairs of that rank from the
left, closes the gaps and looks up the pairs that are new; words without a pair are done.

A round equals the merges one by one, unless the first of several merges of a word makes
a pair at least as good. Words where that happens (runs of blanks do it), and very
long ones, take their merges one at a time from a queue, in the model's own order.
"""

from __future__ import annotations

import codecs
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.frames import own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import ranges

BLANK = "▁"  # fixed value: how the models write a blank
NONE = np.iinfo(np.int32).max
# Symbols of unknown characters: this plus the code point.
OTHER = 1 << 40

# Characters encoded together: bounds the arrays of a task. Longer texts are cut between words.
RUN_CHARS = 1_000_000
# Longer words are merged with a queue: rounds would each look at all of them.
LONG_WORD = 400


def check_model(path: str) -> None:
    """Raise unless the model is of the kind this module knows."""
    from sentencepiece import sentencepiece_model_pb2 as layout

    model = layout.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    kinds = {piece.type for piece in model.pieces}
    known = (
        trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        and not normalizer.precompiled_charsmap and normalizer.add_dummy_prefix
        and not normalizer.remove_extra_whitespaces and normalizer.escape_whitespaces
        and kinds <= {model.SentencePiece.NORMAL, model.SentencePiece.UNKNOWN,
                      model.SentencePiece.CONTROL, model.SentencePiece.BYTE}
    )
    inside = any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces)
    if not known or inside:
        raise ValueError("Only BPE models with byte fallback, plain text and blanks before words are known.")


class Pairs:
    """Rank and union of pairs of symbols, as an open hash table in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, len(pairs).bit_length() + 2)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.union = np.zeros(1 << self.bits, np.int64)
        if not pairs:
            return
        left, right = np.array(list(pairs)).T
        key, value = (left << 20) | right, np.array(list(pairs.values()))
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.rank[slot[put]], self.union[slot[put]] = key[put], value[put, 0], value[put, 1]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, ``NONE`` where it is no piece, and its union."""
        key = np.where((left < OTHER) & (right < OTHER), (left << 20) | right, -2)
        slot = self._slot(key)
        there = self.key[slot]
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            there = self.key[slot[todo]]
            todo = todo[(there != key[todo]) & (there >= 0)]
        rank = np.where(self.key[slot] == key, self.rank[slot], NONE)
        return rank, self.union[slot]


class Model:
    """The tables of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        spelled = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(spelled) if not special[i]}
        score = {p: model.get_score(i) for p, i in ids.items()}
        places = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        # Characters that occur in pieces alone are symbols too, with numbers after the ids.
        symbols = dict(ids)
        for character in sorted(set("".join(ids)) - set(ids)):
            symbols[character] = len(symbols) + size
        self.pairs_of: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, at in ids.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in symbols and piece[cut:] in symbols:
                    self.pairs_of[symbols[piece[:cut]], symbols[piece[cut:]]] = places[score[piece]], at
        self.pairs = Pairs(self.pairs_of)
        self.symbol = np.arange(OTHER, OTHER + 0x110000)
        self.character = np.zeros(max(symbols.values(), default=0) + size + 1, np.int64)
        for piece, number in symbols.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
                self.character[number] = ord(piece)
        self.size = size
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)

        # Decoding: what each id stands for, one after another in a single array.
        said = [p.replace(BLANK, " ").encode() for p in spelled]
        for i in range(size):
            if model.is_byte(i):
                said[i] = bytes([int(spelled[i][1:-1], 16)])
            elif model.is_control(i):
                said[i] = b""
            elif model.is_unknown(i):
                said[i] = " ⁇ ".encode()  # fixed value: how the library shows an unknown piece
        self.length = np.array([len(x) for x in said], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.blank_first = np.array([p.startswith(BLANK) and not s for p, s in zip(spelled, special)])

    # -- merging -------------------------------------------------------------------

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The final symbols of one word, merged in the model's order."""
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (best := self.pairs_of.get((symbols[i], symbols[j]))):
                heapq.heappush(queue, (best[0], i, symbols[i], symbols[j], best[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, union = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j] = union, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, here in zip(symbols, alive) if here]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words with ``sizes`` symbols each (at least one), and their new sizes."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, sizes, symbols
        word = np.arange(len(sizes))

        def one_by_one(some: np.ndarray, kept: np.ndarray, cuts: np.ndarray) -> None:
            merged = [self._one_by_one(x.tolist()) for x in np.split(kept, cuts)]
            lengths = np.array([len(x) for x in merged], np.int64)
            done.append((some, lengths, np.array([s for x in merged for s in x], np.int64)))

        if (long := sizes > LONG_WORD).any():
            in_long = np.repeat(long, sizes)
            one_by_one(word[long], symbols[in_long], np.cumsum(sizes[long])[:-1])
            symbols, word, sizes = symbols[~in_long], word[~long], sizes[~long]

        rank, union = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int64)
        lasts = np.cumsum(sizes) - 1
        look = np.ones(len(symbols), bool)
        look[lasts] = False
        at = np.flatnonzero(look)
        rank[at], union[at] = self.pairs.find(symbols[at], symbols[at + 1])
        least = np.full(len(sizes), -1)  # no new pair of a word may have this rank or a better one
        origin, origin_sizes = symbols.copy(), sizes
        while len(word):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            late = best <= least
            over = (best == NONE) | late
            if over.any():
                in_over = np.repeat(over, sizes)
                ended = over & ~late
                done.append((word[ended], sizes[ended], symbols[np.repeat(ended, sizes)]))
                if late.any():
                    again = np.repeat(late, origin_sizes)
                    one_by_one(word[late], origin[again], np.cumsum(origin_sizes[late])[:-1])
                origin, origin_sizes = origin[~np.repeat(over, origin_sizes)], origin_sizes[~over]
                symbols, rank, union = symbols[~in_over], rank[~in_over], union[~in_over]
                word, sizes, best, least = word[~over], sizes[~over], best[~over], least[~over]
                if not len(word):
                    break
            hit = rank == np.repeat(best, sizes)
            # Of hits one after another every second one, from the left.
            places = np.flatnonzero(hit)
            run = np.diff(places, prepend=-2) != 1
            chosen = places[(np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))) % 2 == 0]
            of = np.repeat(np.arange(len(word)), sizes)[chosen]
            merges = np.bincount(of, minlength=len(word))
            least = np.where(merges > 1, best, -1)
            symbols[chosen] = union[chosen]
            stays = np.ones(len(symbols), bool)
            stays[chosen + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[chosen] = True
            symbols, rank, union, fresh = symbols[stays], rank[stays], union[stays], fresh[stays]
            sizes = sizes - merges
            lasts = np.cumsum(sizes) - 1
            fresh[:-1] |= fresh[1:]
            fresh[lasts] = False
            rank[lasts] = NONE
            at = np.flatnonzero(fresh)
            rank[at], union[at] = self.pairs.find(symbols[at], symbols[at + 1])
        words, lengths, flat = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*done)) or [[], [], []]))
        order = np.argsort(words)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        return flat[ranges(begin, lengths)], lengths

    # -- texts -----------------------------------------------------------------------

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(some), np.int64)
        for run, own in _runs(some):
            ids, sizes = self._encode_run(run)
            parts.append(ids)
            np.add.at(counts, own, sizes)
        return np.concatenate(parts), counts

    def _encode_run(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(run)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(run), np.int64)
        points = np.frombuffer(text.replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        edges = np.append(0, np.cumsum([len(t) for t in run]))
        blank = points == ord(BLANK)
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[edges[:-1][edges[:-1] < len(points)]] = True
        starts = np.flatnonzero(starts)
        cuts = np.append(starts, len(points)).astype(np.int64) * 4
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(points)]
        ).dictionary_encode()
        distinct = coded.dictionary
        sizes = np.diff(np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)) // 4
        flat = np.frombuffer(distinct.buffers()[2], np.uint32, int(sizes.sum()))
        ids, lengths = self._spelled(*self.merge(self.symbol[flat], sizes))
        which = coded.indices.to_numpy()
        begin = np.cumsum(lengths) - lengths
        each = lengths[which]
        sums = np.append(0, np.cumsum(each))
        firsts = np.searchsorted(starts, edges)
        return ids[ranges(begin[which], each)], np.diff(sums[firsts])

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: the bytes of a character that is no piece."""
        unknown = np.flatnonzero(symbols >= self.size)
        if not len(unknown):
            return symbols.astype(np.int32), sizes
        number = symbols[unknown]
        point = np.where(number >= OTHER, number - OTHER, self.character[np.minimum(number, len(self.character) - 1)])
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        each = np.ones(len(symbols), np.int64)
        each[unknown] = width
        place = np.cumsum(each) - each
        ids = np.repeat(np.where(symbols < self.size, symbols, 0), each).astype(np.int32)
        for k in range(4):
            some = width > k
            shift = 6 * (width[some] - 1 - k)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[some]]
            byte = np.where(k == 0, lead | (point[some] >> shift), 0x80 | ((point[some] >> shift) & 0x3F))
            ids[place[unknown[some]] + k] = self.bytes[byte]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return ids, np.bincount(owner, each, len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of id sequences of ``sizes`` ids each, standing one after another in ``ids``."""
        length = self.length[ids]
        begin = self.begin[ids]
        # A blank that the first piece of a text begins with is not part of it.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        solid = np.flatnonzero(length > 0)
        firsts = solid[np.diff(owner[solid], prepend=-1) != 0]
        firsts = firsts[self.blank_first[ids[firsts]]]
        length[firsts] -= 1
        begin[firsts] += 1
        out = self.said[ranges(begin, length)]
        cuts = np.append(0, np.cumsum(np.bincount(owner, length, len(sizes)).astype(np.int64)))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text has
            return pa.array([x.as_py().decode("utf-8", "each_byte") for x in raw], pa.string())


# A byte that belongs to no character is shown as one replacement character.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _runs(some: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts with their first blank, in runs of bounded length, and the number of the text of each part."""
    run, own, size = [], [], 0
    for i, text in enumerate(some):
        text = " " + text if text else ""
        begin = 0
        while True:
            end = len(text)
            if end - begin > RUN_CHARS:
                end = _between_words(text, begin + 1, begin + RUN_CHARS) or len(text)
            run.append(text[begin:end])
            own.append(i)
            size += end - begin
            if size >= RUN_CHARS:
                yield run, own
                run, own, size = [], [], 0
            begin = end
            if begin >= len(text):
                break
    if run:
        yield run, own


def _between_words(text: str, low: int, high: int) -> int:
    """The last place from ``low`` to ``high`` with a blank after something else, or 0."""
    while (at := text.rfind(" ", low, high)) >= 0:
        if text[at - 1] not in (" ", BLANK):
            return at
        high = at
    return 0


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The tables, loaded once in a Python worker."""
    return Model(path)


def encode_pieces(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``: the ids that the model gives its text, no others added.

    A null text has no ids, like an empty one. Repeated rows, rows with equal ids and
    rows without an id each give a row; no rows give no rows. Other columns of ``docs`` are
    not looked at. Long texts are encoded whole, in parts cut between words. The model's
    file must be at ``model_path`` on every machine; a model of another kind raises.
    """
    check_model(model_path)
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        tool = model(model_path)
        for batch in batches:
            for first, some in _sliced(batch.column("text")):
                ids, sizes = tool.encode(some)
                cuts = np.append(0, np.cumsum(sizes)).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("did").slice(first, len(some)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))],
                    names=["did", "ids"],
                )

    base = texts(docs, id_column, text_column).select("did", "text")
    return base.mapInArrow(encode, "did bigint, ids array<int>").select(own_id("did").alias("doc_id"), "ids")


def decode_pieces(frame: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """The columns of ``frame`` and ``decoded``, the text of the ids; null ids give an empty text.

    An id outside the model raises. Bytes that form no character are shown as U+FFFD.
    """
    check_model(model_path)
    ship(frame.sparkSession)
    if "decoded" in frame.columns:
        raise ValueError("The frame has a column 'decoded' already.")
    names = frame.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(model_path)
        for batch in batches:
            lists = batch.column(ids_column)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            first = 0
            while first < len(lists):  # a bounded number of ids at a time
                last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), RUN_CHARS)) + first)
                part = batch.slice(first, last - first)
                ids = part.column(ids_column).flatten().to_numpy()
                if len(ids) and not 0 <= ids.min() <= ids.max() < tool.size:
                    raise ValueError("ids outside the model")
                text = tool.decode(ids, sizes[first:last])
                yield pa.record_batch([*part.columns, text], names=[*names, "decoded"])
                first = last

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(decode, f"{fields}, decoded string")


def _sliced(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in slices of bounded length, one text at least, with the place of the first."""
    first, some, size = 0, [], 0
    for i, text in enumerate(column):
        some.append(text.as_py())
        size += len(some[-1])
        if size >= RUN_CHARS:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some
