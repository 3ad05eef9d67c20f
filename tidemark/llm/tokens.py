"""Token ids in binary shards: documents compressed one by one with a shared dictionary.

A shard is one file of Spark's text writer (one row, so Spark's commit protocol
covers it) with this layout, integers little-endian::

    "TDTK" | version u32 | id width u32 | partition u32 | shard u32 | documents u64
    | ids before it in its partition u64 | ids in it u64 | dictionary hash, 16 bytes
    | document ids i64[n] | id counts u64[n] | frame offsets u64[n + 1] | zstd frames | "\\n"

Frame offsets count from the first frame. The dictionary is the one file of the
folder ``dictionary`` beside ``shards`` (empty if there was too little to train on).
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import SPACE, ranges
from tidemark.storage import measured

MAGIC = b"TDTK"
HEADER = "<4sIIIIQQQ16s"

# The white space of Unicode, as byte-level patterns see it.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_WHITE = np.zeros(0x110000, bool)
_IS_WHITE[_WHITE] = True
# Letters whose class no Unicode version changes, and signs that always begin another piece after a letter.
_IS_LETTER, _IS_STOP = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
_IS_LETTER[[c for c in range(0x180) if chr(c).isalpha()]] = True
_IS_STOP[list(map(ord, ".,;:!?"))] = True



def _byte_characters() -> np.ndarray:
    """How byte-level vocabularies write the 256 bytes: visible ones as themselves, the others from U+0100 on."""
    visible = np.zeros(256, bool)
    visible[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
    return np.where(visible, np.arange(256), 0xFF + np.cumsum(~visible)).astype(np.uint32)


_SPELLED = _byte_characters()
# White space, and first bytes of white space beyond ASCII.
_MAY_BE_WHITE = SPACE | np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
# Bytes that no letter of A-Z, a-z and U+00C0 to U+017F holds.
_NOT_LETTER = np.array([not (chr(b).isascii() and chr(b).isalpha()) and not (0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC5) for b in range(256)])

# Characters encoded together, and characters handed to the library in one string.
RUN_CHARS = 1_000_000
LIBRARY_CHARS = 50_000
# Bytes of words and ids that a worker remembers, besides those of the last run.
KNOWN_BYTES = 16_000_000


class Encoder:
    """Encodes texts with the tokenizers library, each distinct word of a run of texts once.

    A byte-level tokenizer always cuts before a single blank between other characters than
    white space, and between a letter and a stop, and what follows is encoded by itself. So all distinct words of a run, each
    with the blank before it, can stand one after another in a few strings; the library
    encodes these, and the lengths of its tokens say which of them belong to which word.
    Words are remembered up to ``KNOWN_BYTES``; then all that the last run
    did not have are forgotten. Other kinds of tokenizer get whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        with open(path, "rb") as file:
            spec = json.load(file)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        added = spec["added_tokens"] or []
        self.by_word = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and spec["normalizer"] is None and not model.get("dropout") and not spec["truncation"] and not spec["padding"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(map(chr, _WHITE)) for t in added)
        )
        if self.by_word:
            # The same model without the pattern: words of letters alone are one piece each.
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
            # A byte-level vocabulary writes each byte as one character.
            self.length = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1, np.int64)
            for token, i in model["vocab"].items():
                self.length[i] = len(token)
            for token in added:
                self.length[token["id"]] = len(token["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())  # words in UTF-8
        self.known_ids = np.zeros(0, np.int32)
        self.known_sizes = np.zeros(0, np.int32)

    def _library(self, some: list[str], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        tool = self.words if letters else self.tokenizer
        encoded = tool.encode_batch_fast(some, add_special_tokens=False)
        parts = [np.array(e.ids, np.int32) for e in encoded]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        if not self.by_word:
            return self._library(some)
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        first, size = 0, 0
        for i, text in enumerate(some):
            size += len(text)
            if size >= RUN_CHARS or i + 1 == len(some):
                ids, n = self._encode_run(some[first : i + 1])
                parts.append(ids)
                counts.append(n)
                first, size = i + 1, 0
        return np.concatenate(parts), np.concatenate(counts)

    def _encode_run(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(run).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(run), np.int64)
        edges = np.append(0, np.cumsum([len(t) for t in run]))
        black = ~_IS_WHITE[points]
        cut = points == 0x20
        cut[1:] &= black[:-1]
        cut[:-1] &= black[1:]
        cut[-1] = False
        cut[1:] |= _IS_STOP[points[1:]] & _IS_LETTER[points[:-1]]
        # The last blank of a text is not before a word, whatever the next text begins with.
        cut[edges[1:][edges[1:] > 0] - 1] = False
        cut[edges[:-1][edges[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(points)).astype(np.int64) * 4
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(points)]
        ).dictionary_encode()
        words, which = _utf8(coded.dictionary), coded.indices.to_numpy()
        place = pc.index_in(words, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy()[~new]
        new_words = words.filter(pa.array(new))
        new_ids, new_sizes = self._words(new_words)

        ids = np.concatenate([self.known_ids, new_ids])
        sizes, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[new], begin[new] = new_sizes, np.cumsum(new_sizes) - new_sizes + len(self.known_ids)
        sizes[~new], begin[~new] = self.known_sizes[at], (np.cumsum(self.known_sizes, dtype=np.int64) - self.known_sizes)[at]
        each = sizes[which]
        sums = np.append(0, np.cumsum(each))
        out = ids[ranges(begin[which], each)], np.diff(sums[np.searchsorted(starts, edges)])

        if self.known.nbytes + 4 * len(ids) + 4 * len(self.known) < KNOWN_BYTES:
            self.known, self.known_ids = pa.concat_arrays([self.known, new_words]), ids
            self.known_sizes = np.append(self.known_sizes, new_sizes.astype(np.int32))
        else:
            self.known, self.known_ids, self.known_sizes = words, ids[ranges(begin, sizes)], sizes.astype(np.int32)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and the number of ids of each."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        bounds = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        size = ends - starts
        blank = data[starts] == 0x20
        # A blank and letters: the pattern makes one piece of it.
        other = _NOT_LETTER[data]
        lead, trail = data[:-1], data[1:]
        other[:-1] |= (lead == 0xC3) & ((trail == 0x97) | (trail == 0xB7))
        other[starts] = False
        letters = blank & (np.add.reduceat(other, starts, dtype=np.int64) == 0) & (size > 1)
        # A blank and no white space, as far as bytes can tell: it can stand after others.
        mark = _MAY_BE_WHITE[data]
        mark[starts] = False
        plain = blank & (np.add.reduceat(mark, starts, dtype=np.int64) == 0) & (size > 1) & ~letters
        kinds = [np.flatnonzero(letters), np.flatnonzero(plain), np.flatnonzero(~letters & ~plain)]
        alone = kinds[2]
        parts = [
            self._spelled(data, starts[kinds[0]], size[kinds[0]]),
            self._in_one(data, starts[kinds[1]], size[kinds[1]]),
            self._library([data[i:j].tobytes().decode() for i, j in zip(starts[alone], ends[alone])]),
        ]
        sizes, begin, before = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for kind, (ids, counts) in zip(kinds, parts):
            sizes[kind], begin[kind] = counts, before + np.cumsum(counts) - counts
            before += len(ids)
        return np.concatenate([ids for ids, _ in parts])[ranges(begin, sizes)], sizes

    def _spelled(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one piece: spelled as the vocabulary does it, and divided by line ends."""
        stops = np.cumsum(size + 1)
        text = np.full(int(stops[-1]) if len(stops) else 0, ord("\n"), np.uint32)
        text[ranges(stops - size - 1, size)] = _SPELLED[data[ranges(starts, size)]]
        ids, _ = self._library([text[i : j - 1].tobytes().decode("utf-32-le") for i, j in _cuts(stops)], True)
        return ids, self._counts(ids, size)

    def _in_one(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with the only blank in them, one after another."""
        text = data[ranges(starts, size)]
        ids, _ = self._library([text[i:j].tobytes().decode() for i, j in _cuts(np.cumsum(size))])
        return ids, self._counts(ids, size)

    def _counts(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many ids each word has, by the bytes they stand for."""
        token_ends, word_ends = np.cumsum(self.length[ids]), np.cumsum(size)
        upto = np.searchsorted(token_ends, word_ends, side="right")
        if len(size) and not np.array_equal(token_ends[upto - 1], word_ends):
            raise ValueError("the tokenizer does not write each byte as one character")
        return np.diff(upto, prepend=0)


def _cuts(stops: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about ``LIBRARY_CHARS`` that end at one of ``stops``."""
    if not len(stops):
        return []
    ends = np.append(stops[np.searchsorted(stops, np.arange(LIBRARY_CHARS, stops[-1], LIBRARY_CHARS))], stops[-1])
    ends = np.unique(ends).tolist()
    return list(zip([0, *ends], ends))


# Characters of a text that count as one piece when the dictionary is trained.
SLICE_CHARS = 16_384


def _utf8(words: pa.Array) -> pa.Array:
    """Words in UTF-32 as words in UTF-8."""
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) // 4
    points = np.frombuffer(words.buffers()[2], np.uint32, int(bounds[-1]))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    cuts = np.append(0, np.cumsum(width))[bounds]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(points.tobytes().decode("utf-32-le").encode())]
    )


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _dictionary(path: str, spark: SparkSession) -> bytes:
    row = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/dictionary").first()
    return bytes(row["content"])[:-1] if row else b""


def _hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _codec(kind, dictionary: bytes, **options):
    data = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return kind(**data, **options)


def _with_end(tool: Encoder, run: list[str], end_id: int) -> list[bytes]:
    """The ids of each text and the end, as bytes."""
    ids, counts = tool.encode(run)
    flat = ids.astype(f"<u{tool.width}").tobytes()
    end = end_id.to_bytes(tool.width, "little")
    stops = (np.cumsum(counts) * tool.width).tolist()
    return [flat[i:j] + end for i, j in zip([0, *stops], stops)]


def _small_runs(column: pa.Array, chars: int = RUN_CHARS) -> Iterator[list[str]]:
    run, size = [], 0
    for text in column:
        run.append(text.as_py())
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def sampled_pieces(base: DataFrame, slices: int) -> DataFrame:
    """``text`` of up to ``slices`` pieces, every piece of every text as likely to be taken as any other.

    Texts count in pieces of ``SLICE_CHARS`` characters at most. A hash decides which are
    looked at, a tenth more than wanted whatever the size of ``base``.
    """
    pieces = F.ceil(F.char_length("text") / SLICE_CHARS).cast("int")
    all_pieces = base.agg(F.sum(pieces.cast("bigint"))).first()[0] or 0
    share = min(1.0, 1.1 * (slices + 50) / max(all_pieces, 1))

    def place(k: Column) -> Column:
        return F.xxhash64("did", "th", k).bitwiseAND(2**63 - 1)

    taken = F.filter(F.sequence(F.lit(0), pieces - 1), lambda k: place(k) <= F.lit(min(int(share * 2**63), 2**63 - 1)))
    piece = F.substring("text", F.col("k") * SLICE_CHARS + 1, F.lit(SLICE_CHARS)).alias("text")
    return (
        base.where("text <> ''").withColumn("taken", taken).where("size(taken) > 0")
        .select("did", "th", "text", F.explode("taken").alias("k")).select(place(F.col("k")).alias("at"), piece)
        .orderBy("at", "text").limit(slices).select("text")
    )


def train_dictionary(base: DataFrame, tokenizer_path: str, end_id: int, slices: int, size: int) -> tuple[int, bytes]:
    """Bytes per id, and a dictionary of ``size`` bytes from the ids of ``slices`` pieces of text, in one task."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        samples = []
        for batch in batches:
            for run in _small_runs(batch.column("text")):
                samples += _with_end(tool, run, end_id)
        dictionary = b""
        if len(samples) >= 50:
            try:
                dictionary = zstandard.train_dictionary(size, samples, level=3).as_bytes()
            except zstandard.ZstdError:  # too little to learn from
                pass
        yield pa.record_batch([pa.array([tool.width]), pa.array([dictionary], pa.binary())], names=["width", "dictionary"])

    trained = sampled_pieces(base, slices).coalesce(1).mapInArrow(train, "width bigint, dictionary binary").collect()
    if not trained:  # Spark leaves out what it knows to be empty

        def width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([encoder(tokenizer_path).width] * batch.num_rows)], names=["width"])

        return base.sparkSession.range(0, 1, 1, 1).mapInArrow(width, "width bigint").first()["width"], b""
    return trained[0]["width"], bytes(trained[0]["dictionary"])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    dictionary_slices: int = 1000,
    dictionary_bytes: int = 65536,
    shard_bytes: int = 8_000_000,
    partition_bytes: int = 32_000_000,
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending order of ids.

    A null or empty text has the end id alone. A null id comes last. Rows with
    equal ids are all written, ordered by their content. No rows: no shards. What the tokenizer
    knows as a special token is one in a text too, as the library does it by itself. The
    dictionary is trained on ``dictionary_slices`` pieces of the texts, long ones included.
    The tokenizer's file must be at ``tokenizer_path`` on every machine.
    """
    spark = docs.sparkSession
    ship(spark)
    base = texts(docs, id_column, text_column)
    width, dictionary = train_dictionary(base, tokenizer_path, end_id, dictionary_slices, dictionary_bytes)
    (
        spark.createDataFrame([(bytearray(dictionary),)], "content binary").coalesce(1)
        .select(F.col("content").cast("string").alias("value")).write.text(f"{path}/dictionary")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        pack = _codec(zstandard.ZstdCompressor, dictionary, level=3)
        for batch in batches:
            at = 0
            for run in _small_runs(batch.column("text")):
                ids = _with_end(tool, run, end_id)
                yield pa.record_batch(
                    [batch.column("did").slice(at, len(run)),
                     pa.array([len(x) // tool.width for x in ids], pa.int64()),
                     pa.array([pack.compress(x) for x in ids], pa.binary())],
                    names=["did", "n", "frame"],
                )
                at += len(run)

    frames, size = measured(
        base.select("did", "text").mapInArrow(encode, "did bigint, n bigint, frame binary"),
        "frames", bytes=F.sum(F.length("frame")),
    )
    partitions = int((size["bytes"] or 0) // partition_bytes) + 1
    stamp = _hash(dictionary)

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        shard, before = 0, 0
        dids: list[int] = []
        counts: list[int] = []
        packed: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
            head = struct.pack(HEADER, MAGIC, 1, width, partition, shard, len(dids), before, sum(counts), stamp)
            parts = [head, np.array(dids, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *packed]
            return pa.record_batch([pa.array([b"".join(parts)], pa.binary())], names=["content"])

        for batch in batches:
            for did, n, frame in zip(*(batch.column(c).to_pylist() for c in ("did", "n", "frame"))):
                dids.append(did)
                counts.append(n)
                packed.append(frame)
                held += len(frame) + 24
                if held >= shard_bytes:
                    yield closed()
                    shard, before = shard + 1, before + sum(counts)
                    dids, counts, packed, held = [], [], [], 0
        if dids:
            yield closed()

    order = ["did", F.xxhash64("frame")]
    (
        frames.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .mapInArrow(pack_shards, "content binary")
        .select(F.col("content").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1).text(f"{path}/shards")
    )


def _index(content: bytes) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, int]:
    head = struct.unpack_from(HEADER, content)
    if head[0] != MAGIC:
        raise ValueError("not a shard")
    n, at = head[5], struct.calcsize(HEADER)
    dids = np.frombuffer(content, "<i8", n, at)
    counts = np.frombuffer(content, "<u8", n, at + 8 * n)
    offsets = np.frombuffer(content, "<u8", n + 1, at + 16 * n)
    return head, dids, counts, offsets, at + 24 * n + 8


def document_ids(content: bytes, dictionary: bytes, doc_id: int) -> np.ndarray:
    """The ids of one document of a shard; decompresses only that document."""
    head, dids, counts, offsets, start = _index(content)
    if head[8] != _hash(dictionary):
        raise ValueError("the shard was written with another dictionary")
    at = int(np.searchsorted(dids, doc_id))
    if at == len(dids) or dids[at] != doc_id:
        raise KeyError(doc_id)
    frame = content[start + int(offsets[at]) : start + int(offsets[at + 1])]
    data = _codec(zstandard.ZstdDecompressor, dictionary).decompress(frame, int(counts[at]) * head[2])
    return np.frombuffer(data, f"<u{head[2]}")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
        .load(f"{path}/shards").select("content")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the shards below ``path``.

    ``start`` is the number of ids of all documents before it, and ``ids`` holds
    the ids as unsigned 32-bit little-endian integers. A shard written with
    another dictionary, or whose document has another length than stated, raises.
    """
    ship(spark)
    dictionary = _dictionary(path, spark)
    stamp = _hash(dictionary)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack_from(HEADER, c.as_buffer()) for c in batch.column("content")]
            yield pa.record_batch(
                [pa.array([h[3] for h in found], pa.int64()), pa.array([h[7] for h in found], pa.int64())],
                names=["partition", "ids"],
            )

    # One row for each partition the shards were written by.
    totals = (
        _shards(spark, path).mapInArrow(heads, "partition bigint, ids bigint")
        .groupBy("partition").agg(F.sum("ids").alias("ids")).orderBy("partition").collect()
    )
    bases, before = {}, 0
    for row in totals:
        bases[row["partition"]], before = before, before + row["ids"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(zstandard.ZstdDecompressor, dictionary)
        for batch in batches:
            for cell in batch.column("content"):
                content = cell.as_py()
                head, dids, counts, offsets, first = _index(content)
                if head[8] != stamp:
                    raise ValueError("the shard was written with another dictionary")
                starts = np.cumsum(np.append(0, counts[:-1])).astype(np.int64) + head[6] + bases[head[3]]
                done, size, ids = 0, 0, []
                for i in range(len(dids)):
                    frame = content[first + int(offsets[i]) : first + int(offsets[i + 1])]
                    data = unpack.decompress(frame, int(counts[i]) * head[2])
                    if len(data) != int(counts[i]) * head[2]:
                        raise ValueError(f"document {dids[i]} has another length")
                    ids.append(np.frombuffer(data, f"<u{head[2]}").astype("<u4").tobytes())
                    size += len(ids[-1])
                    if size > 4_000_000 or i + 1 == len(dids):
                        yield pa.record_batch(
                            [pa.array(dids[done : i + 1]), pa.array(starts[done : i + 1]),
                             pa.array(counts[done : i + 1].astype(np.int64)), pa.array(ids, pa.binary())],
                            names=["did", "start", "n_tokens", "ids"],
                        )
                        done, size, ids = i + 1, 0, []

    found = _shards(spark, path).mapInArrow(parse, "did bigint, start bigint, n_tokens bigint, ids binary")
    return found.select(own_id("did").alias("doc_id"), "start", "n_tokens", "ids")
