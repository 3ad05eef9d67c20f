"""Context-tree weighting over bytes: the probability of a text in bits.

The next byte is eight binary choices, and each choice has a tree of contexts:
none, the last byte, the last two bytes, and so on to ``depth``. Every node holds a
Krichevsky-Trofimov estimate, and a text is scored by the mixture of all depths that
the training counts make most plausible.

The counts are those of all byte n-grams of the corpus. The trees fall apart into
the subtrees below each three last bytes, which tasks weight by themselves; only
the part above them (at most 2^24 nodes, whatever the corpus) meets on the driver.
The outcome is one log probability per n-gram. It is sent to every task while it has
no more than ``SENT_GRAMS`` rows, and joined to the documents' n-grams beyond that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import NO_ID, own_id, texts
from tidemark.llm.shipping import ship, small_batches
from tidemark.llm.words import LOWER
from tidemark.storage import measured, written

# Words that are more than one token in so many are scored in place; so there are at most so many.
COMMON_SHARE = 400_000
LOWER_BYTES = LOWER.tobytes()
# Bytes looked at together within a task.
SLICE = 1_000_000
# A table of n-grams up to this size (100 MB) is sent to the tasks.
SENT_GRAMS = 2**23
# N-grams that one task weights together.
TASK_GRAMS = 100_000


def training(did: Column, folds: int = 7, held_out: int = 2) -> Column:
    """Whether a document is learned from, by the CRC-32 of its id as text (null: no text)."""
    name = F.when(did == NO_ID, F.lit("")).otherwise(did.cast("string"))
    return F.crc32(name) % folds != held_out


def _grams(column: pa.Array, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, n-grams (context and next byte) of some texts, and where each text starts.

    Zero bytes stand before a text, and one zero byte after it is its end.
    """
    run, first, size = [], 0, 0
    for i, cell in enumerate(column):
        text = cell.as_py().encode().translate(LOWER_BYTES)
        run.append(text)
        size += len(text)
        if size >= SLICE or i + 1 == len(column):
            pad = bytes(depth)
            data = np.frombuffer(b"".join(pad + text + b"\0" for text in run), np.uint8).astype(np.uint64)
            starts = np.cumsum([0, *(len(text) + 1 + depth for text in run[:-1])])
            grams = np.zeros(len(data), np.uint64)
            for back in range(depth + 1):
                grams[depth:] |= data[depth - back : len(data) - back] << np.uint64(8 * back)
            inside = np.ones(len(data), bool)
            for at in range(depth):
                inside[starts + at] = False
            yield first, grams[inside].view(np.int64), starts - depth * np.arange(len(run))
            run, first, size = [], i + 1, 0


def _count_grams(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        learned = batch.column("learned")
        for learn in (True, False):
            texts_ = batch.column("text").filter(pc.equal(learned, learn))
            values, n = [], []
            for _, grams, _ in _grams(texts_, depth):
                counts = pc.value_counts(pa.array(grams))
                values.append(counts.field("values").to_numpy())
                n.append(counts.field("counts").to_numpy())
            if values:
                distinct, which = np.unique(np.concatenate(values), return_inverse=True)
                # What is only to be scored counts nothing but needs a probability.
                total = np.bincount(which, np.concatenate(n)).astype(np.int64) * learn
                yield pa.record_batch([pa.array(distinct), pa.array(total)], names=["gram", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for cell in batch.column("text"):
            counts.update(cell.as_py().encode().translate(LOWER_BYTES).split())
        counts[b""] = batch.num_rows  # no word is empty: the end of a text
        yield pa.record_batch(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["token", "c"],
        )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive values, by Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    inverse = 1 / x
    series = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_keys, keys)


@dataclass
class Level:
    """Nodes of one depth. A key is a context and, in its low byte, a choice.

    Choice 1 is the first bit of the next byte, choices 2 and 3 are the second bit
    after a 0 or a 1, and so on.
    """

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray  # log of the weighted probability of all counts here
    stop: np.ndarray  # posterior weight of the estimate of this depth

    @property
    def p(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def _level(keys, zeros, ones, below=None) -> Level:
    kt = _kt(zeros, ones)
    if below is None:
        return Level(keys, zeros, ones, kt, np.ones(len(keys)))
    weight = np.logaddexp(kt, below) - np.log(2)
    return Level(keys, zeros, ones, weight, np.exp(kt - np.log(2) - weight))


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes one depth up: contexts without their oldest byte."""
    return keys & ((1 << (8 * depth)) - 1)


def _above(level: Level, depth: int) -> Level:
    keys, which = np.unique(_shorter(level.keys, depth), return_inverse=True)
    total = lambda x: np.bincount(which, x, len(keys))
    return _level(keys, total(level.zeros), total(level.ones), total(level.weight))


def _paths(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node keys at full depth and the bits taken there, eight rows for the eight choices."""
    byte = grams & 255
    keys = np.stack([((grams >> 8) << 8) | ((256 | byte) >> (8 - bit)) for bit in range(8)])
    return keys, np.stack([(byte >> (7 - bit)) & 1 for bit in range(8)])


def _subtrees(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[dict[int, Level], np.ndarray, np.ndarray]:
    """Levels ``depth`` to 3 of the context trees of these n-grams; their paths."""
    paths, bits = _paths(grams)
    keys, which = np.unique(paths, return_inverse=True)
    which = which.reshape(paths.shape)
    n = np.broadcast_to(n, bits.shape)
    ones = np.bincount(which.ravel(), (n * bits).ravel(), len(keys))
    levels = {depth: _level(keys, np.bincount(which.ravel(), n.ravel(), len(keys)) - ones, ones)}
    for d in range(depth - 1, 2, -1):
        levels[d] = _above(levels[d + 1], d + 1)
    return levels, which, bits


def _from_table(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pa.Table.from_batches(held)
    return table.column("gram").to_numpy(), table.column("n").to_numpy()


def _tops(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """What the subtrees of a task add to the nodes at depth 2."""
    grams, n = _from_table(batches)
    if len(grams):
        top = _subtrees(grams, n, depth)[0][3]
        keys, which = np.unique(_shorter(top.keys, 3), return_inverse=True)
        columns = [np.bincount(which, x, len(keys)) for x in (top.zeros, top.ones, top.weight)]
        yield pa.record_batch([pa.array(x) for x in (keys, *columns)], names=["key", "zeros", "ones", "below"])


class Top:
    """The mixture of depths 0 to 2 at each node of depth 2, and the weight left for deeper ones."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        two = _level(keys, zeros, ones, below)
        one = _above(two, 2)
        none = _above(one, 1)
        up = _place(none.keys, _shorter(one.keys, 1))
        done = none.stop[up] * none.p[up]
        left = 1 - none.stop[up]
        done, left = done + left * one.stop * one.p, left * (1 - one.stop)
        up = _place(one.keys, _shorter(two.keys, 2))
        self.keys = two.keys
        self.done = done[up] + left[up] * two.stop * two.p
        self.left = left[up] * (1 - two.stop)


def _weigh(batches: Iterator[pa.RecordBatch], depth: int, top: Top) -> Iterator[pa.RecordBatch]:
    """log10 probability of the next byte of each n-gram."""
    grams, n = _from_table(batches)
    if not len(grams):
        return
    levels, which, bits = _subtrees(grams, n, depth)
    keys, done, left = top.keys, top.done, top.left
    for d in range(3, depth + 1):
        level = levels[d]
        up = _place(keys, _shorter(level.keys, d))
        done = done[up] + left[up] * level.stop * level.p
        left, keys = left[up] * (1 - level.stop), level.keys
    p = done[which]
    logs = np.log10(np.where(bits == 1, p, 1 - p)).sum(0)
    for part in np.array_split(np.arange(len(grams)), len(grams) // 100_000 + 1):
        yield pa.record_batch([pa.array(grams[part]), pa.array(logs[part])], names=["gram", "logp"])


def gram_probabilities(counts: DataFrame, depth: int, n_grams: int) -> DataFrame:
    """``gram, logp`` for ``counts(gram, n)``, written."""
    # The three last bytes of the context name the subtree; with a depth of 5 it holds 2^24 n-grams at most.
    tasks = max(n_grams // TASK_GRAMS + 1, 1)
    dealt = counts.repartition(tasks, F.col("gram").bitwiseAND(0xFFFFFF00))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tops(batches, depth)

    parts = (
        dealt.mapInArrow(tops, "key bigint, zeros double, ones double, below double")
        .groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
        .toArrow()
    )
    order = np.argsort(parts.column("key").to_numpy())
    top = Top(*(parts.column(c).to_numpy()[order] for c in ("key", "zeros", "ones", "below")))
    shared = counts.sparkSession.sparkContext.broadcast(top)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _weigh(batches, depth, shared.value)

    weighted = written(dealt.mapInArrow(weigh, "gram bigint, logp double"), "weighted")
    shared.destroy()
    return weighted


def lm_score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    folds: int = 7, held_out: int = 2, depth: int = 5, sent_grams: int = SENT_GRAMS,
) -> DataFrame:
    """Score every text by a model of the texts outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``: one row per row of ``docs``. ``score`` is the model's log10
    probability of the text and its end, A-Z in lower case, and ``bits_per_byte`` the
    code length this gives per byte (end included). ``base_score`` is the add-one unigram
    score of its words and their end. A null text is empty. Nothing to learn from gives
    even odds and a base of 0 known words. A null id is learned from unless the CRC-32 of
    the empty text falls into the held-out fold. Repeated rows score alike and all count.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, 4000)  # as many texts as fit easily, not too few n-grams
    base = texts(docs, id_column, text_column)
    learned = base.where(training(F.col("did"), folds, held_out)).select("text")
    both = base.withColumn("learned", training(F.col("did"), folds, held_out))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_grams(batches, depth)

    counts, seen = measured(
        both.select("text", "learned").mapInArrow(count_grams, "gram bigint, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")),
        "grams", n=F.count("*"),
    )
    n_grams = seen["n"] or 0
    logs = gram_probabilities(counts, depth, n_grams) if n_grams else counts.select("gram", F.lit(0.0).alias("logp"))
    vocabulary, size = measured(
        learned.mapInArrow(_count_words, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c")),
        "vocabulary", tokens=F.sum("c"), distinct=F.count("*"),
    )
    total, distinct = size["tokens"] or 0, size["distinct"] or 0
    common = vocabulary.where(F.col("c") > total // COMMON_SHARE).toArrow()
    known = dict(zip(common.column("token").to_pylist(), np.log10(common.column("c").to_numpy() + 1.0).tolist()))
    end_known = b"" in known or total > 0
    end_score = known.pop(b"", 0.0)
    if end_known and not end_score:
        rest = vocabulary.where("token = X''").select("c").first()
        end_score = float(np.log10(rest["c"] + 1.0))
    sent = n_grams <= sent_grams
    if sent:
        held = logs.toArrow()
        order = np.argsort(held.column("gram").to_numpy())
        model = (held.column("gram").to_numpy()[order], held.column("logp").to_numpy()[order])
    else:
        model = None
    shared = spark.sparkContext.broadcast((model, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for batch in batches:
            yield from _score(batch, depth, model, known)

    scored, _ = measured(
        base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            score, "row bigint, did bigint, th bigint, score double, bytes bigint, words bigint, n_known bigint, "
            "known double, rare array<binary>, n array<int>",
        ),
        "scores",
    )
    shared.destroy()
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "n")).alias("x"))
        .select("row", F.col("x.rare").alias("token"), F.col("x.n").alias("n"))
        .join(vocabulary.where(F.col("c") <= total // COMMON_SHARE), "token")
        .groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_score"))
    )
    if not sent:
        # Too large a model to send: the n-grams of each text meet it in a join.
        joined = _joined_scores(scored.select("row", "did", "th"), base, logs, depth)
        scored = scored.drop("score").join(joined, "row")
    n_tokens = F.col("words") + 1
    return scored.drop("rare", "n").join(rare, "row", "left").select(
        own_id("did").alias("doc_id"), (~training(F.col("did"), folds, held_out)).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(end_known))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("known") + F.coalesce("rare_score", F.lit(0.0)) + F.lit(float(end_score))
         - n_tokens * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score", (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )


def _joined_scores(rows: DataFrame, base: DataFrame, logs: DataFrame, depth: int) -> DataFrame:
    """``row, score`` by a join of each text's distinct n-grams with their probabilities."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, grams, starts in _grams(batch.column("text"), depth):
                for i, own in enumerate(np.split(grams, starts[1:])):
                    values, n = np.unique(own, return_counts=True)
                    ids = [pa.array(np.full(len(values), batch.column(c)[first + i].as_py())) for c in ("did", "th")]
                    yield pa.record_batch([*ids, pa.array(values), pa.array(n)], names=["did", "th", "gram", "n"])

    scores = (
        base.dropDuplicates(["did", "th"]).mapInArrow(spread, "did bigint, th bigint, gram bigint, n bigint")
        .join(logs, "gram").groupBy("did", "th").agg(F.sum(F.col("n") * F.col("logp")).alias("score"))
    )
    return rows.join(scores, ["did", "th"]).select("row", "score")


def _score(batch: pa.RecordBatch, depth: int, model, known: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    column = batch.column("text")
    for first, grams, starts in _grams(column, depth):
        sizes = np.diff(np.append(starts, len(grams)))
        if model is None:
            sums = np.zeros(len(starts))
        else:
            coded = pa.array(grams).dictionary_encode()
            logs = model[1][_place(model[0], coded.dictionary.to_numpy())]
            sums = np.add.reduceat(logs[coded.indices.to_numpy()], starts)
        rows = []
        for cell in column.slice(first, len(starts)):
            words = Counter(cell.as_py().encode().translate(LOWER_BYTES).split())
            total, found, value = 0, 0, 0.0
            rare, n = [], []
            for word, times in words.items():
                total += times
                if (weight := known.get(word)) is None:
                    rare.append(word)
                    n.append(times)
                else:
                    found += times
                    value += times * weight
            rows.append((total, found, value, rare, n))
        total, found, value, rare, n = zip(*rows)
        yield pa.record_batch(
            [*(batch.column(c).slice(first, len(starts)) for c in ("row", "did", "th")), pa.array(sums), pa.array(sizes), pa.array(total, pa.int64()), pa.array(found, pa.int64()),
             pa.array(value, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(n, pa.list_(pa.int32()))],
            names=["row", "did", "th", "score", "bytes", "words", "n_known", "known", "rare", "n"],
        )
