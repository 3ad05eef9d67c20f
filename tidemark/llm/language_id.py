"""Language of documents: text, declared language, address and host weighed together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import NO_ID, join_counted, own_id
from tidemark.llm.shipping import ship
from tidemark.llm.words import LOWER
from tidemark.storage import measured

BUCKETS = 2**16
UNKNOWN = "und"
SLICE = 500_000


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of texts, each between blanks, and where each text starts."""
    data = np.frombuffer(b"".join(b" " + t.translate(LOWER.tobytes()) + b"  " for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + 3 for t in texts])
    starts = np.cumsum(sizes) - sizes
    codes = np.zeros(len(data), np.uint32)
    codes[:-2] = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    inside = np.ones(len(data), bool)
    ends = starts + sizes
    inside[ends - 1] = inside[ends - 2] = False
    return ((codes[inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), starts - 2 * np.arange(len(texts))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    run, first, size = [], 0, 0
    for i, cell in enumerate(column):
        run.append(cell.as_py().encode())
        size += len(run[-1])
        if size >= SLICE or i + 1 == len(column):
            yield first, run
            run, first, size = [], i + 1, 0


def evidence(
    docs: DataFrame, id_column: str, text_column: str, declared: Column | None, address: Column | None
) -> DataFrame:
    """``did, th, text, declared, host, suffix``; what is missing is empty."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    language = F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})\b", 1)) if declared is not None else F.lit("")
    place = F.coalesce(address.cast("string"), F.lit("")) if address is not None else F.lit("")
    host = F.lower(F.regexp_extract(place, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return docs.select(
        F.coalesce(docs[id_column].cast("bigint"), F.lit(NO_ID)).alias("did"), text.alias("text"),
        language.alias("declared"), host.alias("host"),
    ).select(
        "did", F.xxhash64("text").alias("th"), "text", "declared", "host",
        F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("").alias("suffix"),
    )


def declared_in_markup(html: Column) -> Column:
    """The value of the ``lang`` attribute of the ``html`` element, or null."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.nullif(found, F.lit(""))


def _train(rows: DataFrame, languages: Sequence[str], sample: int) -> np.ndarray:
    """log probabilities of trigram buckets: a column per language, and one for no language."""
    counts = {r["declared"]: r["count"] for r in rows.where(F.col("declared").isin(*languages)).groupBy("declared").count().collect()}
    part = F.lit(0)
    for language, n in counts.items():
        part = F.when(F.col("declared") == language, F.lit(int(min(1.0, sample / n) * 2**20))).otherwise(part)
    chosen = rows.where(F.pmod(F.xxhash64("did", "th"), F.lit(2**20)) < part)
    index = {language: i for i, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            names = batch.column("declared").to_pylist()
            for first, run in _slices(batch.column("text")):
                codes, starts = _trigrams(run)
                owner = np.repeat([index[n] for n in names[first : first + len(run)]], np.diff(np.append(starts, len(codes))))
                total += np.bincount(owner * BUCKETS + codes, minlength=total.size).reshape(total.shape)
        language, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(language), pa.array(bucket), pa.array(total[language, bucket])], names=["language", "bucket", "n"])

    summed = (
        chosen.select("text", "declared").mapInArrow(count, "language bigint, bucket bigint, n bigint")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    table = np.full((BUCKETS, len(languages) + 1), 0.5)
    table[summed.column("bucket").to_numpy(), summed.column("language").to_numpy()] += summed.column("n").to_numpy()
    table[:, -1] = 1  # no language: every trigram alike
    return np.log(table / table.sum(0)).astype(np.float32)


def language_id(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    declared: Column | None = None,
    address: Column | None = None,
    languages: Sequence[str] = ("en", "de", "fr", "es"),
    sample: int = 2000,
    tempering: float = 0.25,
    strength: float = 20.0,
    min_posterior: float = 0.5,
) -> DataFrame:
    """The most probable language of each document, and whether it is certain enough to keep.

    Returns ``doc_id, language, posterior, text_language, declared, host, kept, th`` (hash
    of the text): one row per row of ``docs``. ``declared`` is a column with a declared language (such as
    :func:`declared_in_markup`), ``address`` one with a URL or host. Four things are weighed:

    * the text's byte trigrams under a model of each language, trained on about ``sample``
      documents of each declared language, and under ``und``, where all trigrams are alike;
      neighbouring trigrams overlap, so their log likelihood counts by ``tempering``;
    * the declared language, by how often documents of a language declare it;
    * the language mix of the address suffix, drawn to that of all documents;
    * the language mix of the host, drawn to that of its suffix with the weight of
      ``strength`` documents. A document's own share is left out of both.

    A document is kept if its best language is not ``und`` and has ``min_posterior`` or
    more. Texts without letters, null ones included, are ``und``. Missing or unknown
    declarations and addresses weigh nothing against any language. A null id comes back
    as null, repeated rows get equal results, and no rows give none.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = evidence(docs, id_column, text_column, declared, address)
    shared = spark.sparkContext.broadcast(_train(rows, languages, sample))
    k = len(languages)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, run in _slices(batch.column("text")):
                codes, starts = _trigrams(run)
                logs = np.add.reduceat(table[codes], starts, axis=0).astype(float) * tempering
                part = batch.slice(first, len(run)).drop_columns(["text"])
                yield pa.record_batch(
                    [*part.columns, _lists(logs), _lists(_posterior(logs))], names=[*part.schema.names, "logs", "q"]
                )

    has_letters = F.col("text").rlike(r"\p{L}").alias("letters")
    evident = "did bigint, th bigint, declared string, host string, suffix string, letters boolean, logs array<double>, q array<double>"
    shares = [F.sum(F.get("q", i)) for i in range(k + 1)]
    scored, size = measured(
        rows.select("did", "th", "declared", "host", "suffix", has_letters, "text").mapInArrow(weigh, evident),
        "languages", n=F.count("*"), **{f"q{i}": x for i, x in enumerate(shares)},
    )
    shared.destroy()
    total = size["n"] or 0
    mix = np.array([((size[f"q{i}"] or 0.0) + 1.0) / (total + k + 1) for i in range(k + 1)])

    def totals(key: str, label: str) -> DataFrame:
        summed = scored.groupBy(key).agg(F.count("*").alias(f"n_{label}"), F.array(*shares).alias(label))
        return measured(summed, f"by-{key}")[0]

    # What documents of each language declare: a row for each language, and one for all else.
    code = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.lit(""))
    stated = {r["code"]: np.array(r["q"]) for r in scored.groupBy(code.alias("code")).agg(F.array(*shares).alias("q")).collect()}
    counts = np.array([stated.get(name, np.zeros(k + 1)) for name in languages])
    told = dict(zip(languages, np.log((counts + 1) / (counts.sum(0) + k))))
    names = np.array([*languages, UNKNOWN])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, q, h, s = (_matrix(batch.column(c), k + 1) for c in ("logs", "q", "h", "s"))
            n_h, n_s = (batch.column(c).to_numpy()[:, None] for c in ("n_h", "n_s"))
            of_suffix = (np.maximum(s - q, 0) + strength * mix) / (n_s - 1 + strength)
            of_host = (np.maximum(h - q, 0) + strength * of_suffix) / (n_h - 1 + strength)
            declared_logs = np.array([told.get(d, np.zeros(k + 1)) for d in batch.column("declared").to_pylist()]).reshape(-1, k + 1)
            f = _posterior(logs + declared_logs + np.log(of_host))
            letters = np.array(batch.column("letters"))
            language = np.where(letters, names[f.argmax(1)], UNKNOWN)
            by_text = np.where(letters, names[q.argmax(1)], UNKNOWN)
            posterior = f.max(1)
            kept = (language != UNKNOWN) & (posterior >= min_posterior)
            yield pa.record_batch(
                [batch.column("did"), pa.array(language.tolist(), pa.string()), pa.array(posterior),
                 pa.array(by_text.tolist(), pa.string()), batch.column("declared"), batch.column("host"), pa.array(kept), batch.column("th")],
                names=["did", "language", "posterior", "text_language", "declared", "host", "kept", "th"],
            )

    hosted = join_counted(scored, totals("host", "h"), ["host"], "n_h", total)
    joined = join_counted(hosted, totals("suffix", "s"), ["suffix"], "n_s", total)
    found = joined.select("did", "th", "declared", "host", "letters", "logs", "q", "h", "n_h", "s", "n_s").mapInArrow(
        fuse, "did bigint, language string, posterior double, text_language string, declared string, host string, kept boolean, th bigint"
    )
    return found.withColumn("did", own_id("did")).withColumnRenamed("did", "doc_id")


def _posterior(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)
