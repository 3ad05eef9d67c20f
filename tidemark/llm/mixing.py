"""Rates for documents that bring the expected tokens of each domain to target totals."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import NO_ID, own_id
from tidemark.storage import measured

# Word features fall into so many buckets of each kind; this bounds the classifier.
BUCKETS = 2**14
# Labelled documents the classifier is fitted on, at most (those with the least hashes).
SAMPLE = 20_000
# A feature counts for a domain if its documents are so many standard deviations from what is expected.
CLEAR = 5.0
# Documents added to those with a feature and to those expected.
SHRINK = 5.0
SPACES = r"[\x20\x09-\x0D]+"


def domain_of_labels() -> Column:
    """``toxic``, ``low`` or ``good`` from the columns of the label table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(
        F.col("quality") == 1, "good"
    )


def _words(rows: DataFrame) -> DataFrame:
    """A row per word with its two features: the word, and how it ends."""
    word = F.col("word")
    return (
        rows.select(*[c for c in rows.columns if c != "text"], F.explode(F.split("text", SPACES)).alias("word"))
        .where("word <> ''")
        .select(
            *[c for c in rows.columns if c != "text"],
            F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int").alias("whole"),
            F.pmod(F.xxhash64(F.right(word, F.lit(3))), F.lit(BUCKETS)).cast("int").alias("ending"),
        )
    )


class Classifier:
    """Naive Bayes over word features; ``weights[kind][domain]`` are log ratios to the first domain."""

    def __init__(self, domains: list[str], prior: list[float], weights: dict[str, np.ndarray]):
        self.domains, self.prior, self.weights = domains, prior, weights


def fit(rows: DataFrame, labels: DataFrame, domain: Column, label_id: str, domains: list[str], sample: int) -> Classifier:
    """Count features per domain on a bounded sample of the labelled documents.

    Labels without id or domain are left out. Documents labelled several times
    count for each domain once.
    """
    known = labels.select(F.col(label_id).cast("bigint").alias("did"), domain.alias("domain"))
    known = known.where(F.col("did").isNotNull() & F.col("domain").isin(*domains)).distinct()
    chosen = known.orderBy(F.xxhash64("did"), "did", "domain").limit(sample)
    chosen = measured(chosen, "labelled")[0]  # at most ``sample`` rows, so it can be sent
    labelled = rows.join(F.broadcast(chosen), "did").select("domain", "th", "text")
    labelled = labelled.dropDuplicates(["domain", "th"])  # copies are no further evidence
    words = _words(labelled)
    found = labelled.groupBy("domain").count().toArrow()
    documents = np.zeros(len(domains))
    documents[[domains.index(d) for d in found.column("domain").to_pylist()]] = found.column("count").to_numpy()
    total = max(documents.sum(), 1)
    weights = {}
    for kind in ("whole", "ending"):
        counts = np.zeros((len(domains), BUCKETS))
        holding = words.select("domain", "th", kind).distinct().groupBy("domain", kind).count()
        found = holding.toArrow()  # domains x buckets at most
        at = [domains.index(d) for d in found.column("domain").to_pylist()]
        counts[at, found.column(kind).to_numpy()] = found.column("count").to_numpy()
        # In how many more documents of a domain than in those of all; chance differences say nothing.
        expected = counts.sum(0) / total * documents[:, None]
        clear = np.abs(counts - expected) > CLEAR * np.sqrt(expected + 1)
        logs = np.where(clear, np.log((counts + SHRINK) / (expected + SHRINK)), 0.0)
        # All other words are one feature: the more clear ones a domain has, the fewer of these.
        found = words.groupBy("domain", kind).count().toArrow()
        shares = np.zeros((len(domains), BUCKETS))
        at = [domains.index(d) for d in found.column("domain").to_pylist()]
        shares[at, found.column(kind).to_numpy()] = found.column("count").to_numpy()
        other = shares[:, ~clear.any(0)].sum(1)
        logs[:, ~clear.any(0)] = np.log((other + SHRINK) / (shares.sum(1) + SHRINK))[:, None]
        weights[kind] = logs - logs[:1]  # against the first domain
    prior = np.log((documents + 1) / (documents.sum() + len(domains))).tolist()
    return Classifier(domains, prior, weights)


def _constant(values: np.ndarray) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(f"{x:.5f}" for x in values)), ",").cast("array<double>")


def posteriors(rows: DataFrame, model: Classifier) -> DataFrame:
    """``row, did, th, tokens, p0, p1, ...``: words of each row and its domain posteriors."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    words = _words(numbered.select("row", "text"))
    sums = [F.count("*").alias("tokens")]
    for i in range(1, len(model.domains)):
        tables = [F.get(_constant(model.weights[kind][i]), F.col(kind)) for kind in ("whole", "ending")]
        sums.append(F.sum(tables[0] + tables[1]).alias(f"l{i}"))
    scored = words.groupBy("row").agg(*sums)
    logs = [F.lit(model.prior[0])] + [
        F.coalesce(f"l{i}", F.lit(0.0)) + model.prior[i] for i in range(1, len(model.domains))
    ]
    joined = numbered.select("row", "did", "th").join(scored, "row", "left")
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    total = reduce(Column.__add__, weights)
    return joined.select(
        "row", "did", "th", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        *[(w / total).alias(f"p{i}") for i, w in enumerate(weights)],
    )


def _rate(history: list[np.ndarray], k: int, most: float) -> Column:
    """The rate after all steps so far: each goes down the gradient and is projected."""
    if not history:
        return F.lit(1.0)
    steps = F.lit([[float(x) for x in step] for step in history])

    def descend(rate: Column, step: Column) -> Column:
        slope = reduce(Column.__add__, [F.get(step, i) * F.col(f"p{i}") for i in range(k)])
        return F.least(F.greatest(rate - slope, F.lit(0.0)), F.lit(float(most)))

    return F.aggregate(steps, F.lit(1.0), descend)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: Mapping[str, float],
    anchor: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_id_column: str = "doc_id",
    domain: Column | None = None,
    max_rate: float = 1.0,
    steps: int = 40,
    tolerance: float = 1e-4,
    sample: int = SAMPLE,
) -> DataFrame:
    """Rates that bring expected domain tokens to the target ``weights``.

    Returns ``doc_id, tokens, posteriors, rate, copies, th``: one row per row of ``docs``,
    ``posteriors`` in the order of ``weights``. The classifier is fitted on ``labels``
    (domain by ``domain``, by default :func:`domain_of_labels`) and gives every document
    soft membership in all domains. ``anchor`` is the domain that keeps all its tokens;
    the targets of the others follow from the weights. ``copies`` rounds the rate down or
    up by a hash of the id, so its expectation is the rate.

    The rates minimise the squared distance of the domain totals from their targets, in the
    metric of the documents' own spread, over rates from 0 to ``max_rate``. Projected
    gradient descent starts at 1. A step needs the domain totals alone, a few numbers; the
    rate of a document follows from the steps, so no iteration writes or shuffles documents.

    A null or empty text has no tokens, the posteriors of the labels' shares and a rate like
    others. Documents without labels to learn from, and none at all, keep rate 1. Repeated
    rows all count. A null id comes back as null.
    """
    domains = list(weights)
    k = len(domains)
    did = F.coalesce(docs[id_column].cast("bigint"), F.lit(NO_ID))
    rows = docs.select(did.alias("did"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("did", F.xxhash64("text").alias("th"), "text")
    model = fit(rows, labels, domain if domain is not None else domain_of_labels(), label_id_column, domains, sample)
    totals = {f"t{i}": F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(k)}
    spread = {f"m{i}_{j}": F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(i, k)}
    members, sums = measured(posteriors(rows, model), "members", **totals, **spread)
    history: list[np.ndarray] = []
    now = np.array([sums.get(f"t{i}") or 0.0 for i in range(k)])
    at = domains.index(anchor)
    if now[at] > 0:
        share = np.array([weights[d] for d in domains])
        target = share / share[at] * now[at]
        metric = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        metric += np.eye(k) * metric.trace() * 1e-6
        for _ in range(steps):
            step = np.linalg.solve(metric, now - target)
            history.append(step)
            rate = _rate(history, k, max_rate)
            row = members.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}") * rate).alias(f"t{i}") for i in range(k)]).first()
            before, now = now, np.array([row[f"t{i}"] for i in range(k)])
            if np.abs(now - before).max() <= tolerance * now.sum():
                break
    even = F.pmod(F.xxhash64(F.lit(17), "did"), F.lit(2**20)) / float(2**20)
    rated = members.withColumn("rate", _rate(history, k, max_rate))
    return rated.select(
        own_id("did").alias("doc_id"), "tokens", F.array(*[F.col(f"p{i}") for i in range(k)]).alias("posteriors"),
        "rate", F.floor(F.col("rate") + even).cast("int").alias("copies"), "th",
    )
