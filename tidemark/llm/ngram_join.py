"""Similarity join on word n-grams: MinHash bands of one fixed length find candidates, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.frames import join_counted, matched, own_id, texts
from tidemark.llm.shipping import ship
from tidemark.llm.words import LOWER, mixed, text_words, window_hashes
from tidemark.storage import measured, written

# Members of a candidate group that a task compares with one another at a time.
BLOCK = 128
# Bytes of n-grams that small groups in one pack have on average.
PACK_BYTES = 8_000_000


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with the wanted probability.

    A tree holds ``depth`` MinHash values of each set; two sets of similarity s share
    the first k values of some tree with probability ``1 - (1 - s ** k) ** trees``.
    The length is fixed before any data are read, so trees are bands of that many
    values and not a forest of sorted prefixes. 1 if no length is enough.
    """
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """Distinct word n-grams of each text as sorted hashes; fewer words than ``size`` are one n-gram."""
    for words in text_words(column, LOWER):
        hashes = window_hashes(words.hashes, size)
        sets = []
        for start, end in zip(words.bounds[:-1], words.bounds[1:]):
            if end - start >= size:
                sets.append(np.unique(hashes[start : end - size + 1]))
            elif end > start:
                sets.append(mixed(_short(words.hashes[start:end])))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield sets


def _short(hashes: np.ndarray) -> np.ndarray:
    return window_hashes(hashes, len(hashes))[:1] + np.uint64(len(hashes))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = np.random.RandomState(11)
    draw = lambda: state.randint(0, 2**63 - 1, n).astype(np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signatures(sets: list[np.ndarray], trees: int, depth: int, length: int) -> np.ndarray:
    """For each set, a hash of the first ``length`` MinHash values of each tree."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), trees), np.uint64)
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    factors, shifts = _factors(trees * depth)
    with np.errstate(over="ignore"):
        for tree in range(trees):
            prefix = np.full(len(full), tree + 1, np.uint64)
            for level in range(length):
                at = tree * depth + level
                least = np.minimum.reduceat((flat ^ shifts[at]) * factors[at], starts)
                prefix = mixed(prefix * np.uint64(31) + least)
            out[full, tree] = prefix
    return out


def ngram_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    depth: int = 6,
    recall: float = 0.9999,
) -> DataFrame:
    """Which documents share ``threshold`` or more of their word n-grams (Jaccard).

    Returns ``doc_id, set_id, class_id, n_links, first, th`` (hash of the text): one
    row per row of ``docs``. ``set_id`` is the smallest id with the same set of n-grams,
    ``class_id`` the smallest id that links lead to, ``n_links`` the number of
    other rows linked directly (equal sets included), and ``first`` is true for
    exactly one row of each class. Words are split at white space and compared
    with A-Z in lower case; a text of fewer than ``size`` words has one n-gram,
    all its words. Texts without words, null ones included, link to nothing. A
    null id comes after all others. Repeated rows are copies like others.

    Equal sets become one node first, so copies cost nothing more. Nodes that
    share the first :func:`prefix_length` values of a tree are candidates (a
    ``threshold`` and ``recall`` that no length meets raise); each
    connected group of candidates is compared exactly, in blocks of about
    ``BLOCK`` nodes, so that no task holds a group and pairs never become rows.
    """
    length = prefix_length(threshold, trees, depth, recall)
    if 1 - (1 - threshold**length) ** trees < recall:
        raise ValueError(f"{trees} trees cannot find pairs at {threshold} with probability {recall}; take more trees")
    ship(docs.sparkSession)
    base = texts(docs, id_column, text_column)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), size):
                signed = signatures(sets, trees, depth, length)
                total = [_digest(s) for s in sets]
                part = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.record_batch(
                    [part.column("did"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(total, pa.binary()), pa.array([s.tobytes() for s in signed], pa.binary())],
                    names=["did", "th", "size", "digest", "prefixes"],
                )

    signed = base.mapInArrow(sign, "did bigint, th bigint, size bigint, digest binary, prefixes binary")
    rows, counts = measured(
        signed.withColumn("row", F.monotonically_increasing_id()), "signatures", n=F.count("*")
    )
    n_rows = counts["n"] or 0
    # One node per set: its first row.
    with_words = rows.where("size > 0")
    sets = written(
        with_words.groupBy("digest").agg(
            F.min(F.struct("did", "row")).alias("least"), F.count("*").alias("copies"),
            F.min_by(F.struct("th", "prefixes", "size"), F.struct("did", "row")).alias("of"),
        ).select(
            "digest", "copies", F.col("least.row").alias("node"), F.col("least.did").alias("node_did"),
            F.col("of.th").alias("node_th"), F.col("of.prefixes").alias("prefixes"), F.col("of.size").alias("size"),
        ),
        "sets",
    )

    links = written(_links(base, sets, size, threshold, trees), "links")
    roots = connected_components(links.where("b is not null").select("a", "b"))
    n_links = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("linked"))
    nodes = written(
        sets.select("digest", "copies", "node", "node_did").join(n_links, "node", "left").join(roots, "node", "left")
        .select("*", F.coalesce("root", "node").alias("class")),
        "nodes",
    )
    in_groups = nodes.where("root is not null")
    firsts = in_groups.groupBy("class").agg(
        F.min(F.struct("node_did", "node")).alias("least"), F.count("*").alias("members")
    )
    firsts = written(firsts, "classes")
    classed = written(
        join_counted(in_groups, firsts, ["class"], "members", n_rows)
        .select("digest", "copies", "node", "node_did", "linked", F.col("least.node_did").alias("class_did"),
                F.col("least.node").alias("first_node"))
        .unionByName(nodes.where("root is null").select(
            "digest", "copies", "node", "node_did", "linked", F.col("node_did").alias("class_did"),
            F.col("node").alias("first_node"))),
        "classed",
    )
    narrow = rows.select("did", "th", "row", "size", "digest")
    result = join_counted(narrow.where("size > 0"), classed, ["digest"], "copies", n_rows)
    return result.select(
        own_id("did").alias("doc_id"), own_id("node_did").alias("set_id"),
        own_id("class_did").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        (F.col("row") == F.col("first_node")).alias("first"), "th",
    ).unionByName(
        narrow.where("size = 0").select(
            own_id("did").alias("doc_id"), own_id("did").alias("set_id"), own_id("did").alias("class_id"),
            F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("first"), "th",
        )
    )


def _digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([mixed(hashes).sum(dtype=np.uint64), mixed(hashes ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)]).tobytes()


def _links(base: DataFrame, sets: DataFrame, size: int, threshold: float, trees: int) -> DataFrame:
    """``a, b, links``: links per node (b null) and links enough to connect what is linked."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = np.frombuffer(b"".join(batch.column("prefixes").to_pylist()), np.int64)
            nodes = np.repeat(batch.column("node").to_numpy(), trees)
            yield pa.record_batch([pa.array(nodes), pa.array(prefixes)], names=["node", "prefix"])

    entries = sets.select("node", "prefixes").mapInArrow(unfold, "node bigint, prefix bigint")
    shared, counts = measured(
        entries.groupBy("prefix").agg(
            F.min("node").alias("b"), F.max("node").alias("last"), F.count("*").alias("n")
        ).where("b < last").drop("last"),
        "buckets", total=F.sum("n"),
    )
    candidates = join_counted(entries, shared, ["prefix"], "n", counts["total"] or 0)
    groups = connected_components(candidates.select(F.col("node").alias("a"), "b").distinct())
    groups = written(groups, "candidates")
    sizes, counts = measured(
        groups.groupBy("root").agg(F.count("*").alias("members")), "candidates", n=F.sum("members")
    )
    n = counts["n"] or 0
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = (
        join_counted(groups, sizes, ["root"], "members", n)
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    wanted = sets.select("node", "node_did", "node_th", "copies", "prefixes", "size").join(members, "node")
    place = ["node_did", "node_th"]
    keys, seen = measured(wanted.select(*place, "size"), "compared", grams=F.sum("size"))
    # Small groups share a pack, of bounded length; a large one has a pack for each pair of blocks.
    packs = max(1, n // 1000, 8 * (seen["grams"] or 0) // PACK_BYTES)
    compared = matched(
        base.select(F.col("did").alias("node_did"), F.col("th").alias("node_th"), "text"),
        keys.select(*place), place, n, "left_semi",
    )
    with_text = wanted.join(compared.dropDuplicates(place), place)  # rows may repeat one another

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for sets in shingle_sets(batch.column("text"), size) for s in sets]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("shingles", pa.binary()), pa.array(found, pa.binary()))

    member_schema = "node bigint, copies bigint, prefixes binary, root bigint, blocks int, block int, shingles binary"
    dealt = with_text.select("node", "copies", "prefixes", "root", "blocks", "block", "text").mapInArrow(shingle, member_schema)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).select(
        "node", "copies", "prefixes", "root", "shingles", "block",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("pack"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("low"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("high"),
    )

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        return _compare(group, low, high, threshold)

    return dealt.groupBy("pack", "low", "high").applyInArrow(compare, "a bigint, b bigint, links bigint")


def _compare(group: pa.Table, low: int, high: int, threshold: float) -> pa.Table:
    """Exact links among the candidates of a pack, counted with the copies at their other end."""
    node = group.column("node").to_numpy()
    copies = group.column("copies").to_numpy()
    root = group.column("root").to_numpy()
    block = group.column("block").to_numpy()
    prefixes = [np.frombuffer(p, np.uint64) for p in group.column("prefixes").to_pylist()]
    shingles = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.diff(root[order])) + 1
    links: dict[int, int] = {}
    joins: list[tuple[int, int]] = []
    for part in np.split(order, cuts):
        if low < high:
            left, right = part[block[part] == low], part[block[part] == high]
        else:
            left = right = part
        if not len(left) or not len(right):
            continue
        found_left, found_right = _linked(left, right, low >= high, prefixes, shingles, threshold)
        parent: dict[int, int] = {}

        def top(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(found_left.tolist(), found_right.tolist()):
            links[i] = links.get(i, 0) + int(copies[j])
            links[j] = links.get(j, 0) + int(copies[i])
            if top(i) != top(j):
                parent[top(i)] = top(j)
                joins.append((i, j))
    rows = [(int(node[i]), None, n) for i, n in links.items()]
    rows += [(int(node[i]), int(node[j]), 0) for i, j in joins]
    a, b, n = zip(*rows) if rows else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})


def _linked(left, right, same, prefixes, shingles, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that share a band and reach the threshold."""
    p, q = np.stack([prefixes[i] for i in left]), np.stack([prefixes[i] for i in right])
    close = np.zeros((len(left), len(right)), bool)
    for tree in range(p.shape[1]):
        close |= p[:, tree][:, None] == q[:, tree][None, :]
    if same:
        close = np.triu(close, 1)
    n = np.array([len(shingles[i]) for i in left])[:, None]
    m = np.array([len(shingles[i]) for i in right])[None, :]
    close &= np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    rows, columns = np.nonzero(close)
    if not len(rows):
        return rows, columns
    if len(rows) > 0.05 * close.size and len(rows) > 200:
        common = _common(left, right, shingles)[rows, columns]
    else:
        common = np.array([
            len(np.intersect1d(shingles[left[i]], shingles[right[j]], assume_unique=True))
            for i, j in zip(rows, columns)
        ])
    total = n[rows, 0] + m[0, columns] - common
    good = common >= threshold * total - 1e-9
    return left[rows[good]], right[columns[good]]


def _common(left, right, shingles) -> np.ndarray:
    """Sizes of all intersections of two blocks, from 0/1 matrices over a stretch of hashes at a time."""
    members = [*left, *right]
    values = np.concatenate([shingles[i] for i in members])
    owner = np.repeat(np.arange(len(members)), [len(shingles[i]) for i in members])
    distinct, column = np.unique(values, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(distinct), 4096):
        here = (column >= start) & (column < start + 4096)
        matrix = np.zeros((len(members), 4096), np.float32)
        matrix[owner[here], column[here] - start] = 1
        common += matrix[: len(left)] @ matrix[len(left) :].T
    return np.rint(common).astype(np.int64)
