"""The prefix trie of conversations, from vertical bitmaps in shards.

A node of depth ``d`` is a distinct sequence of ``d`` first turns. Conversations are dealt in
order of their ids to shards of bounded size. In a shard, an index says for every
(position, turn) which conversations have that turn there, as a bitmap over the
shard's conversations. Starting from the root, the bitmap of a node is intersected with
the postings of the next position; what remains is a child, its popcount the number of
the shard's conversations that pass, and conversations that are over end there.

A node has the same path hash in every shard. Two aggregations over these hashes put
the shards together; a path has one row for each shard at most, however many
conversations share it:

1. counts, smallest members and whether there are children at all;
2. what is summed over subtrees. Every node is owned by the shard of its smallest
   member, where all its ancestors are nodes too, so each shard adds up the nodes it owns
   along its own paths, and the sums of the shards are added.

Lists of conversations that end at a node are made by each shard for its own ids, and
followed by those of the next shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import NO_ID, own_id
from tidemark.llm.shipping import ship
from tidemark.storage import measured, written

# A shard is closed after so many conversations or turns; a conversation is never divided.
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 100_000

# Numbers of shards leave room for so many in a partition.
_SHARDS = 1 << 32

_LOCAL = (
    "shard bigint, node int, parent int, path binary, depth int, first bigint, n bigint, "
    "length bigint, inner boolean, ends string"
)
_ROOT = b"\x00" * 16


def turns_of(
    conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str
) -> DataFrame:
    """``cid, pos, key, length``: position of each turn from 0, a digest of role and text, code points of the text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = conversations.select(
        F.coalesce(conversations[id_column].cast("bigint"), F.lit(NO_ID)).alias("cid"),
        conversations[turn_column].alias("turn"), role.alias("role"), text.alias("text"),
    )
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    turns = turns.select("cid", "turn", digest.alias("key"), F.char_length("text").cast("bigint").alias("length"))
    order = Window.partitionBy("cid").orderBy(F.col("turn").asc_nulls_first(), "key")
    return turns.select("cid", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "key", "length")


def grafted(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Turns of conversations whose first ``head`` turns are replaced by those of conversation ``base``.

    ``base`` and ``head`` are expressions over ``cid``, ``head`` being ``most`` at most; a conversation
    that is shorter, or absent, gives what it has. ``turns`` is read several times. Each conversation
    has a row without a turn too (null ``pos``), so that those left without any are kept.
    """
    plan = turns.where("pos = 0").select("cid", base.alias("base"), head.cast("bigint").alias("head"))
    lent = turns.where(F.col("pos") < most).withColumnRenamed("cid", "base")
    fronts = plan.join(lent, "base").where("pos < head").select("cid", "pos", "key", "length")
    sizes = lent.groupBy("base").agg(F.count("*").alias("size"))
    shifts = plan.join(sizes, "base", "left").select(
        "cid", "head", F.least("head", F.coalesce("size", F.lit(0).cast("bigint"))).alias("taken")
    )
    place = (F.col("pos") - F.col("head") + F.col("taken")).alias("pos")
    own = turns.join(shifts, "cid").where("pos >= head").select("cid", place, "key", "length")
    return fronts.unionByName(own).unionByName(_marks(turns))


def _marks(turns: DataFrame) -> DataFrame:
    return turns.where("pos = 0").selectExpr(
        "cid", "CAST(NULL AS bigint) AS pos", "CAST(NULL AS binary) AS key", "CAST(0 AS bigint) AS length"
    )


class _Shard:
    """Conversations of one shard: their ids in ascending order, and their turns one after another."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, keys: list[bytes], lengths: np.ndarray):
        self.ids, self.bounds, self.keys, self.lengths = ids, bounds, keys, lengths

    def nodes(self) -> dict[str, list]:
        """The trie of the shard, parents before children."""
        n, ids = len(self.ids), self.ids.tolist()
        bounds, keys, lengths = self.bounds.tolist(), self.keys, self.lengths.tolist()
        # (position, turn) -> bitmap of the conversations that have it there, and for every position those that go on.
        postings: dict[tuple[int, bytes], int] = {}
        going: list[int] = []
        for i in range(n):
            bit = 1 << i
            for d in range(bounds[i + 1] - bounds[i]):
                at = d, keys[bounds[i] + d]
                postings[at] = postings.get(at, 0) | bit
                if d == len(going):
                    going.append(0)
                going[d] |= bit
        out: dict[str, list] = {c: [] for c in ("parent", "path", "depth", "first", "n", "length", "inner", "ends")}
        stack: list[tuple[int, int, bytes, int, int]] = [((1 << n) - 1, -1, _ROOT, 0, 0)] if n else []
        while stack:
            members, parent, path, depth, length = stack.pop()
            node = len(out["path"])
            on = members & going[depth] if depth < len(going) else 0
            over = members & ~on
            out["parent"].append(parent)
            out["path"].append(path)
            out["depth"].append(depth)
            out["first"].append(ids[(members & -members).bit_length() - 1])
            out["n"].append(members.bit_count())
            out["length"].append(length)
            out["inner"].append(on > 0)
            out["ends"].append(",".join(map(_decimal, map(ids.__getitem__, _bits(over)))) if over else None)
            while on:
                i = (on & -on).bit_length() - 1
                key = keys[bounds[i] + depth]
                child = on & postings[depth, key]
                on &= ~child
                below = hashlib.blake2b(path + key, digest_size=16).digest()
                stack.append((child, node, below, depth + 1, lengths[bounds[i] + depth]))
        return out


def _decimal(cid: int) -> str:
    return "null" if cid == NO_ID else str(cid)


def _bits(bitmap: int) -> Iterator[int]:
    bits = np.unpackbits(np.frombuffer(bitmap.to_bytes((bitmap.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
    return iter(np.flatnonzero(bits).tolist())


def _shards(batches: Iterator[pa.RecordBatch], most_conversations: int, most_turns: int) -> Iterator[_Shard]:
    """Cut a partition, sorted by conversation and position (the row without a turn first), into shards."""
    ids: list[int] = []
    counts: list[int] = []
    keys: list[bytes] = []
    lengths: list[int] = []

    def closed() -> _Shard:
        return _Shard(np.array(ids, np.int64), np.append(0, np.cumsum(counts)).astype(np.int64), keys, np.array(lengths, np.int64))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("cid", "pos", "key", "length"))
        for cid, pos, key, length in zip(*columns):
            if not ids or ids[-1] != cid:
                if len(ids) >= most_conversations or len(keys) >= most_turns:
                    yield closed()
                    ids, counts, keys, lengths = [], [], [], []
                ids.append(cid)
                counts.append(0)
            if pos is not None:
                counts[-1] += 1
                keys.append(key)
                lengths.append(length)
    if ids:
        yield closed()


def _local_nodes(batches: Iterator[pa.RecordBatch], *limits: int) -> Iterator[pa.RecordBatch]:
    partition = TaskContext.get().partitionId()
    for seq, shard in enumerate(_shards(batches, *limits)):
        found = shard.nodes()
        n = len(found["path"])
        number = np.full(n, partition * _SHARDS + seq)
        kinds = {"parent": pa.int32(), "path": pa.binary(), "depth": pa.int32(), "first": pa.int64(), "n": pa.int64(),
                 "length": pa.int64(), "inner": pa.bool_(), "ends": pa.string()}
        yield pa.record_batch(
            [pa.array(number), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(found[c], k) for c, k in kinds.items()]],
            names=["shard", "node", *kinds],
        )


def _summed(table: pa.Table) -> pa.Table:
    """For every node of one shard, what the nodes owned by the shard add to it."""
    order = np.argsort(table["node"].to_numpy())
    column = {c: table[c].to_numpy()[order] for c in ("parent", "depth", "first", "rep", "members", "length", "leaf")}
    parent, owned = column["parent"], column["first"] == column["rep"]
    saved = np.where(owned & (column["depth"] > 0), (column["members"] - 1) * column["length"], 0)
    leaves = np.where(owned & column["leaf"], 1, 0)
    children = np.bincount(parent[owned & (parent >= 0)], minlength=len(parent))
    for node in range(len(parent) - 1, 0, -1):  # parents come before their children
        saved[parent[node]] += saved[node]
        leaves[parent[node]] += leaves[node]
    above = np.where(owned, column["rep"][np.maximum(parent, 0)], 0)
    return pa.table(
        {
            "path": table["path"].take(pa.array(order)),
            "children": pa.array(children, pa.int64()),
            "leaves": pa.array(leaves, pa.int64()),
            "saved": pa.array(saved, pa.int64()),
            "parent": pa.array(above, pa.int64(), mask=~(owned & (column["depth"] > 0))),
        }
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the lists of each path, whose rows come one after another in order."""
    path, state = None, hashlib.sha256()
    for batch in batches:
        paths, digests = [], []
        for now, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
            if now != path:
                if path is not None:
                    paths.append(path)
                    digests.append(state.hexdigest())
                path, state = now, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(digests, pa.string())], names=["path", "ends_sha256"])
    if path is not None:
        yield pa.record_batch([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])


def prefix_trie(
    turns: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """The nodes of the trie of ``turns(cid, pos, key, length)``, with a null ``pos`` row for each conversation.

    Result, a row for each node: ``path`` (128-bit hash), ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id`` (the parent's ``conv_id``, null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` over its subtree (the latter: members but one, times the
    length of the last turn, summed), ``ends_sha256`` over the ids of those that end there,
    in numerical order with commas between.

    No conversations: no nodes, not even a root. Conversations without turns belong to the root.
    The turns without an id count as those of one conversation, the last, shown as null (``null``
    in lists). Turns are placed by turn number, null first, then by digest, repeats included.
    A task holds a shard, so at most ``shard_turns`` turns besides those of one conversation.
    """
    spark = turns.sparkSession
    ship(spark)
    rows, size = measured(turns, "trie-turns", n=F.count("*"))
    partitions = max(1, min(100_000, -(-(size["n"] or 0) // shard_turns)))
    dealt = rows.repartitionByRange(partitions, "cid").sortWithinPartitions("cid", F.col("pos").asc_nulls_first())

    def local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _local_nodes(batches, shard_conversations, shard_turns)

    local = written(dealt.mapInArrow(local_nodes, _LOCAL), "trie-nodes")

    nodes = local.groupBy("path").agg(
        F.min("first").alias("rep"), F.sum("n").alias("members"), F.max("inner").alias("has"),
        F.first("depth").alias("level"),
    )
    nodes = written(nodes, "trie-paths")
    known = local.select("shard", "node", "parent", "path", "depth", "first", "length").join(
        nodes.select("path", "rep", "members", (~F.col("has")).alias("leaf")), "path"
    )
    sums = known.groupBy("shard").applyInArrow(
        _summed, "path binary, children bigint, leaves bigint, saved bigint, parent bigint"
    )
    sums = sums.groupBy("path").agg(
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.max("parent").alias("parent"),
    )
    ended = local.where("ends is not null").select("path", "shard", "ends")
    digests = ended.repartition("path").sortWithinPartitions("path", "shard").mapInArrow(
        _digests, "path binary, ends_sha256 string"
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(sums, "path").join(digests, "path", "left").select(
        "path", own_id("rep").alias("conv_id"), F.col("level").cast("bigint").alias("depth"),
        own_id("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    graft: tuple[Column, Column, int] | None = None,
    **limits: int,
) -> DataFrame:
    """:func:`prefix_trie` of a table of turns; null roles and texts count as empty.

    Two turns are the same if role and text are. ``graft`` has the arguments of :func:`grafted`
    after the turns, ``limits`` are those of :func:`prefix_trie`. Other columns of the table are not looked at.
    """
    ship(conversations.sparkSession)
    turns = written(turns_of(conversations, id_column, turn_column, role_column, text_column), "turns")
    return prefix_trie(grafted(turns, *graft) if graft else turns.unionByName(_marks(turns)), **limits)
