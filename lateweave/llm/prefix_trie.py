"""Prefix tries of conversations from vertical bitmaps.

A shard holds some of the conversations. Its index keeps for every position and turn the bitset of
the shard's conversations that have this turn there. A node is a bitset: the root has all, and a
child is the intersection of its parent's bitset with one posting of the next position. Going down
depth first gives every node of the shard with its count, its smallest member and the members that
end there. Nodes of many shards are one node if their turns are the same, which their key says.

What only all shards together know (whether a node has children, how many members it has) is
brought back to the shards, where each node belongs to the shard of its smallest member, for the
sums over subtrees; those sums are added up over the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lateweave.llm.common import discard, materialize

SHARD = 4_096        # conversations of a shard, about
CHUNK = 1 << 16      # characters of an end list handed on at a time
ROOT = b""
LOCAL = "shard int, node binary, parent binary, depth bigint, n bigint, low bigint, bytes bigint, ends array<bigint>"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, key, bytes: the turns in order, from 0; the key stands for role and text.

    NULL turns come first, NULL roles and texts are empty, equal turn numbers go by role and text.
    Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # The length in front keeps role and text apart.
    body = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select(
        "conv_id", "pos", F.unhex(F.sha2(body.cast("binary"), 256)).alias("key"),
        F.octet_length("text").cast("bigint").alias("bytes"))


def shared_beginnings(turns: DataFrame, family: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: rows as of ``turn_rows``, and all ids.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all, if it has
    fewer; none, if there is none) in place of its own first h; h = crc32(c as text) % ``spread``.
    """
    per = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    conv = per.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base"),
                      (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int").alias("h"))
    first = per.select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"))
    conv = materialize(conv.join(first, F.col("base") == F.col("b_id"), "left").select(
        F.col("conv_id").alias("c"), "base", "h", F.least("h", F.coalesce("b_n", F.lit(0))).alias("taken")), "conv")
    own = (turns.join(conv.select("c", "h", "taken"), F.col("conv_id") == F.col("c")).filter("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes"))
    begin = (turns.filter(F.col("pos") < spread - 1)
             .join(conv.filter("taken > 0"), F.col("conv_id") == F.col("base")).filter("pos < h")
             .select(F.col("c").alias("conv_id"), "pos", "key", "bytes"))
    return own.unionByName(begin), conv.select(F.col("c").alias("conv_id"))


def child_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def shard_nodes(conv_ids: list[int], turns: list[list[bytes]], size: dict[bytes, int]):
    """Nodes of one shard, depth first: key, parent, depth, number, smallest member, bytes, ends.

    ``conv_ids`` rise, so that the lowest bit of a bitset is its smallest member.
    """
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    lengths: dict[int, int] = {}
    for i, keys in enumerate(turns):
        bit = 1 << i
        lengths[len(keys)] = lengths.get(len(keys), 0) | bit
        for posting, key in zip(postings, keys):
            posting[key] = posting.get(key, 0) | bit
    stack = [(ROOT, None, 0, (1 << len(conv_ids)) - 1, 0)] if conv_ids else []
    while stack:
        node, parent, depth, members, length = stack.pop()
        ended = members & lengths.get(depth, 0)
        rest, ends = members ^ ended, []
        while ended:
            low = ended & -ended
            ends.append(conv_ids[low.bit_length() - 1])
            ended ^= low
        while rest:
            turn = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][turn]
            rest ^= child
            stack.append((child_key(node, turn), node, depth + 1, child, size[turn]))
        yield (node, parent, depth, members.bit_count(), conv_ids[(members & -members).bit_length() - 1], length, ends)


def _grow(group: pa.Table) -> pa.Table:
    """The nodes of one shard from rows of conv_id, pos, key and bytes (no pos: no turn)."""
    group = group.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    conv_ids, turns, size = [], [], {}
    for conv, pos, key, length in zip(*(group.column(c).to_pylist() for c in ("conv_id", "pos", "key", "bytes"))):
        if not conv_ids or conv_ids[-1] != conv:
            conv_ids.append(conv)
            turns.append([])
        if pos is not None:
            turns[-1].append(key)
            size[key] = length
    node, parent, depth, n, low, length, ends = zip(*shard_nodes(conv_ids, turns, size))
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()] * len(node), pa.int32()),
                     "node": pa.array(node, pa.binary()), "parent": pa.array(parent, pa.binary()),
                     "depth": pa.array(depth, pa.int64()), "n": pa.array(n, pa.int64()), "low": pa.array(low, pa.int64()),
                     "bytes": pa.array(length, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})


def _sum_up(group: pa.Table) -> pa.Table:
    """Sums of leaves and saved bytes over the subtrees of one shard's nodes."""
    node, parent = group.column("node").to_pylist(), group.column("parent").to_pylist()
    depth = group.column("depth").to_numpy()
    place = {key: i for i, key in enumerate(node)}
    up = np.array([place.get(p, -1) if p is not None else -1 for p in parent])
    sums = [group.column(c).to_numpy().copy() for c in ("leaves", "saved")]
    by = np.argsort(-depth, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(depth[by])) + 1):  # deepest first
        rows = rows[up[rows] >= 0]
        for total in sums:
            np.add.at(total, up[rows], total[rows])
    return pa.table({"node": pa.array(node, pa.binary()), "leaves": pa.array(sums[0]), "saved": pa.array(sums[1])})


def prefix_trie(turns: DataFrame, ids: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The trie of all prefixes of the conversations ``ids (conv_id)`` with ``turns (conv_id, pos, key, bytes)``.

    First result, a row per node: node and parent (keys), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens: over the subtree the sum of
    (members - 1) times the bytes of a node's last text. Second result: node, conv_id of the conversations that end there.

    A conversation without turns is a member of the root and ends there. Conversations are dealt
    into shards of about ``shard`` by their first turn; a first turn of more has several shards. A
    conversation as such stays together: its turns (not their texts) are in one shard. No
    conversations, no nodes.
    """
    ids = ids.distinct()
    firsts = ids.join(turns.filter("pos = 0").select(F.col("conv_id").alias("t_id"), "key"),
                      F.col("conv_id") == F.col("t_id"), "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"))
    firsts = materialize(firsts, "firsts")
    shards = max(1, -(-firsts.count() // shard))
    hot = materialize(firsts.groupBy(F.col("key").alias("h_key")).agg(F.count(F.lit(1)).alias("m"))
                      .filter(F.col("m") > shard).withColumn("salts", F.ceil(F.col("m") / shard).cast("int")), "hot-firsts")
    dealt = firsts.join(hot, F.col("key") == F.col("h_key"), "left").select(
        F.col("conv_id").alias("c"),
        F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("conv_id"), F.coalesce("salts", F.lit(1)))), F.lit(shards))
        .cast("int").alias("shard"))
    rows = dealt.join(turns, F.col("c") == F.col("conv_id"), "left").select(
        "shard", F.col("c").alias("conv_id"), "pos", "key", "bytes")
    local = materialize(rows.groupBy("shard").applyInArrow(_grow, LOCAL), "shard-nodes")

    nodes = materialize(local.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"),
        F.min("low").alias("low"), F.first("bytes").alias("bytes")), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("c_node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("p_node"), F.col("low").alias("p_low"))
    tree = materialize(
        nodes.join(materialize(children, "children"), F.col("node") == F.col("c_node"), "left")
        .join(above, F.col("parent") == F.col("p_node"), "left")
        .select("node", "parent", "depth", "n", "low", "bytes", "p_low",
                F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children")), "tree")
    whole = tree.select(F.col("node").alias("g_node"), F.col("low").alias("g_low"), "n_children",
                        ((F.col("n") - 1) * F.col("bytes")).alias("worth"))
    # A node counts in the shard that holds its smallest member, and nowhere else.
    mine = F.col("low") == F.col("g_low")
    owned = local.select("shard", "node", "parent", "depth", "low").join(whole, F.col("node") == F.col("g_node")).select(
        "shard", "node", "parent", "depth", (mine & (F.col("n_children") == 0)).cast("bigint").alias("leaves"),
        F.when(mine, F.col("worth")).otherwise(F.lit(0)).cast("bigint").alias("saved"))
    sums = (owned.groupBy("shard").applyInArrow(_sum_up, "node binary, leaves bigint, saved bigint")
            .groupBy(F.col("node").alias("s_node")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    out = materialize(tree.join(sums, F.col("node") == F.col("s_node")).select(
        "node", "parent", F.col("low").alias("conv_id"), "depth", F.col("p_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"), "trie")
    ends = materialize(local.select("node", F.explode("ends").alias("conv_id")), "ends")
    for table in (firsts, hot, local, nodes, tree):
        discard(table)
    return out, ends


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, ends_sha256: SHA-256 of a node's conv_ids in rising order, joined by commas.

    Ids are sorted and joined in ranges that cut through a node with many; the last step reads a
    node's pieces one after another and holds none of them.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, body = None, 0, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()),
                                               pa.array([",".join(body)])], names=["node", "first", "body"])

        size = 0
        for batch in batches:
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if body and (node != at or size >= chunk):
                    yield piece()
                    body, size = [], 0
                if not body:
                    at, first = node, conv
                body.append(str(conv))
                size += len(body[-1]) + 1
        if body:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])],
                                              names=["node", "ends_sha256"])

        for batch in batches:
            for node, body in zip(batch.column("node").to_pylist(), batch.column("body").to_pylist()):
                if node != at or sha is None:
                    if sha is not None:
                        yield row()
                    at, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(body.encode())
        if sha is not None:
            yield row()

    pieces = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .mapInArrow(join, "node binary, first bigint, body string"))
    return (pieces.repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(digest, "node binary, ends_sha256 string"))
