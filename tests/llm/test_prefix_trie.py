"""The trie of conversations against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lateweave.llm import prefix_trie
from lateweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, node string, n long, shard int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """Rows of (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) per node."""
    members = defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    sum(not children[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def digested(nodes, ends, chunk=prefix_trie.CHUNK):
    got = nodes.join(prefix_trie.end_digests(ends, chunk), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    return sorted(map(tuple, got.collect()), key=str)


def test_whole_table(spark):
    c = pd.read_parquet(f"{SF}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, SF).collect()), key=str)
    assert got == brute(rebuilt(zip(c.conv_id.tolist(), c.turn.tolist(), c.role, c.text)))


@pytest.mark.parametrize("shard,chunk", [(3, 5), (10, 1 << 16), (4096, 1)])
def test_shards_and_hot_beginnings(spark, shard, chunk):
    """A first turn that half of all share, equal conversations, few words: any cut gives the same trie."""
    rng = random.Random(shard)
    conversations = {}
    for c in range(120):
        turns = [("user", rng.choice(["hä?", "b", ""])) for _ in range(rng.randint(0, 5))]
        conversations[c * 7] = [("user", "hot")] * (c % 2) + turns
    rows = [(c, i, r, t, "x", 1, 2) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA))
    ids = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    nodes, ends = prefix_trie.prefix_trie(turns, ids, shard)
    assert digested(nodes, ends, chunk) == brute(conversations)


def test_odd_rows(spark):
    rows = [(5, None, None, "first"), (5, 0, "user", None), (5, 0, "user", None), (5, 0, "a", "z"), (6, 3, "user", "gap"),
            (6, 1, "", ""), (7, 0, "us", "er"), (8, 0, "user", ""), (None, 0, "user", "lost"), (9, 0, "user", "t" * 300_000),
            (11, 0, "user", "w"), (12, 0, "user", "w"), (23, 0, None, None), (24, 0, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    made = prefix_trie.shared_beginnings(prefix_trie.turn_rows(frame))
    assert digested(*prefix_trie.prefix_trie(*made)) == brute(rebuilt(rows))
    plain = prefix_trie.turn_rows(frame)
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    assert digested(*prefix_trie.prefix_trie(plain, plain.select("conv_id"))) == brute(own)
    none = prefix_trie.prefix_trie(*prefix_trie.shared_beginnings(prefix_trie.turn_rows(frame.limit(0))))
    assert [x.collect() for x in none] == [[], []] and digested(*none) == []
