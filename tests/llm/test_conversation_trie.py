"""The prefix trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from trawl.llm import conversation_trie as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_find_close(seed):
    rng = random.Random(seed)
    for n in (1, 2, 40, 3000):
        bits, open_ = [], 0
        while len(bits) < n or open_:
            grow = len(bits) < n and (open_ == 0 or rng.random() < (0.9 if seed % 2 else 0.52))
            bits.append(grow)
            open_ += 1 if grow else -1
        tree, stack, close = T.Parentheses(np.array(bits)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        rank = tree.leaf_rank()
        assert all(rank[close[i]] - rank[i] == sum(bits[j] and not bits[j + 1] for j in range(i, close[i])) for i in opens.tolist()[:50])


def by_hand(conversations: dict) -> list[tuple]:
    """Nodes of {conv_id: list of (role, text)}."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []

    def walk(node):
        leaves, saves = (0 if node in children else 1), (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for child in children.get(node, []):
            more = walk(child)
            leaves, saves = leaves + more[0], saves + more[1]
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children.get(node, [])), leaves, saves, digest))
        return leaves, saves

    if members:
        walk(())
    return sorted(out, key=str)


def grown_by_hand(rows) -> dict:
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def nodes(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(0, 240, 1 if seed % 2 else 3):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = rng.choice(["a", "é", None, "", "yes", f"own {c}"]) if rng.random() < 0.6 else "same"
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["u", "u", None]), text))
    rows += [(1000 + i, t, "u", "copy") for i in range(60) for t in range(4)]  # copies, and a common beginning
    rows += [(2000, t, "u", f"t{t % 3}") for t in range(150)] + [(5, 0, "u", "again")] * 2 + [(None, 0, "u", "nobody")]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shard", [1, 40, 1 << 19])
def test_trie_equals_brute_force(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TURNS", shard)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(seed)
        turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(3)
        assert nodes(T.prefix_trie(T.regrown(T.turn_paths(turns)))) == by_hand(grown_by_hand(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert T.prefix_trie(T.regrown(T.turn_paths(spark.createDataFrame([], schema)))).count() == 0
    # 7 takes all its turns from 5, which has none: it ends at the root.
    rows = [(7, 0, None, None), (8, 0, "u", "x" * 200_000)]
    got = nodes(T.prefix_trie(T.regrown(T.turn_paths(spark.createDataFrame(rows, schema)))))
    assert got == by_hand(grown_by_hand(rows)) and any(n[1] == 0 for n in got)
    keys = {r["turns"][0]["key"] for r in T.turn_paths(spark.createDataFrame([(1, 0, "u", "ser"), (2, 0, "us", "er"), (3, 0, "", "user")], schema)).collect()}
    assert len(keys) == 3


def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    expected = con.execute(T.ORACLE_SQL)
    names = [d[0] for d in expected.description]
    got = T.op12_conversation_trie(spark, SF)
    assert got.columns == names
    assert nodes(got) == sorted(expected.fetchall(), key=str)
