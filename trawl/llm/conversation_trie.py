"""Prefix trie of conversations: which beginnings are shared, and how many bytes sharing them saves.

Conversations become paths (a digest a turn) and are range-partitioned in lexicographic order, copies by
conv_id, so a partition holds neighbours in the trie and no group of copies or common beginning has to
fit one task. A shard, a bounded run of such paths, is one sequence of balanced parentheses in preorder:

    findclose, over a tree of least excesses of blocks, delimits each node's subtree;
    rank of "()" counts the leaves inside;
    cumulative sums over opening parentheses give what the subtree saves.

Nodes inside a shard are finished there. Those above its first and its last path, its spines, may go on
in other shards: they are merged by the digest of their path, which is all that is shuffled again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import saved, table

#: Bytes of a turn's digest in a path.
DIGEST = 16
#: Turns of all paths after which a shard is closed, and parentheses in a block.
SHARD_TURNS, BLOCK = 1 << 19, 64
NO_ENDS = hashlib.sha256().hexdigest()


class Parentheses:
    """A balanced sequence (true: open) with the least excess of each block, and of ever more blocks above."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.n = bits, len(bits)
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        padded = np.full(-(-self.n // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[: self.n] = self.excess
        self.padded = padded
        self.least = [padded.reshape(-1, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            if len(below) % 2:
                below = self.least[-1] = np.append(below, np.iinfo(np.int64).max)
            self.least.append(below.reshape(-1, 2).min(1))

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """For each opening parenthesis the place of the one that closes it: the next where the excess is one less."""
        want, out = self.excess[opens] - 1, np.full(len(opens), -1, np.int64)
        block = opens // BLOCK
        left = self._in_block(opens + 1, (block + 1) * BLOCK, want, out, np.arange(len(opens)))
        # Up until a block to the right reaches the excess, then down to its first half that does.
        at, level, ready = block[left], 0, []
        while len(left):
            least = self.least[level]
            hit = (at % 2 == 0) & (least[np.minimum(at + 1, len(least) - 1)] <= want[left]) & (at + 1 < len(least))
            if hit.any():
                ready.append(self._first_block(level, at[hit] + 1, want[left[hit]]))
                ready.append(left[hit])
            left, at, level = left[~hit], at[~hit] // 2, level + 1
        for found, which in zip(ready[::2], ready[1::2], strict=True):
            self._in_block(found * BLOCK, (found + 1) * BLOCK, want, out, which)
        return out

    def _first_block(self, level: int, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        for k in range(level - 1, -1, -1):
            at = at * 2
            at = at + (self.least[k][at] > want)
        return at

    def _in_block(self, at: np.ndarray, end: np.ndarray, want: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Fills out for those of which whose close lies in [at, end); returns the others."""
        left, at = which, at.copy()
        for _ in range(BLOCK):
            inside = at < end
            if not len(left) or not inside.any():
                break
            hit = inside & (self.padded[np.minimum(at, len(self.padded) - 1)] == want[left])
            out[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return left

    def leaf_rank(self) -> np.ndarray:
        """How many "()" begin before each place."""
        return np.append(0, np.cumsum(self.bits[:-1] & ~self.bits[1:]))


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first:last] for each range, none empty."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        below = levels[-1]
        levels.append(np.minimum(below[:-width], below[width:]))
        width *= 2
    level = np.frexp((last - first).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        pick = level == k
        out[pick] = np.minimum(levels[k][first[pick]], levels[k][last[pick] - (1 << k)])
    return out


_PARTS = (
    "kind int, part int, seq int, side int, conv_id long, depth long, parent_conv_id long, parent_side int, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node binary, parent binary, size long, ids string"
)
#: Kinds of a shard's rows: finished nodes, nodes of the spines, conversations that end on a spine.
INNER, SPINE, ENDS = 0, 1, 2


def _prefix_digests(path: bytes) -> list[bytes]:
    """Of the empty path and of each longer prefix."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for at in range(0, len(path), DIGEST):
        h.update(path[at : at + DIGEST])
        out.append(h.copy().digest())
    return out


def shard_rows(conv: np.ndarray, paths: list[bytes], sizes: np.ndarray) -> dict[str, list | np.ndarray]:
    """Columns of _PARTS (but part and seq) for one run of sorted paths; sizes: bytes of each turn of each path, one after another."""
    depth = np.array([len(p) // DIGEST for p in paths], np.int64)
    shared, parent_of_first = np.zeros(len(paths), np.int64), []
    stack, nodes, before = [0], 1, b""
    for r, path in enumerate(paths):
        k = len(before) // DIGEST if path.startswith(before) else 0
        if not k and before:
            top = min(len(before), len(path)) // DIGEST
            while k < top and before[k * DIGEST : (k + 1) * DIGEST] == path[k * DIGEST : (k + 1) * DIGEST]:
                k += 1
        shared[r] = k
        parent_of_first.append(stack[k])
        new = len(path) // DIGEST - k
        if new:
            stack[k + 1 :] = range(nodes, nodes + new)
            nodes += new
        else:
            del stack[k + 1 :]
        before = path
    opens, closes = depth - shared, np.append(0, depth[:-1]) - shared
    # The root's parenthesis, then for each path those it closes and those it opens, then all that are open.
    steps = np.column_stack([closes, opens]).ravel()
    bits = np.repeat(np.append(np.tile([False, True], len(paths)), False), np.append(steps, depth[-1] + 1))
    bits = np.append(True, bits)
    tree = Parentheses(bits)
    place = np.flatnonzero(bits)
    close = tree.find_close(place)
    row = np.append(0, np.repeat(np.arange(len(paths)), opens))
    begin = np.append(0, np.repeat(np.cumsum(opens) - opens, opens))
    nth = np.arange(nodes) - 1 - begin
    level = np.where(np.arange(nodes) > 0, shared[row] + 1 + nth, 0)
    parent = np.where(nth > 0, np.arange(nodes) - 1, np.array(parent_of_first)[row])
    last = np.searchsorted(1 + np.cumsum(closes + opens), close, "right")
    n_convs = last - row
    at = np.cumsum(depth) - depth
    size = np.where(level > 0, np.append(sizes, 0)[at[row] + level - 1], 0) if len(sizes) else np.zeros(nodes, np.int64)
    smallest = _range_min(conv, row, last)
    on_first, on_last = np.arange(nodes) <= depth[0], close >= len(bits) - 1 - depth[-1]
    spine = on_first | on_last
    inner = ~spine
    until = np.arange(nodes) + (close - place + 1) // 2  # preorder numbers of a subtree: from the node to here
    total = lambda x: np.append(0, np.cumsum(x))
    savings = total(np.where(inner, (n_convs - 1) * size, 0))
    saved_inner = savings[until] - savings[:nodes]
    rank = tree.leaf_rank()
    n_leaves = rank[close] - rank[place]
    childless = total(spine & (close == place + 1))
    leaves_inner = n_leaves - (childless[until] - childless[:nodes])
    children = np.bincount(parent[1:][inner[1:]], minlength=nodes)
    # Conversations that end at a node lead its rows; those with the same path have nothing opened or closed between them.
    run = np.append(np.flatnonzero((opens + closes > 0) | (np.arange(len(paths)) == 0)), len(paths))
    run_end = np.repeat(run[1:], np.diff(run))
    ends = np.where(level == depth[row], run_end[row], row)

    def ids(v: int) -> str:
        return ",".join(map(str, conv[row[v] : ends[v]].tolist()))

    out: dict[str, list] = {c.split()[0]: [] for c in _PARTS.split(", ")}
    out.pop("part"), out.pop("seq")

    def add(count: int, **columns) -> None:
        for name, column in out.items():
            column.extend(columns.get(name, [None] * count))

    v = np.flatnonzero(inner)
    known = inner[parent[v]]
    ended = (ends > row)[v].tolist()
    add(
        len(v), kind=[INNER] * len(v), conv_id=smallest[v].tolist(), depth=level[v].tolist(), n_convs=n_convs[v].tolist(), n_children=children[v].tolist(), n_leaves=n_leaves[v].tolist(),
        parent_conv_id=[int(c) if k else None for c, k in zip(smallest[parent[v]], known, strict=True)],
        parent_side=[None if k else 0 if f else 1 for k, f in zip(known, on_first[parent[v]], strict=True)],
        saved_tokens=saved_inner[v].tolist(), ends_sha256=[hashlib.sha256(ids(x).encode()).hexdigest() if e else NO_ENDS for x, e in zip(v.tolist(), ended, strict=True)],
    )
    for side, (members, path) in enumerate(((np.flatnonzero(on_first), paths[0]), (np.flatnonzero(on_last), paths[-1]))):
        keys = _prefix_digests(path)
        own = np.ones(len(members), bool) if side == 0 else ~on_first[members]  # what both spines share counts once
        count = lambda x: np.where(own, x[members], 0).tolist()  # noqa: E731, B023
        add(
            len(members), kind=[SPINE] * len(members), side=[side] * len(members), conv_id=smallest[members].tolist(), depth=level[members].tolist(), n_convs=count(n_convs), n_children=count(children),
            n_leaves=count(leaves_inner), saved_tokens=count(saved_inner), node=keys, parent=[None, *keys[:-1]], size=size[members].tolist(),
        )
        ending = [x for x, mine in zip(members.tolist(), own, strict=True) if mine and ends[x] > row[x]]
        add(len(ending), kind=[ENDS] * len(ending), node=[keys[level[x]] for x in ending], ids=[ids(x) for x in ending])
    return out


def _shards(paths: DataFrame) -> DataFrame:
    """The rows of all shards, from conv_id, path and sizes."""
    schema = to_arrow_schema(StructType.fromDDL(_PARTS))

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        conv, held, sizes, turns = [], [], [], 0

        def flush():
            columns = shard_rows(np.concatenate(conv), held, np.concatenate(sizes).astype(np.int64))
            n = len(columns["kind"])
            columns |= {"part": np.full(n, part), "seq": np.full(n, seq)}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                cut = batch.slice(at, 4096)
                conv.append(cut.column(0).to_numpy(zero_copy_only=False))
                held += cut.column(1).to_pylist()
                sizes.append(cut.column(2).flatten().to_numpy(zero_copy_only=False))
                turns += len(sizes[-1]) + cut.num_rows
                if turns >= SHARD_TURNS:
                    yield flush()
                    seq, conv, held, sizes, turns = seq + 1, [], [], [], 0
        if held:
            yield flush()

    # Copies of one conversation are split by conv_id, which also settles the order in the digests of ends.
    ordered = paths.select("conv_id", "path", "sizes").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(run, _PARTS)


def _ends_digests(parts: DataFrame) -> DataFrame:
    """node, ends_sha256 of the spines' nodes at which conversations end: pieces in order of shards, one held at a time."""

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    ends = parts.where(F.col("kind") == ENDS).select("node", "ids", "part", "seq")
    return ends.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def turn_paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (key: digest of role and text, size: bytes of the text) of every conversation, in order of turn.

    A null turn comes first, equal ones go by role and text; a null role or text is empty. Rows without a
    conv_id belong to no conversation. Repeated rows are turns of their own. Texts are not moved: a
    conversation's digests (24 bytes a turn or so) meet in one row.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said[0].alias("role"), said[1].alias("text"))
    # The role's length keeps role and text apart.
    key = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, DIGEST)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    placed = rows.select("conv_id", F.struct(place.alias("place"), key.alias("key"), F.octet_length("text").alias("size")).alias("t"))
    return placed.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), ""))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations (conv_id, turns as turn_paths gives them, one row each).

    Each distinct sequence of first d turns is a node of depth d, from the root (0), which has no text.
    Returns conv_id (the smallest of the conversations that begin so), depth, parent_conv_id (null for the
    root), n_convs (conversations that begin so), n_children, n_leaves (childless nodes in the subtree),
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text) and ends_sha256
    (of the ids of the conversations that end there, ascending, joined by commas). A conversation without
    turns ends at the root. Without conversations there are no nodes.
    """
    paths = saved(conversations.select("conv_id", _path(F.col("turns")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    parts = saved(_shards(paths))
    spines = parts.where(F.col("kind") == SPINE)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    first = [F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min(F.struct("part", "seq", "side")).alias("owner")]
    nodes = saved(spines.groupBy("node", "parent", "depth").agg(*sums, *first))
    # Each node of a spine adds to those above it, by the one spine that owns it; a spine's sums run upwards.
    inner = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more")).where("node is not null")
    nodes = nodes.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = nodes.select("node", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saves"))
    mine = F.col("owner") == F.struct("part", "seq", "side")
    up = Window.partitionBy("part", "seq", "side").orderBy(F.desc("depth"))
    along = spines.select("node", "part", "seq", "side", "depth").join(own, "node").select("node", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(up).alias(c) for c in ("leaf", "saves")))
    above = along.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    names = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    digest = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = nodes.join(above, "node").join(_ends_digests(parts), "node", "left").join(names, "parent", "left").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saves")})
    merged = merged.select(*columns[:-1], digest)
    # A finished node below a spine asks for its parent's name by the spine's shard, so no parent is a hot key.
    finished = parts.where(F.col("kind") == INNER)
    spine_names = spines.select("node", "part", "seq", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth")).join(nodes.select("node", F.col("conv_id").alias("name")), "node").drop("node")
    below = finished.where("parent_side is not null").drop("parent_conv_id").join(spine_names, ["part", "seq", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("name"))
    return merged.unionByName(finished.where("parent_side is null").select(*columns)).unionByName(below.select(*columns))


def regrown(conversations: DataFrame, heads: int = 9, family: int = 5) -> DataFrame:
    """Each conversation c after the first h turns of conversation c - c % family in place of its own; h is crc32(c) % heads.

    Of a shorter conversation all turns are taken, of a missing one none; the conversation's own turns after its first h follow.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    begins = conversations.select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = conversations.withColumns({"base": c - c % family, "h": h}).join(begins, "base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), rest).alias("turns"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the regrown conversations; rows without conv_id belong to none, an empty table has no nodes."""
    return prefix_trie(regrown(saved(turn_paths(table(spark, sf_dir, "conversations")))))


#: crc32 of the decimal id: bit by bit over its bytes. Every prefix is spelled out as a list of turns.
ORACLE_SQL = """
WITH RECURSIVE said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, list(said ORDER BY k) AS turns FROM said GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_prepend(ascii((conv_id::VARCHAR)[i])::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h FROM convs
), grown AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns FROM convs c JOIN crc USING (conv_id) LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), member AS (SELECT conv_id, turns[1:d] AS node, d, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM grown)),
nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
    CASE WHEN d > 0 THEN (count(*) - 1) * strlen(node[d].t) ELSE 0 END AS saves FROM member GROUP BY node, d
), children AS (SELECT node[:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children c USING (node)),
above AS (SELECT node[1:unnest(range(0, depth + 1))] AS node, saves, n_children FROM counted),
sums AS (SELECT node, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY node)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums s USING (node) LEFT JOIN counted p ON c.depth > 0 AND p.node = c.node[:c.depth - 1]
"""
