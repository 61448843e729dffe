"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks of 32 bits. The anchors of a block are the words of a covering code:
the perfect Hamming code of 31 bits (radius 1) and one free bit, so every block has an anchor within
distance 1. Two fingerprints that differ in few bits agree up to one bit in some block; a fingerprint
replicated to every anchor within 1 + 1 bits of it then meets the other at that one's nearest anchor.
Fingerprints are compared in whole only where they meet, and each meeting place hands on a minimum
spanning forest of its links, not all pairs: what is linked stays linked, and a group of n yields
fewer than n edges. Places with many fingerprints are cut into tiles, and each pair of tiles is
compared by itself, so no task holds a whole hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BROADCAST_KEYS, bounded_sample, map_arrow, saved, shingles, slices, small, table, words

SEED = 42
#: Fingerprints of a tile; a meeting place of more is compared tile by tile.
TILE = 1024
_PARITY = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
#: For each syndrome s > 0, the 15 pairs of bits whose positions' exclusive-or is s.
_PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s <= 31] if s else [0] * 15 for s in range(32)], np.uint32)


def majority(hashes: bytes) -> np.ndarray:
    """64 bits, the highest first: whether each is set in over half of the big-endian 64-bit values."""
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = sum(np.unpackbits(h[i : i + 4096], axis=1).sum(0, dtype=np.int64) for i in range(0, len(h), 4096))
    return total * 2 > len(h)


def fingerprint(features: list[str]) -> int:
    """A bit is 1 if it is set in over half of the features' XXH64 values; as a signed 64-bit integer."""
    if not features:
        return 0
    bits = majority(b"".join([xxhash.xxh64_digest(s, SEED) for s in features]))
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) from n-word shingles, repeats counted."""

    def start():
        return lambda rows: [(doc_id, fingerprint(shingles(words(text), n))) for doc_id, text in rows]

    return map_arrow(docs.select(id_col, text_col), f"{id_col} long, fp long", start, rows=256)


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 17) anchors of 32-bit blocks within distance 2, nearest first, and which of them exist."""
    x, free = block & np.uint32(0x7FFFFFFF), block & np.uint32(0x80000000)
    s = sum((np.bitwise_count(x & np.uint32(m)) & 1).astype(np.uint32) << np.uint32(j) for j, m in enumerate(_PARITY))
    nearest = np.where(s > 0, x ^ (np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32)), x)
    out = np.empty((len(x), 17), np.uint32)
    out[:, 0] = nearest | free
    out[:, 1] = nearest | (free ^ np.uint32(0x80000000))
    out[:, 2:] = (x[:, None] ^ _PAIRS[s]) | free[:, None]
    real = np.ones((len(x), 17), bool)
    real[s == 0, 2:] = False
    return out, real


def _meetings(nodes: DataFrame) -> DataFrame:
    """key, node, fp, home (whether it is the nearest anchor) for every anchor of both blocks."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node, fp = (part.column(c).to_numpy() for c in ("node", "fp"))
                for b, block in enumerate((fp >> 32, fp)):
                    found, real = anchors(block.astype(np.uint32))
                    home = np.zeros_like(real)
                    home[:, 0] = True
                    who = np.broadcast_to(np.arange(len(fp))[:, None], real.shape)[real]
                    columns = (found.astype(np.int64) | b << 32)[real], node[who], fp[who], home[real]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long, home boolean")


def forest(n: int, distances, limit: float) -> list[tuple[int, int]]:
    """Minimum spanning forest of the links of at most limit: pairs of numbers below n. Prim's method.

    distances(i): of i to all.
    """
    out = []
    best, source = np.full(n, np.inf), np.zeros(n, int)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(left, best, np.inf).argmin())
        if not left[i]:
            i = int(left.argmax())
        elif best[i] <= limit:
            out.append((int(source[i]), i))
        left[i] = False
        d = distances(i)
        closer = d < best
        best[closer], source[closer] = d[closer], i
    return out


def _in_tiles(rows: DataFrame, columns: list[str], compare) -> DataFrame:
    """a, b: what compare() finds among the nodes of each meeting place, distinct.

    rows: key, node, n (nodes of the place), whatever compare needs. A place of many nodes is cut into
    tiles, and each pair of tiles goes to a task by itself. compare gets a dictionary of columns and
    where places begin and end in them, and gives pairs of row numbers.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "node", *columns)
    dealt = dealt.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(table: pa.Table, cuts: np.ndarray):
        at = np.asarray(compare({c: table.column(c).to_numpy() for c in columns}, cuts), np.int64).reshape(-1, 2)
        ends = np.sort(table.column("node").to_numpy()[at], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
            place = np.column_stack([held.column(c).to_numpy() for c in ("key", "t", "u")])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            if len(cuts):  # the last place may go on in the next batch
                yield found(held, np.append(0, cuts))
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield found(held, np.array([0, held.num_rows]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, limit: int) -> DataFrame:
    """a, b (nodes): a spanning forest of all links of at most limit bits where anchors meet.

    nodes: node and fp (longs, not null), saved, one row a node; equal fp are a link of 0 bits. No link of
    at most 3 bits is missed. No nodes, or none that meet, give no rows.
    """
    rows = _meetings(nodes)
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("homes"))
    full = saved(full.where((F.col("n") > 1) & F.col("homes")).select("key", "n"))

    def compare(columns, cuts):
        out = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            fps = columns["fp"][s:e]
            if e == s + 2:
                out += [(s, s + 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= limit else []
            else:
                out += [(s + i, s + j) for i, j in forest(e - s, lambda i, fps=fps: np.bitwise_count((fps ^ fps[i]).view(np.uint64)), limit)]
        return out

    return _in_tiles(rows.select("key", "node", "fp").join(small(full, BROADCAST_KEYS), "key"), ["fp"], compare)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (least node reachable) for every node of edges a, b. Alternating large and small stars.

    Repeated edges, both directions and edges from a node to itself change nothing; nulls are not allowed.
    A node without an edge to another has no row, and no edges give none.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        # Each star is saved, so that no plan holds the edges more than twice: plans take the driver's memory.
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now = saved(small.where("u != v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of distinct edges u > v has one v, and no v is a u: alternating stars would change nothing."""
    up, down = (F.struct(F.col(end).alias("node"), F.lit(i).alias("up"), F.lit(1 - i).alias("down")) for end, i in (("u", 1), ("v", 0)))
    ends = edges.select(F.inline(F.array(up, down)))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def simhash_components(docs: DataFrame, n: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Fingerprints of n-word shingles link at max_distance or fewer differing bits (3 at most). Texts
    without words, null ones too, have fingerprint zero and link like any other. Repeated rows stay;
    a null doc_id keeps its row and counts for no component_id, which is null where a component has
    no other. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two blocks find links of at most 3 bits")
    fps = saved(fingerprints(docs, n, id_col=id_col, text_col=text_col))
    least = saved(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = components(links(least.select(F.col("fp").alias("node"), "fp"), max_distance))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(groups, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents sampled for shingles that many texts share, which go last in the order of prefixes, and
#: the number of those. Any order finds the same links.
SAMPLED, SHARED = 4000, 1 << 16
#: Nodes of a meeting place up to which all its pairs are looked at at once.
FEW = 8
#: Bits in which fingerprints of near duplicates may differ to be looked at where anchors meet.
NEAR_BITS = 12
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit values of its distinct n-word shingles; a shorter text is one
    shingle, no words (a null text) give none."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = cut.flatten().dictionary_encode()
    names = found.dictionary.to_pylist()
    value = np.array([xxhash.xxh64_intdigest(w, SEED) for w in names], np.uint64)
    word = found.indices.to_numpy()
    real = word != (names.index("") if "" in names else -1)  # blanks at the ends leave empty words
    h = value[word[real]]
    ends = np.append(0, np.cumsum(real))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]

    def mixed(k: int) -> np.ndarray:
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):  # each place mixes the value so far, so the order of words counts
            out = (out ^ (out >> np.uint64(29))) * _ODD[0] + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _ODD[1]
        return out ^ (out >> np.uint64(29))

    by_size: dict[int, np.ndarray] = {}
    sets = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        k = min(n, e - s)
        if k and k not in by_size:
            by_size[k] = mixed(k)
        own = np.sort(by_size[k][s : e - k + 1]) if k else h[:0]
        sets.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
    return sets


def prefix(own: np.ndarray, hot: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """As many of a set's values, the rarest first, as it takes to meet every set of that similarity.

    own: ascending; hot: frequent values, ascending, and their weights; the others come before them.
    """
    if not len(own):
        return np.zeros(1, np.uint64)  # texts without words meet each other
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if not len(hot):
        return own[:n]
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    is_hot = hot[at] == own
    cold = own[~is_hot]
    if len(cold) >= n:
        return cold[:n]
    rest = own[is_hot]
    return np.append(cold, rest[np.lexsort((rest, weight[at[is_hot]]))][: n - len(cold)])


def sketch(own: np.ndarray) -> bytes:
    """Which places of a power of two, at least 64 and about as many as values, hold an odd number of the values."""
    size = 64
    while size < len(own):
        size *= 2
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of several sets. Two sets differ in no fewer values than their sketches in places; the
    longer of two is folded to the other's size."""

    def __init__(self, sketches):
        own = [np.frombuffer(s, np.uint64) for s in sketches]
        self.words = np.array([len(s) for s in own], np.int64)
        self.row = np.zeros(len(own), np.int64)  # in the table of its size
        self.packed, self.folded = {}, {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.row[at] = np.arange(len(at))
            self.packed[w] = np.stack([own[i] for i in at.tolist()])
            if w > 1:
                self.folded[w] = self.packed[w][:, : w // 2] ^ self.packed[w][:, w // 2 :]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places in which each i's sketch differs from j's; infinite where sizes are too far apart for the sets to be near."""
        out = np.full(len(i), np.inf)
        a, b = self.words[i], self.words[j]
        for w, table in self.packed.items():
            ways = [(a == w) & (b == w), (table, i), (table, j)], [(a == 2 * w) & (b == w), (self.folded.get(2 * w), i), (table, j)], [(a == w) & (b == 2 * w), (table, i), (self.folded.get(2 * w), j)]
            for which, (x, p), (y, q) in ways:
                which = np.flatnonzero(which)
                for at in range(0, len(which), 1 << 16):
                    cut = which[at : at + (1 << 16)]
                    out[cut] = np.bitwise_count(x[self.row[p[cut]]] ^ y[self.row[q[cut]]]).sum(1, dtype=np.int64)
        return out


def _sketched(pairs: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """The pairs a, b of nodes whose sketches do not rule out that they differ in no more than that share of both sizes."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("odd").alias(f"odd_{end}")), end)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sketches = Sketches([*batch.column("odd_a").to_pylist(), *batch.column("odd_b").to_pylist()])
            both = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            near = sketches.differ(np.arange(n), np.arange(n, 2 * n)) <= most * both + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, hashed: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose shingle sets are as similar as asked for, saved."""
    pairs = saved(pairs)
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id", "hash"), "node")
    ends = saved(ends.withColumnsRenamed({"id": "__id", "hash": "__hash"}))
    # By id as well, so that copies of a text do not meet in one task.
    texts = hashed.join(small(ends), hashed["id"].eqNullSafe(ends["__id"]) & (hashed["hash"] == ends["__hash"])).select("node", "text")
    schema = "node long, own array<long>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                own = [s.view(np.int64) for s in shingle_sets(part.column(1), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, arrow.field(1).type)], schema=arrow)

    sets = saved(texts.mapInArrow(cut, schema).dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - common
    return saved(both.where((total == 0) | (common >= similarity * total - 1e-9)).select("a", "b"))


#: Bytes of text that are cut into shingles at a time.
SLICE_BYTES = 1 << 20


def _rooted(docs: DataFrame, n: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """hash, id (the least of the text's documents, null first), root for each different text, saved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"))

    def sampled():
        return lambda rows: [(own.view(np.int64),) for own in shingle_sets(pa.array([r[0] for r in rows]), n)]

    some = map_arrow(bounded_sample(hashed, "hash", SAMPLED).select("text").distinct(), "own array<long>", sampled, rows=256)
    top = some.select(F.explode("own").alias("v")).groupBy("v").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "v").limit(SHARED).collect()
    hot = np.array([r["v"] for r in top], np.int64).view(np.uint64)
    weight = np.array([r["c"] for r in top], np.int64)[np.argsort(hot)]
    hot = np.sort(hot)
    schema = "id long, hash binary, size int, fp long, odd binary, rare array<long>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def marked(batches):
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                sets = shingle_sets(part.column(2), n)
                fps = [int(np.packbits(majority(s.byteswap().tobytes())).view(">i8")[0]) if len(s) else 0 for s in sets]
                rare = [prefix(s, hot, weight, similarity).view(np.int64) for s in sets]
                columns = part.column(0), part.column(1), list(map(len, sets)), fps, list(map(sketch, sets)), rare
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    marks = saved(hashed.mapInArrow(marked, schema).withColumn("node", F.monotonically_increasing_id()))
    # One node for each different text.
    first = marks.groupBy("hash").agg(F.min(F.struct("id", "node")).alias("first")).select("first.node")
    nodes = saved(marks.select("node", "id", "hash", "size", "fp", "odd").join(small(saved(first), BROADCAST_KEYS), "node"))
    # Of both sizes, what links have in common at least and what differs at most.
    shared, most = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def near(columns, cuts, thin: bool):
        size, rest, root = columns["size"].astype(np.int64), columns["rest"], columns["root"]
        sketches = Sketches(columns["odd"]) if "odd" in columns else None

        def distances(i, j):
            """Of rows, by their sketches if there are any: as a share of both sizes, infinite where they cannot be a link or are in one group."""
            both = size[i] + size[j]
            d = np.full(len(i), np.inf)
            maybe = np.flatnonzero((np.minimum(rest[i], rest[j]) >= shared * both - 1e-6) & (root[i] != root[j]))
            d[maybe] = sketches.differ(i[maybe], j[maybe]) if sketches else 0
            return np.where(d <= most * both + 1e-6, d / np.maximum(both, 1), np.inf)

        begin, length = cuts[:-1], np.diff(cuts)
        out = [np.empty((0, 2), np.int64)]
        for n_rows in np.unique(length[length > 1]).tolist():
            starts = begin[length == n_rows]
            if n_rows <= FEW or not thin:
                for i in range(n_rows - 1):
                    a = np.repeat(starts + i, n_rows - 1 - i)
                    b = a + np.tile(np.arange(1, n_rows - i), len(starts))
                    ok = np.isfinite(distances(a, b))
                    out.append(np.column_stack([a[ok], b[ok]]))
            else:
                for s in starts.tolist():
                    at = np.arange(s, s + n_rows)
                    found = forest(n_rows, lambda i, at=at: distances(np.full(len(at), at[i]), at), most + 1e-6)
                    out.append(np.array(found, np.int64).reshape(-1, 2) + s)
        return np.concatenate(out)

    def grouped(known: DataFrame) -> DataFrame:
        """node, root of every node, of the pairs that are links."""
        roots = saved(components(known))
        return saved(nodes.select("node").join(small(roots, BROADCAST_KEYS), "node", "left").withColumn("root", F.coalesce("root", "node")))

    def several(rows: DataFrame) -> DataFrame:
        """key, n of the keys that nodes of different roots have, without pairs that cannot be links.

        At the first value that two sets share, what is left of each (its rest) holds all they have in common.
        """
        keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("size"), F.min("rest").alias("rest"))
        may = (F.col("n") > 2) | (F.col("rest") >= shared * F.col("size") - 1e-6)
        return saved(keys.where((F.col("low") < F.col("high")) & may).select("key", "n"))

    # Near copies first, by their fingerprints, so that few values are shared between groups.
    roots = grouped(_verified(links(nodes.select("node", "fp"), NEAR_BITS), nodes, hashed, n, similarity))
    rows = marks.select("node", "size", "rare").join(small(roots, BROADCAST_KEYS), "node").select("node", "size", "root", F.posexplode("rare").alias("at", "key"))
    rows = rows.select("key", "node", "root", "size", (F.col("size") - F.col("at")).alias("rest"))
    keys = several(rows)
    met = saved(rows.join(small(keys, BROADCAST_KEYS), "key").select("key", "node", "size", "rest"))
    for thin in (True, False):
        rows = met.join(small(roots, BROADCAST_KEYS), "node")
        keys = keys if thin else several(rows)
        places = rows.join(small(keys, BROADCAST_KEYS), "key")
        compare = lambda columns, cuts, thin=thin: near(columns, cuts, thin)
        # Pairs of small places are few, so sketches go to the pairs; of large ones, to the places.
        few = saved(_in_tiles(places.where(F.col("n") <= FEW), ["size", "rest", "root"], compare))
        many = places.where(F.col("n") > FEW).join(nodes.select("node", "odd"), "node")
        pairs = _sketched(few, nodes, most).unionByName(_in_tiles(many, ["size", "rest", "root", "odd"], compare)).distinct()
        found = _verified(pairs, nodes, hashed, n, similarity)
        if not found.isEmpty():
            roots = grouped(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return saved(nodes.select("node", "id", "hash").join(small(roots, BROADCAST_KEYS), "node").select("id", "hash", "root"))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (md5 of the text), root: groups of texts linked by a Jaccard similarity of at least
    `similarity` of their distinct n-word shingles. One row for each different id and text.

    Fingerprints of the shingles meet at their anchors, and what lies near there is verified on the
    shingles. As texts so alike may differ in more bits than anchors reach, the groups so found are
    completed by a prefix filter, which misses no link: such texts share one of the rarest values of
    each. Where values are shared between groups, first a minimum spanning forest of the pairs that
    may be links is verified, then whatever may still link two groups. A null text counts as empty;
    texts without words are all alike. Repeated rows give one row; a null id stays null. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    roots = _rooted(docs, n, similarity, id_col, text_col).select(F.col("hash").alias("__hash"), "root")
    pairs = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("hash")).distinct()
    return pairs.join(roots, pairs["hash"] == roots["__hash"]).select("id", "hash", "root")


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, one of each group of near duplicates: that of the least id
    (null ids first), of equal ids the least text hash, of equal rows any one.

    Groups are those of near_duplicates(), with its treatment of nulls and empty texts; other columns
    may have any name that does not begin with two underscores. An empty table gives an empty result.
    """
    found = _rooted(docs, n, similarity, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("first")).select(F.col("first.id").alias("__id"), F.col("first.hash").alias("__first"))
    # One key for the join and for repeated rows, so that documents are moved once.
    first = first.withColumn("__key", F.xxhash64("__id", "__first"))
    own = docs.withColumn("__hash", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    own = own.withColumn("__key", F.xxhash64(F.col(id_col), "__hash"))
    kept = own.join(first, (own["__key"] == first["__key"]) & own[id_col].eqNullSafe(first["__id"]) & (own["__hash"] == first["__first"]), "left_semi")
    return kept.dropDuplicates(["__key", id_col, "__hash"]).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; a text without words, null too, has fingerprint 0 and is linked like any other."""
    return simhash_components(table(spark, sf_dir, "documents"))
