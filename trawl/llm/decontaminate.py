"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least a given share of its distinct word shingles is there; an
item of fewer words than a shingle, if all its words stand there in a row.
Items are partitioned by their number of shingles (powers of two). An item's MinHash signature is
its shingles with the least hashes; a partition's signatures are so long that an item of m shingles
has at least m - ceil(share * m) + 1 of them. Of so many shingles at least one is in every document
that contains the item, however long the document, so a search for signature shingles among the
document's loses no item. Candidates are then verified by exact containment of the shingles
themselves, as strings. Items are searched in blocks of bounded size, one after another; the driver and
each executor hold one block at a time.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_arrow, map_arrow, saved, shingles, table, words

SHARE, WORDS = 0.8, 5
#: Characters of items searched at a time; what is broadcast is a small multiple of it.
BLOCK_CHARS = 4_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes a worker remembers.
_MAX_WORDS = 300_000


def partition_of(m: int) -> int:
    """Items of 2^p to 2^(p+1) - 1 shingles share partition p."""
    return m.bit_length() - 1


def signature_size(m: int, share: float) -> int:
    """Length of the signatures of m's partition, m at most."""
    longest = 2 ** (partition_of(m) + 1) - 1
    return min(m, longest - math.ceil(share * longest - 1e-9) + 1)


class ContainmentIndex:
    """Signatures of a block of items, and their shingles for the verification."""

    def __init__(self, items: list[tuple[int, str]], share: float, n: int):
        self.share, self.n, self.word_hash = share, n, {}
        self.items = []
        self.sizes = set()  # words of a shingle
        signatures: dict[int, list[int]] = {}
        for item_id, text in items:
            own = set(shingles(words(text), n))
            if not own:
                continue
            size = next(iter(own)).count(" ") + 1  # of each of them
            self.sizes.add(size)
            hashes = sorted(self.hash_one(s.split(" ")) for s in own)
            for h in hashes[: signature_size(len(own), share)]:
                signatures.setdefault(h, []).append(len(self.items))
            self.items.append((item_id, size, own))
        self.hashes = np.array(sorted(signatures), np.uint64)
        self.owners = [signatures[h] for h in self.hashes.tolist()]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def of_words(self, tokens: list[str]) -> np.ndarray:
        known = self.word_hash
        if len(known) > _MAX_WORDS:
            known.clear()
        out = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def combine(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all n-word runs from the words' hashes."""
        count = len(h) - n + 1
        out = np.full(count, np.uint64(n))
        for k in range(n):
            out = (out ^ h[k : k + count]) * _FACTOR
            out ^= out >> np.uint64(29)
        return out

    def hash_one(self, tokens: list[str]) -> int:
        return int(self.combine(self.of_words(tokens), len(tokens))[0])

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those contained) of the items contained in a text."""
        tokens = words(text)
        if not tokens or not self.items:
            return []
        of_words = self.of_words(tokens)
        found = set()
        for n in self.sizes:
            if n > len(tokens):
                continue
            h = self.combine(of_words, n)
            h = h[self.sieve[(h >> np.uint64(42)).astype(np.int64)]]
            if len(h):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found.update(i for k in set(at[self.hashes[at] == h].tolist()) for i in self.owners[k])
        own = {n: set(shingles(tokens, n)) for n in {self.items[i][1] for i in found}}
        out = []
        for i in sorted(found):
            item_id, n, theirs = self.items[i]
            inside = len(theirs & own[n])
            if inside >= self.share * len(theirs) - 1e-9:
                out.append((item_id, len(theirs), inside))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """Lists of (id, text), each of a bounded size; one block is read at a time."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted(((r["id"], r["text"]) for r in part.distinct().collect()), key=lambda x: (x[0] is None, x))


def contained_items(docs: DataFrame, items: DataFrame, share: float = SHARE, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, doc_id, n_shingles, n_contained, containment for every item contained in a document.

    Texts count whole; shingles are distinct and of n words, or of all words of a shorter item. Null and empty texts contain nothing and are contained in
    nothing. Rows that repeat an item are one item; documents that repeat give a row each. Other
    columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = f"item_id long, {id_col} long, n_shingles long, n_contained long, containment double"
    out, index = None, None
    for block in item_blocks(items):
        if index is not None:  # this block's results are kept as files, and its items forgotten
            out = saved(out)
            index.destroy()
        index = spark.sparkContext.broadcast(ContainmentIndex(block, share, n))

        def start(index=index):
            return lambda rows: [(i, d, m, k, k / m) for d, t in rows for i, m, k in index.value.search(t)]

        found = map_arrow(docs.select(id_col, text_col), schema, start)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE, n: int = WORDS, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, that contain no item.

    Documents with null and empty texts stay, as do all if there are no items; null and empty items are
    in no document. Repeated rows are treated alike; columns may have any names; an empty table gives an
    empty result.
    """
    index = None
    for block in item_blocks(items):
        if index is not None:  # what is left is kept as files, and this block's items forgotten
            docs = saved(docs)
            index.destroy()
        index = docs.sparkSession.sparkContext.broadcast(ContainmentIndex(block, share, n))

        def start(index=index):
            return lambda texts: [not index.value.search(t) for t in texts]

        docs = filter_arrow(docs, text_col, start)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that contain them; null and empty texts contain nothing. See contained_items()."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, least(len(w), 5) AS n, {_SHINGLES} AS l FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))),
t AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
d AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' ')))) AS s FROM t, (SELECT DISTINCT n FROM i WHERE n > 0)),
p AS (SELECT item_id, n, len(l) AS n_shingles, unnest(l) AS s FROM i),
c AS (SELECT item_id, doc_id, n_shingles, count(*) AS n_contained FROM p JOIN d USING (n, s) GROUP BY ALL)
SELECT item_id, doc_id, n_shingles, n_contained, n_contained / n_shingles AS containment FROM c WHERE n_contained >= 0.8 * n_shingles
"""
