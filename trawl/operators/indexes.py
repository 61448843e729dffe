"""Stored trigram indexes, which narrow a search to rows that may match, and when to use them.

An index has two tables in its store: postings (tri, id) and lengths (tri, n). A trigram is the crc32 of its
three bytes, which no two trigrams share; a row is known by the 64-bit hash of its key. What the index gives is
a superset, so equal hashes, and rows that changed meanwhile, do no harm: the search's own condition decides.

    base       slices of rows side by side, each sorted by trigram, with a list of ids a trigram. A lookup skips
               the pages of other trigrams; Parquet writes each id of a slice once, and its short number in the lists
    deltas     the pairs of changed rows, and a mark for each row whose earlier pairs no longer count
    lengths    of the base; deltas add theirs, so they are upper bounds until the next compaction

A search asks the lengths first. If the rarest trigram of what each match must hold is in more than a tenth
of the rows, they are scanned; a trigram that is nowhere ends the search.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import syntax as S
from ..sources.storage import ROW_GROUP
from ..sources.store import GONE, Store

#: Share of the rows above which an index is not worth its lookups.
SCAN_SHARE = 0.1
#: Trigrams looked up for a text, the rarest first.
LOOKED_UP = 4
#: Ids that are handed to the scan as literals, for which it skips pages; and ids that go to all executors at once (8 bytes each).
LITERAL_IDS, BROADCAST_IDS = 64, 1 << 20
#: Pairs of a slice, which one task holds at once.
SLICE = 1 << 21
#: Lengths that the driver remembers; a version's never change.
MAX_KNOWN = 100_000
_lengths: dict[tuple[str, str, int], dict[int, int]] = {}


def row_id(key: str = "path_key") -> Column:
    return F.xxhash64(F.col(key))


#: Letters that a pattern without regard to case takes for an ASCII letter, and those letters.
_FOLDED = "\u017f\u0131\u212a", "sik"


def codes(text: Column) -> Column:
    """Distinct trigrams of the ASCII-lowered UTF-8 bytes; none in fewer than three bytes or a null."""
    raw = F.encode(F.translate(T.ascii_lower(F.coalesce(text, F.lit(""))), *_FOLDED), "utf-8")

    def of(r: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(r) - 2, F.lit(1)))
        every = F.transform(places, lambda i: F.crc32(F.substr(r, i, F.lit(3))))
        return F.when(F.octet_length(r) < 3, F.array().cast("array<bigint>")).otherwise(F.array_distinct(every))

    # As a variable of a lambda the bytes are made once, not anew for each trigram.
    return F.element_at(F.transform(F.array(raw), of), 1)


def codes_of(text: str) -> list[int]:
    return [zlib.crc32(t) for t in T.trigrams_of(text.translate(str.maketrans(*_FOLDED)))]


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def all_of(parts: list):
    """What all parts ask for; parts that ask for nothing (None) do not narrow."""
    known = tuple(p for p in parts if p is not None)
    return known[0] if len(known) == 1 else All(known) if known else None


def any_of(parts: list):
    """What one of the parts asks for: nothing, if one of them asks for nothing."""
    if not parts or any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else Any(tuple(parts))


def _leaves(need) -> set[str]:
    return {need} if isinstance(need, str) else {x for p in need.parts for x in _leaves(p)}


def listed(held: list) -> pa.RecordBatch:
    """Pairs (tri, id) by trigram, with a list of ids each, in the order they came in."""
    tri, ids = (np.concatenate(parts) for parts in zip(*held, strict=True))
    order = np.argsort(tri, kind="stable")
    tri = tri[order]
    starts = np.flatnonzero(np.r_[True, tri[1:] != tri[:-1]])
    lists = pa.ListArray.from_arrays(np.r_[starts, len(tri)].astype("int32"), pa.array(ids[order]))
    return pa.RecordBatch.from_arrays([pa.array(tri[starts]), lists], ["tri", "id"])


class TrigramIndex:
    """An index of the store by name; rows counts those of the table that it is on."""

    def __init__(self, store: Store, name: str, version: int | None = None):
        self.store, self.name = store, name
        self.commit = store.head() if version is None else store.at(version)

    # ---- upkeep ----

    @staticmethod
    def pairs(rows: DataFrame, column: str, key: str = "path_key") -> DataFrame:
        return rows.select(F.explode(codes(F.col(column))).alias("tri"), row_id(key).alias("id"))

    @staticmethod
    def arranged(pairs: DataFrame) -> DataFrame:
        """tri, id: slices of the pairs as they come, each sorted by trigram, with the ids of each as a list. Nothing is shuffled."""

        def run(batches):
            held, size = [], 0
            for batch in batches:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
                if size >= SLICE:
                    yield listed(held)
                    held, size = [], 0
            if size:
                yield listed(held)

        return pairs.select("tri", "id").mapInArrow(run, "tri long, id array<long>")

    @classmethod
    def built(cls, store: Store, name: str, rows: DataFrame, column: str, key: str = "path_key", table: str | None = None) -> dict:
        """The index's tables over all rows, for Store.replace. table: that of the store which holds the rows, if one does; compactions read it."""
        postings = store.stage(cls.arranged(cls.pairs(rows, column, key)), f"{name}_postings", ROW_GROUP, "id", [table, column, key] if table else None)
        return {f"{name}_postings": (postings, "id"), f"{name}_lengths": (cls.counted(postings.df).repartitionByRange("tri").sortWithinPartitions("tri"), None)}

    @staticmethod
    def counted(lists: DataFrame) -> DataFrame:
        """tri, n of a base."""
        return lists.groupBy("tri").agg(F.sum(F.size("id")).cast("long").alias("n"))

    @classmethod
    def changed(cls, store: Store, name: str, rows: DataFrame, gone: DataFrame, column: str, key: str = "path_key") -> dict:
        """Deltas for rows that are new or have new texts, and for keys that are gone, for Store.change."""
        touched = rows.select(key).unionByName(gone.select(key))
        marks = touched.select(F.lit(None).cast("long").alias("tri"), row_id(key).alias("id"), F.lit(True).alias(GONE))
        pairs = cls.pairs(rows, column, key).withColumn(GONE, F.lit(False))
        postings = store.stage(pairs.unionByName(marks), f"{name}_postings")
        return {f"{name}_postings": postings, f"{name}_lengths": postings.df.where("tri is not null").groupBy("tri").agg(F.count("*").alias("n"))}

    @classmethod
    def compact(cls, store: Store, name: str) -> None:
        """Folds the deltas in; lengths become exact. Where the store has the rows, their pairs are made anew: they would be shuffled otherwise."""

        def arranged(pairs: DataFrame) -> DataFrame:
            # What is in the table by now is in the deltas that stay behind the new base as well.
            head = store.head()
            source = head.tables[f"{name}_postings"].source
            return cls.arranged(cls.pairs(store._read(head.tables[source[0]]), *source[1:]) if source else pairs)

        done = store.compact(f"{name}_postings", arranged, block=ROW_GROUP)
        # Lengths of what the new base holds; deltas that others add meanwhile add theirs again, which keeps them upper bounds.
        lengths = cls.counted(store.spark.read.parquet(f"{store.path}/{done.tables[f'{name}_postings'].base}"))
        later = store.head().tables[f"{name}_postings"].deltas
        for folder in later:
            lengths = lengths.unionByName(store.spark.read.parquet(f"{store.path}/{folder}").where("tri is not null").groupBy("tri").agg(F.count("*").alias("n")))
        exact = lengths.groupBy("tri").agg(F.sum("n").alias("n")) if later else lengths
        store.replace({f"{name}_lengths": (exact.sortWithinPartitions("tri"), None)})

    # ---- lookup ----

    def postings(self) -> DataFrame:
        return self.store._read(self.commit.tables[f"{self.name}_postings"])

    def lengths(self, wanted: list[int]) -> dict[int, int]:
        """Upper bounds of the postings' lengths of some trigrams: one row a trigram reaches the driver."""
        known = _lengths.setdefault((self.store.path, self.name, self.commit.version), {})
        new = [c for c in wanted if c not in known]
        if new:
            if sum(map(len, _lengths.values())) > MAX_KNOWN:
                _lengths.clear()
                known = _lengths.setdefault((self.store.path, self.name, self.commit.version), {})
                new = wanted
            table = self.store._read(self.commit.tables[f"{self.name}_lengths"])
            found = table.where(F.col("tri").isin(new)).groupBy("tri").agg(F.sum("n").alias("n")).collect()
            known |= {c: 0 for c in new} | {r["tri"]: r["n"] for r in found}
        return {c: known[c] for c in wanted}

    def bound(self, need, lengths: dict[int, int]) -> int | None:
        """At most so many rows can match; None: any number can."""
        if isinstance(need, str):
            return min((lengths[c] for c in codes_of(need)), default=None)
        bounds = [self.bound(p, lengths) for p in need.parts]
        if isinstance(need, All):
            return min((b for b in bounds if b is not None), default=None)
        return None if None in bounds else sum(bounds)

    def ids(self, need, lengths: dict[int, int], every: bool = False) -> DataFrame:
        """id of the rows that may match. every: by all trigrams of each text, not the rarest alone."""
        texts = sorted(_leaves(need))
        chosen = {x: sorted(codes_of(x), key=lengths.__getitem__)[: None if every else LOOKED_UP] for x in texts}
        found = self.postings().where(F.col("tri").isin(sorted({c for cs in chosen.values() for c in cs})))
        place = {x: f"t{i}" for i, x in enumerate(texts)}
        # Pairs are unique, so a text is held if as many of its trigrams were met.
        held = found.groupBy("id").agg(*(F.count_if(F.col("tri").isin(chosen[x])).alias(place[x]) for x in texts))

        def holds(need) -> Column:
            if isinstance(need, str):
                return F.col(place[need]) >= len(chosen[need])
            return (T.all_of if isinstance(need, All) else T.any_of)([holds(p) for p in need.parts])

        return held.where(holds(need)).select("id")

    def narrowed(self, rows: DataFrame, need, total: int, key: str = "path_key", share: float = SCAN_SHARE) -> DataFrame:
        """The rows that may hold what is needed (a text, All or Any of such, or None), or all where a scan is cheaper.

        total: how many rows there are, about. rows may have an id column, by which their pages can be skipped.
        """
        if need is None:
            return rows
        lengths = self.lengths(sorted({c for x in _leaves(need) for c in codes_of(x)}))
        bound = self.bound(need, lengths)
        if bound is None or bound > share * total:
            return rows
        if bound == 0:
            return rows.where(F.lit(False))
        ids = self.ids(need, lengths)
        stored = "id" in rows.columns
        if stored and bound <= LITERAL_IDS:
            few = [r["id"] for r in ids.collect()]
            return rows.where(T.any_of([F.col("id") == i for i in few]))
        if bound <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        if stored:
            return rows.join(ids, "id", "left_semi")
        return rows.withColumn("_id", row_id(key)).join(ids.withColumnRenamed("id", "_id"), "_id", "left_semi").drop("_id")


# ---- what a search needs ----


def certain(text: str) -> str:
    """The part of a text that a column in small letters holds as it is: its longest run of ASCII characters."""
    return max((p.lower() for p in re.split(r"[^\x00-\x7F]+", text)), key=len)


#: Quoted text, an escape, a class, a quantifier, a group's opening, or one character.
_TOKENS = re.compile(r"\\Q(?P<quoted>.*?)(?:\\E|$)|\\(?P<escaped>.)|(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<many>(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??)|(?P<open>\((?:\?:|\?<[A-Za-z]\w*>)?)|(?P<other>.)", re.S)
#: Flags in the pattern, escapes with arguments, and classes in classes: of such patterns nothing is said.
_OPAQUE = re.compile(r"\(\?(?!:|<[A-Za-z])|\\[^dDwWsSbBAzZGhHvVRtnrfaeXQE\W_]|\[[^\]]*(?:\[|&&)")


def pattern_needs(pattern: str):
    """Texts, under All and Any, that every match of a pattern holds, in small letters; None if nothing is certain."""
    if _OPAQUE.search(pattern):
        return None
    tokens, at = list(_TOKENS.finditer(pattern)), 0

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(tokens) and tokens[at][0] == "|":
            at += 1
            options.append(sequence())
        return any_of(options)

    def sequence():
        nonlocal at
        needs, run = [], ""

        def close():
            nonlocal run
            if len(certain(run)) >= 3:
                needs.append(certain(run))
            run = ""

        while at < len(tokens) and tokens[at][0] not in ("|", ")"):
            m, inner, plain = tokens[at], None, ""
            at += 1
            if m["open"]:
                inner = alternatives()
                at += 1  # the closing bracket
            elif m["quoted"] is not None:
                plain = m["quoted"]
            elif m["escaped"] and not m["escaped"].isalnum():
                plain = m["escaped"]
            elif m["other"] and m["other"] not in "^$.":
                plain = m["other"]
            least = 1
            if at < len(tokens) and tokens[at]["many"]:
                quantifier = tokens[at]["many"]
                least = int(re.match(r"\{([0-9]+)", quantifier)[1]) if quantifier[0] == "{" else int(quantifier[0] == "+")
                at += 1
                # It repeats the last character alone.
                run, plain = run + plain[:-1] + plain[-1:] * min(least, 1), ""
            run += plain
            if not plain:
                close()
            if inner is not None and least:
                needs.append(inner)
        close()
        return all_of(needs)

    need = alternatives()
    return need if at >= len(tokens) else None


def needs(node):
    """What every record that a query's tree finds holds in its match_path; None if nothing is certain."""
    if isinstance(node, S.Term):
        if node.mode == S.REGEX:
            return pattern_needs(node.text)
        texts = re.split(r"[*?]+", node.text) if node.mode == S.GLOB else [node.text]
    elif isinstance(node, S.PathSegments):
        texts = [s.text for s in node.segments]
    elif isinstance(node, S.Filter) and node.name == "path":
        texts = [node.argument]
    elif isinstance(node, S.And):
        return all_of([needs(p) for p in node.parts])
    else:
        return any_of([needs(p) for p in node.parts]) if isinstance(node, S.Or) else None
    return all_of([certain(t) for t in texts if len(certain(t)) >= 3])
