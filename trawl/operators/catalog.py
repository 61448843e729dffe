"""The catalog of files and searches over it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T
from ..plans import compile as C
from ..plans import syntax as S
from ..sources.store import Store
from .indexes import TrigramIndex, needs

#: Kinds of record.
FILE, DIRECTORY, SYMLINK, OTHER, BUNDLE = 1, 2, 3, 4, 5
FILES = t.StructType(
    [
        t.StructField("name", t.StringType()),
        t.StructField("path", t.StringType()),
        t.StructField("type", t.IntegerType()),
        t.StructField("size", t.LongType()),
        t.StructField("mod_time", t.LongType()),
        t.StructField("inode", t.LongType()),
        t.StructField("dev_id", t.IntegerType()),
    ]
)
BASE = [f.name for f in FILES]


def derive(files: DataFrame) -> DataFrame:
    """Adds the columns that queries read; materialised at ingestion so that filters reach the Parquet scan.

    Missing inode and dev_id become 0. Columns of these names that exist already are replaced.
    """
    missing = {c: F.lit(0) for c in ("inode", "dev_id") if c not in files.columns}
    f = files.withColumns({**missing, "name": F.coalesce("name", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    f = f.withColumns({"inode": F.col("inode").cast("long"), "dev_id": F.col("dev_id").cast("int"), "name_lower": F.lower("name"), "path_lower": F.lower("path")})
    full = T.full_path(F.col("path"), F.col("name"))
    f = f.withColumns({
        "full_path": full,
        "path_key": F.lower(full),
        "match_path": F.concat("path_lower", F.lit("/"), "name_lower"),
        "ext": T.extension(F.col("name_lower")),
        "depth": T.depth(F.col("path")),
        "name_len": F.octet_length("name_lower"),
    })
    return f.withColumn("full_len", F.octet_length("match_path"))


def last_wins(files: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a path_key: that of the greatest seq. A partial aggregate runs before the shuffle."""
    rest = [c for c in files.columns if c not in ("path_key", seq)]
    top = files.groupBy("path_key").agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return top.select("path_key", *(F.col(f"r.{c}").alias(c) for c in rest))


class Catalog:
    """Searches over a derived files DataFrame.

    postings: optional (tri, path_key) of match_path, or a stored index of it (indexes.TrigramIndex) with
    the number of files. Either narrows a search to rows that hold the trigrams of the texts every match
    must hold; it never changes results.
    """

    def __init__(self, files: DataFrame, postings: DataFrame | None = None, *, index: TrigramIndex | None = None, total: int = 0):
        self.files, self.postings, self.spark = files, postings, files.sparkSession
        self.index, self.total = index, total

    @classmethod
    def stored(cls, store: Store, files: str = "files", index: str = "names") -> Catalog:
        """The catalog in a store, with its index if it has one."""
        head = store.head()
        t = head.tables[files]
        has = f"{index}_postings" in head.tables
        return cls(store._read(t), index=TrigramIndex(store, index, head.version) if has else None, total=t.rows + t.changed)

    def search(self, query: str, limit: int = 0, *, use_index: bool = True, now: datetime | None = None, tz: str = "UTC", home: str | None = None, adjacency: str = "reference") -> DataFrame:
        """Matching records in order of rank: priority, length of the path, path_key. limit 0: all.

        A blank query, and one that parses to nothing, match nothing.
        """
        text = S.prepare(query, home)
        whole = S.path_query(text)
        if whole.mode == S.CHILDREN:
            found = self.children(whole, adjacency).withColumn("priority", F.lit(2))
        else:
            tree = S.parse(text) if text else None
            if tree is None:
                return self._ranked(self.files.where(F.lit(False)).withColumn("priority", F.lit(2)), limit)
            tree = S.rewrite(tree)
            rows = self._narrowed(tree) if use_index else self.files
            found = rows.where(C.Compiler(now, tz, adjacency).column(tree)).withColumn("priority", C.priority(S.scoring_text(tree)))
        return self._ranked(found, limit)

    def _ranked(self, found: DataFrame, limit: int) -> DataFrame:
        out = found.orderBy("priority", "full_len", "path_key")
        out = out.limit(limit) if limit else out
        return out.select("name", F.col("full_path").alias("path"), "type", "size", "mod_time", "priority", "path_key")

    def _narrowed(self, tree) -> DataFrame:
        if self.index is not None:
            return self.index.narrowed(self.files, needs(tree), self.total)
        if self.postings is None:
            return self.files
        tris = sorted({g for text in C.required_texts(tree) if text.isascii() for g in T.trigrams_of(text)})
        if not tris:
            return self.files
        hit = self.postings.where(F.col("tri").isin(tris)).groupBy("path_key").agg(F.count_distinct("tri").alias("n"))
        return self.files.join(hit.where(F.col("n") == len(tris)), "path_key", "left_semi")

    @staticmethod
    def page(found: DataFrame, number: int, size: int = 100) -> DataFrame:
        """One page (from 0) of a search's result, which is in a total order."""
        return found.offset(number * size).limit(size)

    def children(self, q: S.PathQuery, adjacency: str = "reference") -> DataFrame:
        """Direct children of the directories that a children query names."""
        where = (F.col("type") == DIRECTORY) & (F.col("name_lower") == q.name)
        if q.segments:
            where &= T.path_segments(F.col("path_lower"), q.segments, adjacency)
        parents = self.files.where(where).select(F.col("path_key").alias("path_lower")).distinct()
        return self.files.join(parents, "path_lower", "left_semi")

    def lookup(self, path: str) -> DataFrame:
        """The record at a full path, in any case of letters."""
        return self.files.where(F.col("path_key") == path.lower())

    def lookup_many(self, paths: DataFrame) -> DataFrame:
        """Records of a DataFrame of paths (column path); those not found are left out."""
        return self.files.join(paths.select(F.lower("path").alias("path_key")).distinct(), "path_key", "left_semi")

    def recent(self, n: int = 100, cap: int = 200) -> DataFrame:
        """The latest records of any kind, cap at most."""
        rows = self.files.orderBy(F.desc("mod_time"), "path_key").limit(min(n, cap))
        return rows.select("name", F.col("full_path").alias("path"), "type", "size", "mod_time", "path_key")

    def status(self) -> DataFrame:
        return self.files.agg(F.count("*").alias("live_records"), F.count_if(F.col("type") == FILE).alias("files"), F.count_if(F.col("type") == DIRECTORY).alias("folders"))

    def kinds(self) -> DataFrame:
        return self.files.groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))

    def extensions(self) -> DataFrame:
        return self.files.where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


class Cancelled(RuntimeError):
    """A newer search of the same session took this one's place."""


_sessions: dict[tuple[str, str], str] = {}
_sessions_lock = Lock()


@contextmanager
def session(spark: SparkSession, name: str):
    """Jobs started inside belong to a search session; an older search of the same name is cancelled, whatever
    thread it runs in, and raises Cancelled there. Without a name nothing is cancelled."""
    if not name:
        yield
        return
    context = spark.sparkContext
    key, group = (context.applicationId, name), f"{name}-{uuid.uuid4().hex}"
    with _sessions_lock:
        older, _sessions[key] = _sessions.get(key), group
    if older is not None:
        context._jsc.sc().cancelJobGroupAndFutureJobs(older)  # also jobs that it has yet to start
    context.setJobGroup(group, f"search of {name}", interruptOnCancel=True)
    try:
        yield
        if _sessions.get(key) != group:
            raise Cancelled(name)
    except Exception as e:
        if _sessions.get(key) != group:
            raise Cancelled(name) from e
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        context.setLocalProperty("spark.job.interruptOnCancel", None)
        with _sessions_lock:
            if _sessions.get(key) == group:
                del _sessions[key]
