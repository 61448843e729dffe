"""Full-text search in file contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import GONE, Commit, Store
from .indexes import ROW_GROUP, TrigramIndex, all_of, certain, codes_of, row_id

MAX_SIZE = 1 << 20
#: Bytes of texts that a task reads before it hands them on.
READ_BYTES = 8 << 20


def eligible(files: DataFrame, extensions: set[str]) -> DataFrame:
    """Regular files whose extension, or whole name if they have none, is among extensions; none: no file."""
    name = F.when(F.col("ext") == "", F.col("name_lower")).otherwise(F.col("ext"))
    wanted = sorted(e.lower() for e in extensions)
    return files.where((F.col("type") == 1) & (name.isin(wanted) if wanted else F.lit(False)))


def readable(contents: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Rows of binaryFile (path, modificationTime, length, content) that are texts of 1 to max_size bytes.

    A zero byte among the first 8192 marks a binary. Returns path_key, content, mod_time.
    """
    head = F.decode(F.substr("content", F.lit(1), F.lit(8192)), "ISO-8859-1")
    text = contents.where(F.col("length").between(1, max_size) & ~F.contains(head, F.lit("\0")))
    path = F.regexp_replace("path", "^file:/*", "/")
    return text.select(F.lower(path).alias("path_key"), F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").alias("mod_time"))


def read_files(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """path_key, content, mod_time of catalog rows whose file is a readable text; tasks open the files themselves.

    The files must be readable where the tasks run. One that is not there, too large or no text gives no row.
    """

    def run(batches):
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path_key", "content", "mod_time"])

        for batch in batches:
            for key, path, time in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    with open(path, "rb") as f:
                        data = f.read(max_size + 1)
                except OSError:
                    continue
                if 0 < len(data) <= max_size and b"\0" not in data[:8192]:
                    rows.append((key, data.decode("utf-8", "replace"), time))
                    size += len(data)
                if size > READ_BYTES:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return files.select("path_key", "full_path", "mod_time").mapInArrow(run, "path_key string, content string, mod_time long")


def with_hash(documents: DataFrame) -> DataFrame:
    return documents.withColumn("content_hash", F.xxhash64("content"))


def changed(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents to index anew: new ones, and those whose mod_time (0: unknown) and content hash both differ."""
    seen = indexed.select("path_key", F.col("mod_time").alias("old_time"), F.col("content_hash").alias("old_hash"))
    same_time = (F.col("mod_time") == F.col("old_time")) & (F.col("mod_time") != 0)
    same = F.coalesce(same_time | (F.col("content_hash") == F.col("old_hash")), F.lit(False))
    return with_hash(documents).join(seen, "path_key", "left").where(~same).drop("old_time", "old_hash")


def index(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """The index after seeing documents: each key's newest row, mod_time refreshed where the content is as before."""
    new = with_hash(documents).withColumn("fresh", F.lit(True))
    both = indexed.withColumn("fresh", F.lit(False)).unionByName(new)
    columns = [c for c in indexed.columns if c != "path_key"]
    top = both.groupBy("path_key").agg(F.max_by(F.struct(*columns), F.col("fresh")).alias("r"))
    return top.select("path_key", *(F.col(f"r.{c}").alias(c) for c in columns))


def prune(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Without documents whose file is gone."""
    return documents.join(files.select("path_key"), "path_key", "left_semi")


def search(documents: DataFrame, keyword: str, limit: int = 100, *, verify: bool = True, context: int = 80, postings: DataFrame | None = None) -> DataFrame:
    """path_key, snippet, match_offset of documents that hold keyword (3 bytes at least), ASCII case ignored.

    In order of path_key; limit 0: all. verify=False returns the candidates that hold all trigrams,
    without snippets. postings (tri, path_key) narrows the documents first.
    """
    tris = T.trigrams_of(keyword)
    rows = documents if tris else documents.where(F.lit(False))
    if tris and (postings is not None or not verify):
        own = postings if postings is not None else rows.select("path_key", F.explode(T.trigrams(F.col("content"))).alias("tri"))
        hit = own.where(F.col("tri").isin(tris)).groupBy("path_key").agg(F.count_distinct("tri").alias("n")).where(F.col("n") == len(tris))
        rows = rows.join(hit, "path_key", "left_semi")
    if verify:
        text = F.col("content")
        found, offset = T.snippet(text, keyword, context)
        rows = rows.where(F.contains(T.ascii_lower(text), F.lit(keyword.translate(str.maketrans(T._ASCII_UPPER, T._ASCII_LOWER)))))
        rows = rows.select("path_key", found.alias("snippet"), offset.alias("match_offset"))
    else:
        rows = rows.select("path_key", F.lit("").alias("snippet"), F.lit(0).cast("long").alias("match_offset"))
    rows = rows.orderBy("path_key")
    return rows.limit(limit) if limit else rows


def described(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Content matches with their file's name, path and kind."""
    return matches.join(files.select("path_key", F.col("name").alias("file_name"), F.col("full_path").alias("file_path"), F.col("type").alias("file_type")), "path_key")


class ContentIndex:
    """Contents and their trigram index in a store: what is searched, and how it follows the files.

    `contents` (path_key, id, mod_time, content_hash, content) is sorted by id, so a search reads the pages of
    its candidates. All methods that give deltas leave the commit to the caller, who can add other tables'.
    """

    TABLE, INDEX = "contents", "words"

    def __init__(self, store: Store, version: int | None = None):
        self.store = store
        self.commit = store.head() if version is None else store.at(version)

    @property
    def documents(self) -> DataFrame:
        return self.store._read(self.commit.tables[self.TABLE])

    @staticmethod
    def rows(documents: DataFrame) -> DataFrame:
        return with_hash(documents).select("path_key", row_id().alias("id"), "mod_time", "content_hash", "content")

    @staticmethod
    def arranged(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("id").sortWithinPartitions("id")

    @classmethod
    def built(cls, store: Store, documents: DataFrame) -> dict:
        """The index's tables over documents (path_key, content, mod_time; one row a key), for Store.replace. Null contents are left out."""
        contents = store.stage(cls.arranged(cls.rows(documents.where("content is not null"))), cls.TABLE, ROW_GROUP)
        return {cls.TABLE: (contents, "path_key")} | TrigramIndex.built(store, cls.INDEX, contents.df, "content", table=cls.TABLE)

    def deltas(self, documents: DataFrame, gone: DataFrame) -> dict:
        """For documents as they are now and keys (path_key) that are gone, as Store.change takes them.

        A document whose mod_time is known and as before is taken for unchanged; one with the content it
        had gets its new time, and keeps its postings. gone may hold keys that were never indexed.
        """
        seen = self.documents.select("path_key", F.col("mod_time").alias("old_time"), F.col("content_hash").alias("old_hash"))
        now = self.rows(documents.where("content is not null")).join(seen, "path_key", "left")
        same_time = (F.col("mod_time") == F.col("old_time")) & (F.col("mod_time") != 0)
        now = now.where(~F.coalesce(same_time, F.lit(False))).withColumn("as_before", F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False)))
        lost = seen.join(gone.select("path_key").distinct(), "path_key", "left_semi").select("path_key")
        columns = ["path_key", "id", "mod_time", "content_hash", "content"]
        marks = lost.select("path_key", row_id().alias("id"), *(F.lit(None).cast(k).alias(c) for c, k in (("mod_time", "long"), ("content_hash", "long"), ("content", "string"))), F.lit(True).alias(GONE))
        both = now.select(*columns, "as_before", F.lit(False).alias(GONE)).unionByName(marks.withColumn("as_before", F.lit(False)))
        # Written once; the index reads it back, and only rows with new texts.
        staged = self.store.stage(both, self.TABLE)
        new = staged.df.where("not gone and not as_before")
        return {self.TABLE: staged} | TrigramIndex.changed(self.store, self.INDEX, new, staged.df.where("gone"), "content")

    @classmethod
    def compact(cls, store: Store) -> Commit:
        store.compact(cls.TABLE, by="id", block=ROW_GROUP)
        TrigramIndex.compact(store, cls.INDEX)
        return store.head()

    def search(self, keyword: str, limit: int = 100, *, verify: bool = True, context: int = 80) -> DataFrame:
        """As search() over the documents, with the index where that is cheaper. verify=False takes the index's word."""
        t = self.commit.tables[self.TABLE]
        index = TrigramIndex(self.store, self.INDEX, self.commit.version)
        tris = T.trigrams_of(keyword)
        if not verify and tris:
            lengths = index.lengths(codes_of(keyword))
            found = self.documents.select("path_key", "id").join(index.ids(keyword, lengths, every=True), "id", "left_semi")
            rows = found.select("path_key", F.lit("").alias("snippet"), F.lit(0).cast("long").alias("match_offset")).orderBy("path_key")
            return rows.limit(limit) if limit else rows
        need = all_of([p for p in [certain(keyword)] if len(p) >= 3]) if tris else None
        return search(index.narrowed(self.documents, need, t.rows + t.changed), keyword, limit, context=context)
