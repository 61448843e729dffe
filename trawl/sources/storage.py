"""Snapshots of a catalog and change logs, as Parquet folders.

A snapshot is the table `files` of a store: see there how commits, deltas and readers get along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import NO_EVENT, Conflict, Store

FILES, KEY = "files", "path_key"
#: Bytes of a row group in tables that are looked up by a sorted column.
ROW_GROUP = 4 << 20


def versions(spark: SparkSession, base: str) -> DataFrame:
    return Store(spark, base).commits()


def write_snapshot(files: DataFrame, base: str, *, version: int | None = None, read: int | None = None, last_event: int = NO_EVENT, extra: dict | None = None, offline: list[str] | None = None, sort_by: str = "path") -> int:
    """Writes a whole snapshot, rows of a directory side by side, and makes it current. Returns its version.

    read: the version that files were made from; if another is current by then, store.Conflict is raised.
    version: the number it should get; if the snapshot has that already, nothing is written.
    """
    if version is not None and version in Store(files.sparkSession, base).versions():
        return version
    return Store(files.sparkSession, base).replace({FILES: (files.sortWithinPartitions(sort_by), KEY)}, read=read, last_event=last_event, extra=extra, offline=offline).version


def metadata(spark: SparkSession, base: str) -> dict | None:
    head = Store(spark, base).head()
    return head and {"version": head.version, "written_at": head.written_at, "last_event": head.last_event, "extra": head.extra, "offline": head.offline}


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The current snapshot, or an earlier version."""
    return Store(spark, base).read(FILES, version)


def compact(spark: SparkSession, base: str, log: str | None = None, files: int | None = None) -> int:
    """Merges a log's sound part into the snapshot and rewrites it, with all deltas, into few files.

    Metadata stays. Deltas that a stream adds meanwhile are kept.
    """
    from ..operators.mutations import apply_changes, replay

    store, new, last = Store(spark, base), None, NO_EVENT
    if log is not None and _exists(spark, log):
        new = replay(read_changes(spark, log)).where(F.col("seq") > store.head().last_event)
        newest = new.agg(F.max("seq")).first()[0]
        new, last = (None, NO_EVENT) if newest is None else (new, newest)

    def arranged(rows: DataFrame) -> DataFrame:
        rows = rows if new is None else apply_changes(rows, new)
        return (rows.repartitionByRange(files, "path", "name") if files else rows.repartitionByRange("path", "name")).sortWithinPartitions("path")

    return store.compact(FILES, arranged, last_event=last).version


#: Deltas of a table that are read one by one, before they are folded into one.
MAX_DELTAS = 16


def maintain(store: Store, share: float = 0.25) -> None:
    """Folds the deltas of tables that have many, and rewrites those whose deltas have grown to a share of them.

    If another writer replaces a table meanwhile, it is left for the next time.
    """
    from ..operators.content import ContentIndex
    from ..operators.indexes import TrigramIndex
    from ..operators.mutations import should_compact

    for name, t in store.head().tables.items():
        if t.key is None:
            continue  # lengths follow their postings
        try:
            if should_compact(t.rows, t.changed, share):
                if name.endswith("_postings"):
                    TrigramIndex.compact(store, name.removesuffix("_postings"))
                elif name == ContentIndex.TABLE:
                    store.compact(name, by="id", block=ROW_GROUP)
                else:
                    store.compact(name)
            elif len(t.deltas) > MAX_DELTAS:
                store.fold(name)
                if name.endswith("_postings"):
                    store.fold(name.removesuffix("_postings") + "_lengths")
        except Conflict:
            continue


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_changes(changes: DataFrame, log: str) -> None:
    """Adds changes to a log, each with the checksum of its row."""
    changes.withColumn("crc", checksum(changes)).write.mode("append").parquet(log)


def checksum(changes: DataFrame):
    return F.crc32(F.to_json(F.struct(*(c for c in changes.columns if c != "crc"))).cast("binary"))


def read_changes(spark: SparkSession, log: str) -> DataFrame:
    """The log's rows with corrupt, which marks those whose checksum is wrong."""
    rows = spark.read.parquet(log)
    return rows.withColumn("corrupt", ~F.coalesce(F.col("crc") == checksum(rows), F.lit(False))).drop("crc")


def export(files: DataFrame, path: str, format: str = "parquet") -> None:
    """Live records in any of Spark's formats."""
    files.write.mode("errorifexists").format(format).save(path)
