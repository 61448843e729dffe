"""Change feeds as Structured Streaming: each micro-batch becomes one commit of deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import content
from ..operators.indexes import TrigramIndex
from ..operators.mutations import delta
from ..sources import storage
from ..sources.store import NO_EVENT, Conflict, Store


def started(changes: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str, name: str | None) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return (writer.queryName(name) if name else writer).start()


def last_event(batch: DataFrame) -> int:
    last = batch.agg({"seq": "max"}).first()[0]
    return NO_EVENT if last is None else last


def merge_stream(changes: DataFrame, base: str, checkpoint: str, *, once: bool = True, every: str = "300 milliseconds", name: str | None = None, compact_share: float = 0.25) -> StreamingQuery:
    """Merges a streaming DataFrame of changes into the snapshot at base, where one must be.

    A micro-batch writes its own changes only, and one that runs again after a failure finds its number in
    the metadata and changes nothing. Many deltas are folded into one, and the catalog is rewritten when they
    come to compact_share of it.
    Other writers, compactions among them, may commit between two micro-batches; all metadata stays, and
    the last event never goes back.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, base)
        batch = batch.persist()
        try:
            store.change({storage.FILES: delta(batch)}, last_event=last_event(batch), once=(f"stream {checkpoint}", number))
        finally:
            batch.unpersist()
        storage.maintain(store, share=compact_share)

    return started(changes, merge, checkpoint, once, every, name)


def with_followers(store: Store, changes: DataFrame, read_contents: Callable[[DataFrame], DataFrame] | None, extensions: set[str], names: str = "names", once: tuple[str, int] | None = None):
    """One batch of changes for the files and all that is kept about them, committed together.

    The files' trigram index follows if the store has one, and so do the contents if read_contents is given:
    it turns rows of the catalog into path_key, content, mod_time of those it can read. Contents of files
    that are gone, are not among the extensions any more, or cannot be read, go. What another writer commits
    meanwhile makes the batch look again; a batch that is in the store already does nothing.
    """
    while True:
        head = store.head()
        if once is not None and store.seen(head, *once):
            return head
        files = store.stage(delta(changes), storage.FILES)
        live, gone = files.df.where("not gone"), files.df.where("gone")
        deltas = {storage.FILES: files}
        if f"{names}_postings" in head.tables:
            deltas |= TrigramIndex.changed(store, names, live, gone, "match_path")
        if read_contents is not None:
            documents = read_contents(content.eligible(live, extensions)).persist()
            try:
                without = files.df.select("path_key").join(documents.where("content is not null").select("path_key"), "path_key", "left_anti")
                deltas |= content.ContentIndex(store, head.version).deltas(documents, without)
                deltas = {name: store.stage(df, name) for name, df in deltas.items()}
            finally:
                documents.unpersist()
        try:
            return store.change(deltas, last_event=last_event(changes), once=once, read=head.version)
        except Conflict:
            continue


def follow_stream(
    changes: DataFrame, base: str, checkpoint: str, read_contents: Callable[[DataFrame], DataFrame] | None, extensions: set[str], *, once: bool = True, every: str = "300 milliseconds", name: str | None = None, compact_share: float = 0.25
) -> StreamingQuery:
    """As merge_stream, for a store that keeps indexes and contents beside the files: each micro-batch is one commit of all."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            with_followers(Store(batch.sparkSession, base), batch, read_contents, extensions, once=(f"stream {checkpoint}", number))
        finally:
            batch.unpersist()
        storage.maintain(Store(batch.sparkSession, base), compact_share)

    return started(changes, merge, checkpoint, once, every, name)


#: Why a feed cannot be followed on.
GAP, RESET = "gap", "reset"


def broken(batch: DataFrame, last: int) -> str | None:
    """GAP if events between the last one and the batch's greatest are missing, RESET if their numbers began anew, None if the feed goes on.

    Events that came again, all at or before the last one but not from the start, break nothing.
    """
    row = batch.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct(F.when(F.col("seq") > last, F.col("seq"))).alias("new")).first()
    if row["hi"] is None or last == NO_EVENT:  # a feed may begin anywhere; from then on it has no holes
        return None if row["hi"] is None or row["hi"] - row["lo"] + 1 == row["new"] else GAP
    if row["hi"] <= last:
        return RESET if row["lo"] == 0 and last > 0 else None
    return None if row["hi"] - last == row["new"] else GAP


def guarded_stream(changes: DataFrame, base: str, checkpoint: str, rescan: Callable[[], DataFrame], *, once: bool = True, every: str = "300 milliseconds", name: str | None = None) -> StreamingQuery:
    """As merge_stream, for a feed that can lose events: seq counts them without holes.

    Where events are missing or their numbers begin anew, the batch is not trusted: rescan gives all files
    as they are now, which become the snapshot, and the feed goes on from the batch's last event. The
    reason is kept in the metadata (rescanned).
    """
    key = f"stream {checkpoint}"

    def merge(batch: DataFrame, number: int) -> None:
        store, batch = Store(batch.sparkSession, base), batch.persist()
        try:
            while True:
                head = store.head()
                if store.seen(head, key, number):
                    return
                why, last = broken(batch, head.last_event), last_event(batch)
                try:
                    if why is None:
                        store.change({storage.FILES: delta(batch)}, last_event=last, once=(key, number), read=head.version)
                    else:
                        files = rescan().sortWithinPartitions("path")
                        store.replace({storage.FILES: (files, storage.KEY)}, read=head.version, last_event=last, extra={key: str(number), "rescanned": why}, restart=why == RESET)
                    return
                except Conflict:
                    continue
        finally:
            batch.unpersist()

    return started(changes, merge, checkpoint, once, every, name)


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A change feed from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
