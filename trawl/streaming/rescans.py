"""Requests to scan directories again, gathered by keyed state with timers, and the scans they lead to.

A volume's requests wait until none came for a while (debounce); of a path and what lies below it only the
path is kept. A path that was scanned a short time ago (throttle) waits for the rest of it. Time is that of
the events, so a feed that is read again gives the same scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import derive
from ..operators.mutations import merge_rescans, throttled
from ..sources import storage
from ..sources.store import Conflict, Store
from .changes import started

#: Seconds that requests wait for more, and seconds between two scans of a path.
DEBOUNCE, THROTTLE = 5.0, 300.0
_STATE = "pending array<string>, due double, paths array<string>, times array<double>"
_OUT = "volume string, path string, at double"


@dataclass
class Waiting:
    """What a volume's requests have come to. All times are seconds."""

    debounce: float = DEBOUNCE
    throttle: float = THROTTLE
    pending: set[str] = field(default_factory=set)
    due: float | None = None
    last: dict[str, float] = field(default_factory=dict)

    def request(self, path: str, at: float) -> list[tuple[str, float]]:
        """Notes a request; gives the scans (path, time) that were due before it."""
        out = self.until(at)
        self.pending = merge_rescans(self.pending, [path])
        self.due = at + self.debounce
        return out

    def until(self, now: float) -> list[tuple[str, float]]:
        """The scans that are due by now."""
        out = []
        while self.due is not None and self.due <= now:
            at = self.due
            held = {p for p in self.pending if throttled(p, self.last, at, self.throttle)}
            out += [(p, at) for p in sorted(self.pending - held)]
            self.last = {p: t for p, t in self.last.items() if at - t <= 2 * self.throttle} | dict.fromkeys(self.pending - held, at)
            self.pending, self.due = held, at + self.throttle if held else None
        return out


def due_scans(requests: DataFrame, debounce: float = DEBOUNCE, throttle: float = THROTTLE, delay: str = "0 seconds") -> DataFrame:
    """volume, path, at (seconds) of the scans that requests (volume, path, ts) lead to; a streaming DataFrame.

    delay: how late a request may come; a later one counts as if it had come in time for the next scan.
    Null paths and times ask for nothing. A scan that is due is given when a later time is known, be it of
    another volume. The task of a volume holds its requests of one micro-batch, which the feed's size bounds.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = Waiting(debounce, throttle)
        if state.exists:
            pending, due, paths, times = state.get
            waiting.pending, waiting.due, waiting.last = set(pending), due, dict(zip(paths, times, strict=True))
        out = []
        if not state.hasTimedOut:
            rows = sorted((t, p) for c in chunks for p, t in zip(c["path"], c["seconds"], strict=True))
            for t, p in rows:
                out += waiting.request(p, t)
        mark = state.getCurrentWatermarkMs() / 1000
        out += waiting.until(mark)
        known = list(waiting.last.items())
        state.update((list(waiting.pending), waiting.due, [p for p, _ in known], [t for _, t in known]))
        forgotten = max([t for _, t in known], default=mark) + 2 * throttle
        if waiting.due is None and forgotten <= mark:
            state.remove()
        else:
            state.setTimeoutTimestamp(int(1000 * (forgotten if waiting.due is None else waiting.due)) + 1)
        yield pd.DataFrame({"volume": [key[0]] * len(out), "path": [p for p, _ in out], "at": [t for _, t in out]})

    rows = requests.where("path is not null and ts is not null").withWatermark("ts", delay)
    return rows.select("volume", "path", "ts", F.col("ts").cast("double").alias("seconds")).groupBy("volume").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rescanned(store: Store, roots: DataFrame, scan: Callable[[DataFrame], DataFrame], once: tuple[str, int] | None = None):
    """Commits what scan finds below roots (path): its records (name, path, type, size, mod_time), and all else below them gone."""
    while True:
        head = store.head()
        if once is not None and store.seen(head, *once):
            return head
        roots = roots.select("path").distinct()
        fresh = derive(scan(roots)).dropDuplicates(["path_key"])
        files = store.read(storage.FILES, head.version)
        # A record lies below a root if one of the paths above it, or its own, is the root.
        parts = F.split("path_key", "/")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        keys = roots.select(F.lower(F.when(F.col("path") == "/", F.lit("")).otherwise(F.regexp_replace("path", "/+$", ""))).alias("up"))
        below = files.select("path_key", F.explode(ups).alias("up")).join(keys, "up", "left_semi").select("path_key").distinct()
        gone = files.join(below, "path_key", "left_semi").join(fresh.select("path_key"), "path_key", "left_anti")
        delta = fresh.select(files.columns).withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
        try:
            return store.change({storage.FILES: delta}, once=once, read=head.version)
        except Conflict:
            continue


def rescan_stream(requests: DataFrame, base: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame], *, debounce: float = DEBOUNCE, throttle: float = THROTTLE, delay: str = "0 seconds", once: bool = True, every: str = "1 second", name: str | None = None) -> StreamingQuery:
    """Keeps the snapshot at base by scanning what requests ask for, when it is due. scan takes roots (path) and reads their files."""

    def merge(batch: DataFrame, number: int) -> None:
        roots = batch.select("path").persist()
        try:
            if not roots.isEmpty():
                rescanned(Store(batch.sparkSession, base), roots, scan, once=(f"stream {checkpoint}", number))
        finally:
            roots.unpersist()

    return started(due_scans(requests, debounce, throttle, delay), merge, checkpoint, once, every, name)


def mount_requests(before: DataFrame, now: DataFrame, ts) -> DataFrame:
    """Requests (volume, path, ts) for volumes (mount, online) that are online now and were not before."""
    was = before.where("online").select("mount")
    return now.where("online").join(was, "mount", "left_anti").select(F.col("mount").alias("volume"), F.col("mount").alias("path"), F.lit(ts).cast("timestamp").alias("ts"))
