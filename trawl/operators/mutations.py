"""Batches of changes to a catalog: additions, removals, renames, and whole subtrees.

Changes carry op (ADD, UPDATE, REMOVE), full_path, the new record's columns, and seq. An UPDATE drops
the record at full_path and adds its own, which may lie elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import BASE, derive, last_wins


def _steps(changes: DataFrame) -> DataFrame:
    """path_key, seq, step, gone, record: removals first, then additions, of each change."""
    record = F.struct(*BASE)
    new_key = F.lower(T.full_path(F.col("path"), F.col("name")))
    removal = F.struct(F.lower("full_path").alias("path_key"), F.lit(0).alias("step"), F.lit(True).alias("gone"), record.alias("record"))
    addition = F.struct(new_key.alias("path_key"), F.lit(1).alias("step"), F.lit(False).alias("gone"), record.alias("record"))
    steps = F.when(F.col("op") == "ADD", F.array(addition)).when(F.col("op") == "UPDATE", F.array(removal, addition)).when(F.col("op") == "REMOVE", F.array(removal))
    return changes.select("seq", F.explode(steps).alias("s")).select("s.path_key", "seq", "s.step", "s.gone", "s.record")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog after a batch, in order of seq. Removing what is not there does nothing.

    One shuffle by path_key: a key's last step decides, and the rows at hand come before all changes.
    """
    old = files.select("path_key", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("step"), F.lit(False).alias("gone"), F.struct(*BASE).alias("record"))
    both = old.unionByName(_steps(_complete(changes)))
    order = F.struct(F.col("seq").isNotNull().alias("new"), "seq", "step")
    last = both.groupBy("path_key").agg(F.max_by(F.struct("gone", "record"), order).alias("r")).where("not r.gone")
    return derive(last.select("r.record.*"))


def delta(changes: DataFrame) -> DataFrame:
    """A batch as the present rows of the paths it touches: the catalog's columns, and gone for those removed.

    What each path comes to does not depend on the catalog, so the batch alone is shuffled.
    """
    last = _steps(_complete(changes)).groupBy("path_key").agg(F.max_by(F.struct("gone", "record"), F.struct("seq", "step")).alias("r"))
    rows = derive(last.select("path_key", "r.gone", "r.record.*").withColumnRenamed("path_key", "_key"))
    # A removed path has no record of its own to derive the key from.
    return rows.withColumn("path_key", F.col("_key")).drop("_key")


def _complete(changes: DataFrame) -> DataFrame:
    missing = {c: F.lit(0) for c in ("inode", "dev_id") if c not in changes.columns}
    out = changes.withColumns(missing)
    return out.withColumns({"type": F.col("type").cast("int"), "size": F.col("size").cast("long"), "mod_time": F.col("mod_time").cast("long"), "inode": F.col("inode").cast("long"), "dev_id": F.col("dev_id").cast("int"), "seq": F.col("seq").cast("long")})


def replay(log: DataFrame) -> DataFrame:
    """The longest part of a change log without a gap: rows before its first corrupt one (column corrupt)."""
    bad = log.where("corrupt").agg(F.min("seq")).first()[0]
    return (log if bad is None else log.where(F.col("seq") < bad)).drop("corrupt")


def remove_subtree(files: DataFrame, prefix: str) -> DataFrame:
    """Without the record at prefix and all below it, in any case of letters."""
    return files.where(~T.under(F.col("path_key"), prefix.lower()))


def replace_subtree(files: DataFrame, prefix: str, fresh: DataFrame) -> DataFrame:
    """The subtree at prefix as a fresh scan found it; of repeated paths the last (by seq) counts."""
    new = derive(fresh)
    new = last_wins(new) if "seq" in new.columns else new.dropDuplicates(["path_key"])
    return remove_subtree(files, prefix).unionByName(new.select(files.columns))


def dirty_share(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Records, changed keys and their share: what maintenance decides on."""
    keys = _steps(_complete(changes)).select("path_key").distinct()
    both = files.select(F.lit(1).alias("live"), F.lit(0).alias("dirty")).unionByName(keys.select(F.lit(0).alias("live"), F.lit(1).alias("dirty")))
    sums = both.agg(F.coalesce(F.sum("live"), F.lit(0)).alias("live"), F.coalesce(F.sum("dirty"), F.lit(0)).alias("dirty"))
    return sums.withColumn("share", F.col("dirty") / F.greatest("live", F.lit(1)))


# ---- file system events ----

#: Text in a path that marks the system's own files.
NOISE = ("/.Spotlight-V100/", "/.fseventsd/", "/.Trashes/")


def inside_bundle(path: Column) -> Column:
    return path.rlike(r"[^/]\.app/")


def changes_of_events(events: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Changes from events: path, removed, renamed, exists, is_dir, is_symlink, size, mod_time, seq.

    What was removed, or renamed and is gone, is a REMOVE; what exists is an UPDATE with its present
    record; anything else, noise, and what lies inside an application bundle is dropped. Excluded
    prefixes are compared as plain text.
    """
    c = F.col
    path = c("path")
    quiet = T.all_of([~F.contains(path, F.lit(n)) for n in NOISE] + [~path.startswith(e) for e in exclude])
    quiet &= ~(path.startswith("/private/var/folders/") & F.contains(path, F.lit("/com.apple."))) & ~inside_bundle(path)
    op = F.when(c("removed") | (c("renamed") & ~c("exists")), "REMOVE").when(c("exists"), "UPDATE")
    bundle = c("is_dir") & path.endswith(".app")
    kind = F.when(c("is_symlink"), 3).when(bundle, 5).when(c("is_dir"), 2).otherwise(1)
    return events.where(quiet).withColumn("op", op).where(c("op").isNotNull()).select(
        "op", path.alias("full_path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), T.parent_of(path).alias("path"),
        kind.alias("type"), F.when(kind == 1, c("size")).otherwise(0).alias("size"), "mod_time", "seq",
    )


# ---- rescans and maintenance: decisions on small driver-side values ----


def subsumed(child: str, parent: str) -> bool:
    return parent == "/" or child == parent or child.startswith(parent.rstrip("/") + "/")


def merge_rescans(pending: set[str], new: list[str]) -> set[str]:
    """Paths to rescan, none below another."""
    out: set[str] = set()
    top = None
    for slashed, p in sorted((p.rstrip("/") + "/", p) for p in pending | set(new)):  # what lies below a path follows it at once
        if top is None or not slashed.startswith(top):
            out.add(p)
            top = slashed
    return out


def throttled(path: str, last: dict[str, float], now: float, interval: float = 300.0) -> bool:
    """The path was rescanned less than interval seconds ago."""
    return path in last and now - last[path] < interval


def flush_interval(dirty: float, log_bytes: int, log_limit: int = 2 << 20) -> float:
    """Seconds to the next flush: the more is dirty, the sooner; a long log flushes soon whatever else."""
    seconds = next((s for share, s in ((0.3, 30.0), (0.1, 150.0), (0.01, 300.0)) if dirty > share), 600.0)
    return min(seconds, 30.0) if log_bytes > log_limit else seconds


def should_compact(live: int, dead: int, share: float = 0.25) -> bool:
    return dead > share * max(1, live + dead)
