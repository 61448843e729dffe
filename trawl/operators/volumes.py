"""Mounted volumes: registry, and which records lie on one that is offline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Volumes compared as conditions of one expression; more are joined by the prefixes of paths.
FEW = 64


def flag_offline(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds is_offline: the longest mount that holds the path is offline. Without a mount a record is online.

    Offline records stay searchable. A slash at the end of a mount does not count; a null mount holds nothing.
    """
    mount = F.lower(F.rtrim(F.col("mount"), F.lit("/")))
    v = volumes.select(F.when(mount == "", "/").otherwise(mount).alias("mount"), "online").where("mount is not null").groupBy("mount").agg(F.min("online").alias("online"))
    few = v.limit(FEW + 1).collect()
    if len(few) <= FEW:
        ordered = sorted(few, key=lambda r: -len(r["mount"]))
        cases = [(T.under(F.col("path_key"), r["mount"]), not r["online"]) for r in ordered]
        offline = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit(False))
        return files.withColumn("is_offline", offline)
    parts = F.split("path_key", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("path_key", F.explode(F.transform(prefixes, lambda p: F.when(p == "", "/").otherwise(p))).alias("mount"))
    top = up.join(v, "mount").groupBy("path_key").agg(F.max_by("online", F.length("mount")).alias("online"))
    return files.join(top, "path_key", "left").withColumn("is_offline", ~F.coalesce("online", F.lit(True))).drop("online")


def update(volumes: DataFrame, events: DataFrame) -> DataFrame:
    """The registry after events (mount, event in MOUNT, UNMOUNT, FORGET, seq): the last of a mount decides."""
    old = volumes.select("mount", "online", F.lit(False).alias("gone"), F.lit(-1).cast("long").alias("seq"))
    new = events.select("mount", (F.col("event") == "MOUNT").alias("online"), (F.col("event") == "FORGET").alias("gone"), F.col("seq").cast("long").alias("seq"))
    last = old.unionByName(new).groupBy("mount").agg(F.max_by(F.struct("online", "gone"), "seq").alias("r"))
    return last.where("not r.gone").select("mount", F.col("r.online").alias("online"))


def reconcile(volumes: DataFrame, mounted: DataFrame) -> DataFrame:
    """At startup: what is mounted is online, what is registered and not mounted is offline."""
    here = mounted.select("mount", F.lit(True).alias("here")).distinct()
    return volumes.select("mount").distinct().join(here, "mount", "full").select("mount", F.coalesce("here", F.lit(False)).alias("online"))
