"""A Spark data source that scans directory trees.

    spark.dataSource.register(DirectorySource)
    spark.read.format("directories").option("skip_hidden", "true").load("/some/root")

The directories below the root, to a given depth, are the partitions; each task walks its own. scan()
goes level by level instead: it walks each directory once, whatever paths lead to it, and keeps errors.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.catalog import BUNDLE, DIRECTORY, FILE, OTHER, SYMLINK

SCHEMA = "name string, path string, type int, size long, mod_time long, inode long, dev_id int"


def record(entry: os.DirEntry, info: os.stat_result, parent: str) -> tuple:
    """name, path, kind, size of regular files, seconds, inode, device of a directory entry."""
    mode = info.st_mode
    kind = SYMLINK if stat.S_ISLNK(mode) else DIRECTORY if stat.S_ISDIR(mode) else FILE if stat.S_ISREG(mode) else OTHER
    if kind == DIRECTORY and len(entry.name) > 4 and entry.name.lower().endswith(".app"):
        kind = BUNDLE
    device = info.st_dev & 0x7FFFFFFF
    return entry.name, parent, kind, info.st_size if kind == FILE else 0, int(info.st_mtime), info.st_ino, device


def _hidden(entry: os.DirEntry, info: os.stat_result) -> bool:
    return entry.name.startswith(".") or bool(getattr(info, "st_flags", 0) & getattr(stat, "UF_HIDDEN", 0x8000))


def list_directory(path: str, skip_hidden: bool, device: int, failed=lambda path, error: None):
    """Records of one directory; directories of another device are left out.

    What cannot be read is left out too, after failed was told of its path and the name of its error.
    """
    try:
        entries = sorted(os.scandir(path), key=lambda e: e.name)
    except OSError as e:
        failed(path, errno.errorcode.get(e.errno, "EIO"))
        return
    for entry in entries:
        if skip_hidden and entry.name.startswith("."):
            continue
        try:
            info = entry.stat(follow_symlinks=False)
        except OSError as e:
            failed(entry.path, errno.errorcode.get(e.errno, "EIO"))
            continue
        if skip_hidden and _hidden(entry, info):
            continue
        if stat.S_ISDIR(info.st_mode) and info.st_dev != device:
            continue
        yield record(entry, info, path)


@dataclass
class Subtree(InputPartition):
    path: str
    deep: bool  # with all below it, or its own entries alone


class DirectoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.skip_hidden = str(options.get("skip_hidden", "false")).lower() == "true"
        self.split_depth = int(options.get("split_depth", "2"))
        self.device = os.lstat(self.root).st_dev if os.path.isdir(self.root) else -1

    def partitions(self):
        if self.device < 0:
            return [Subtree(self.root, False)]
        out, level = [], [self.root]
        for _ in range(self.split_depth):
            below = []
            for d in level:
                out.append(Subtree(d, False))
                below += [os.path.join(d, r[0]) for r in list_directory(d, self.skip_hidden, self.device) if r[2] == DIRECTORY]
            level = below
        return out + [Subtree(d, True) for d in level]

    def read(self, partition):
        seen, todo = set(), [partition.path]
        while todo:
            here = todo.pop()
            for row in list_directory(here, self.skip_hidden, self.device):
                yield row
                # A directory reached twice, as by a hard link, is walked once; bundles are not entered.
                if partition.deep and row[2] == DIRECTORY and (row[6], row[5]) not in seen:
                    seen.add((row[6], row[5]))
                    todo.append(os.path.join(here, row[0]))


class DirectorySource(DataSource):
    @classmethod
    def name(cls):
        return "directories"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return DirectoryReader(self.options)


def mounted_volumes(root: str = "/Volumes") -> list[str]:
    """Mount points below a directory."""
    try:
        return sorted(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and os.path.ismount(e.path))
    except OSError:
        return []


@dataclass(frozen=True)
class Progress:
    """What a scan has come to after a level."""

    level: int
    directories: int
    records: int
    errors: int
    waiting: int  # directories of the next level


class Scan:
    """A finished or stopped scan: records (SCHEMA), errors (path, error), and whether it was stopped."""

    def __init__(self, rows: DataFrame, stopped: bool, progress: list[Progress]):
        self.records = rows.where("error is null").drop("error")
        self.errors = rows.where("error is not null").select("path", "error")
        self.stopped, self.progress = stopped, progress

    def kinds(self) -> DataFrame:
        """type, n and bytes of the records, and n of the errors by their name (type null)."""
        found = self.records.groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("error", F.lit(None).cast("string"))
        return found.unionByName(self.errors.groupBy("error").agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("type"), "n", F.lit(0).cast("long").alias("bytes"), "error"))


def scan(
    spark: SparkSession, root: str, work: str, *, skip_hidden: bool = False, report: Callable[[Progress], bool | None] = lambda p: None, lister: Callable = list_directory
) -> Scan:
    """Scans the tree at root, which all executors must see, level by level; levels are kept below work.

    A level's directories are dealt to the tasks evenly. Those found are the next level, unless a
    directory of their device and inode was met before: of several paths to one the first in order is
    taken. Bundles and directories of other devices are not entered. report hears of each level, and
    stops the scan by returning False. A root that is no directory gives one error.
    """
    schema = SCHEMA + ", error string"
    names = [c.split()[0] for c in schema.split(", ")]
    at = os.path.abspath(root)
    info = os.lstat(at) if os.path.exists(at) else None
    device = info.st_dev if info else -1
    level = spark.createDataFrame([(at, device & 0x7FFFFFFF, info.st_ino if info else 0)], "path string, dev_id int, inode long")
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column(0).to_pylist():
                failed = lambda p, e: rows.append((None, p, None, None, None, None, None, e))  # noqa: E731, B023
                rows += [(*r, None) for r in lister(path, skip_hidden, device, failed)]
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    said: list[Progress] = []
    records = errors = directories = 0
    waiting, met, stopped = 1, None, False
    while waiting and not stopped:
        n = len(said)
        level.write.parquet(f"{work}/level={n}/directories")
        level = spark.read.schema("path string, dev_id int, inode long").parquet(f"{work}/level={n}/directories")
        level.repartition(max(1, min(waiting, spark.sparkContext.defaultParallelism * 4))).select("path").mapInArrow(run, schema).write.parquet(f"{work}/level={n}/found")
        found = spark.read.schema(schema).parquet(f"{work}/level={n}/found")
        counts = found.agg(F.count("type").alias("records"), F.count("error").alias("errors")).first()
        seen = level.select("dev_id", "inode")
        met = seen if met is None else met.unionByName(seen)
        below = found.where(F.col("type") == DIRECTORY).select(F.when(F.col("path") == "/", F.concat(F.lit("/"), "name")).otherwise(F.concat_ws("/", "path", "name")).alias("path"), "dev_id", "inode")
        level = below.groupBy("dev_id", "inode").agg(F.min("path").alias("path")).join(met, ["dev_id", "inode"], "left_anti").select("path", "dev_id", "inode")
        directories, records, errors, waiting = directories + waiting, records + counts["records"], errors + counts["errors"], level.count()
        said.append(Progress(n, directories, records, errors, waiting))
        stopped = report(said[-1]) is False
    return Scan(spark.read.schema(schema).parquet(*(f"{work}/level={p.level}/found" for p in said)), stopped and waiting > 0, said)
