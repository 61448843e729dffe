"""Tables of one folder that change together: Parquet bases and deltas, and commits that name them.

A commit is a small JSON file with the folders that make up each table. A reader takes one commit, so it
sees all tables of that moment. Writers write folders first, under names of their own, and then claim the
next commit's number; who comes second reads the new head, puts its deltas behind it and claims again.

A table has a key. A delta carries all present rows of the keys it touches, and rows marked gone for keys
that have none; reading takes each key from the last delta that touches it, else from the base. Without a
key, deltas only add. So a change costs its own size; compact() folds the deltas into a new base.

A base may hold lists of keys in the key's column; they are read as one row a key.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from dataclasses import replace as dataclass_replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Column of a delta: this row only says that its key has no rows.
GONE = "gone"
#: The last event of a store that has seen none; events count from 0.
NO_EVENT = -1
COMMIT = "version long, written_at double, last_event long, extra map<string,string>, offline array<string>"
#: Spark's setting that removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(session: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind: their plans do not run again. Of writers side by side the first sets it, and the others' files may stay longer."""
    mine = session.conf.get(CLEANUP, None) == "false"
    if mine:
        session.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if mine:
            session.conf.unset(CLEANUP)


class Conflict(RuntimeError):
    """Another writer replaced what this one had read."""


@dataclass(frozen=True)
class Table:
    """key: None for a table whose deltas only add. rows, changed: of the base, and of the deltas together.

    source: of a table that follows from another one, that one and what else it takes to make it.
    """

    key: str | None
    base: str
    deltas: list[str] = field(default_factory=list)
    rows: int = 0
    changed: int = 0
    source: list[str] | None = None


@dataclass(frozen=True)
class Staged:
    """A written folder that no commit names yet."""

    folder: str
    rows: int
    df: DataFrame
    source: list[str] | None = None


@dataclass(frozen=True)
class Commit:
    version: int
    written_at: float
    last_event: int = NO_EVENT
    extra: dict[str, str] = field(default_factory=dict)
    offline: list[str] = field(default_factory=list)
    tables: dict[str, Table] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- commits ----

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._hadoop(f"{self.path}/_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("c") and n.endswith(".json"))

    def commits(self) -> DataFrame:
        """One row a commit: version, written_at, last_event, extra, offline."""
        if not self.versions():
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/_commits")

    def at(self, version: int) -> Commit:
        p, fs = self._hadoop(f"{self.path}/_commits/c{version:012d}.json")
        stream = fs.open(p)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Commit(**found | {"tables": {name: Table(**t) for name, t in found["tables"].items()}})

    def head(self) -> Commit | None:
        known = self.versions()
        return self.at(known[-1]) if known else None

    def _claim(self, commit: Commit) -> bool:
        """Makes this the commit of its number, if there is none yet."""
        folder, fs = self._hadoop(f"{self.path}/_commits")
        fs.mkdirs(folder)
        held, _ = self._hadoop(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        final, _ = self._hadoop(f"{self.path}/_commits/c{commit.version:012d}.json")
        out = fs.create(held, False)
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
        out.close()
        if fs.getScheme() == "file":  # whose rename overwrites; a link does not
            try:
                os.link(held.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(held, False)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self.spark._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(held, final, options)  # fails where final exists
            return True
        except Exception:
            if not fs.exists(final):
                raise
            fs.delete(held, False)
            return False

    def _commit(self, make: Callable[[Commit | None], Commit | None]) -> Commit:
        """Claims what make says should follow the head, anew for each new head; None: nothing has to follow."""
        while True:
            head = self.head()
            new = make(head)
            if new is None:
                return head
            new = dataclass_replace(new, version=head.version + 1 if head else 0, written_at=time.time())
            if self._claim(new):
                return new

    # ---- writing ----

    def stage(self, df: DataFrame | Staged, name: str, block: int | None = None, key: str | None = None, source: list[str] | None = None) -> Staged:
        """Writes a folder of the table, for a commit to come. block: bytes of a row group, for tables that are looked up by a sorted column. key: what may hold lists."""
        if isinstance(df, Staged):
            return df
        folder = f"{name}/{uuid.uuid4().hex}"
        writer = df.write.mode("error").option("compression", "zstd")
        if block:
            writer = writer.option("parquet.block.size", block).option("parquet.dictionary.page.size", block)
        with short_shuffles(df.sparkSession):
            writer.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        if key is not None and self._lists(written, key):
            rows = written.agg(F.coalesce(F.sum(F.size(key)), F.lit(0))).first()[0]
        else:
            rows = written.count()  # by the footers
        return Staged(folder, rows, written, source)

    @staticmethod
    def _lists(df: DataFrame, key: str) -> bool:
        return isinstance(df.schema[key].dataType, ArrayType)

    def replace(self, tables: dict[str, tuple[DataFrame | Staged, str | None]], *, read: int | None = None, last_event: int = NO_EVENT, extra: dict | None = None, offline: list[str] | None = None, restart: bool = False) -> Commit:
        """New bases (rows, key) for some tables; others stay. read: the version the rows were made from.

        Without read the tables are replaced whatever the head is; with it, a head that is another raises
        Conflict, as its changes would be lost. extra is added to what the head has, offline replaces it
        unless None, and last_event never goes back, unless events are counted anew from here (restart).
        """
        new = {}
        for name, (df, key) in tables.items():
            staged = self.stage(df, name)
            new[name] = Table(key, staged.folder, rows=staged.rows, source=staged.source)

        def make(head: Commit | None) -> Commit:
            if read is not None and (head is None or head.version != read):
                raise Conflict(f"version {read} was read, and {head and head.version} is there")
            after = self._after(head, {**(head.tables if head else {}), **new}, last_event, extra, offline)
            return dataclass_replace(after, last_event=last_event) if restart else after

        return self._commit(make)

    def _after(self, head: Commit | None, tables: dict[str, Table], last_event: int, extra: dict | None, offline: list[str] | None) -> Commit:
        old = head or Commit(0, 0.0)
        return Commit(0, 0.0, max(old.last_event, last_event), old.extra | (extra or {}), old.offline if offline is None else offline, tables)

    def change(self, deltas: dict[str, DataFrame | Staged], *, last_event: int = NO_EVENT, extra: dict | None = None, once: tuple[str, int] | None = None, read: int | None = None) -> Commit:
        """Adds a delta (the table's columns and, if it has a key, gone) to each table, all in one commit.

        Deltas that were made from a version's rows name it as read: if another is there by then, Conflict is
        raised and they have to be made again. Those that follow from the change alone need not.

        once: a writer's name and the number of its change. A change that is in the store already, or an
        earlier one, does nothing, so a repeated micro-batch does no harm.
        """
        done = lambda head: once is not None and self.seen(head, *once)
        head = self.head()
        if head is None:
            raise FileNotFoundError(f"no tables in {self.path}")
        if done(head):
            return head
        written = {name: self.stage(df, name) for name, df in deltas.items()}

        def make(head: Commit) -> Commit | None:
            if done(head):
                return None
            if read is not None and head.version != read:
                raise Conflict(f"version {read} was read, and {head.version} is there")
            tables = dict(head.tables)
            for name, new in written.items():
                if new.rows:
                    t = tables[name]
                    tables[name] = dataclass_replace(t, deltas=[*t.deltas, new.folder], changed=t.changed + new.rows)
            return self._after(head, tables, last_event, (extra or {}) | ({once[0]: str(once[1])} if once else {}), None)

        return self._commit(make)

    @staticmethod
    def seen(head: Commit, writer: str, number: int) -> bool:
        """Whether a writer's change of this number is in the store."""
        return int(head.extra.get(writer, -1)) >= number

    def compact(self, name: str, arrange: Callable[[DataFrame], DataFrame] = lambda df: df, *, by: str | None = None, block: int | None = None, last_event: int = NO_EVENT) -> Commit:
        """Folds a table's deltas into a new base. Deltas that others add meanwhile stay behind it.

        arrange may sort the rows, and merge in what was logged up to last_event. by: a column that follows
        from the key; the new base is sorted by it.
        """
        head = self.head()
        old = head.tables[name]
        new = self.stage(arrange(self._sorted(old, by) if by else self._read(old)), name, block, old.key)

        def make(now: Commit) -> Commit:
            t = now.tables[name]
            if t.base != old.base or t.deltas[: len(old.deltas)] != old.deltas:
                raise Conflict(f"{name} was replaced while it was compacted")
            return self._after(now, now.tables | {name: Table(t.key, new.folder, t.deltas[len(old.deltas) :], new.rows, t.changed - old.changed, t.source)}, last_event, None, None)

        return self._commit(make)

    def fold(self, name: str, *, block: int | None = None) -> Commit:
        """Folds a table's deltas into one, at the cost of their size; the base stays."""
        old = self.head().tables[name]
        if len(old.deltas) < 2:
            return self.head()
        every, last = self._deltas(old)
        rows = every if last is None else every.join(last, [old.key, "_order"], "left_semi").drop("_order")
        new = self.stage(rows, name, block)

        def make(now: Commit) -> Commit:
            t = now.tables[name]
            if t.base != old.base or t.deltas[: len(old.deltas)] != old.deltas:
                raise Conflict(f"{name} was replaced while its deltas were folded")
            return self._after(now, now.tables | {name: dataclass_replace(t, deltas=[new.folder, *t.deltas[len(old.deltas) :]], changed=t.changed - old.changed + new.rows)}, NO_EVENT, None, None)

        return self._commit(make)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that earlier commits name and the last `keep` do not, with those commits. Folders that no commit names yet belong to writers at work."""
        known = self.versions()
        if len(known) <= keep:
            return 0
        folders = lambda vs: {f for v in vs for t in self.at(v).tables.values() for f in (t.base, *t.deltas)}
        old = folders(known[:-keep]) - folders(known[-keep:])
        for f in [*old, *(f"_commits/c{v:012d}.json" for v in known[:-keep])]:
            p, fs = self._hadoop(f"{self.path}/{f}")
            fs.delete(p, True)
        return len(old)

    # ---- reading ----

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the head, or of an earlier version."""
        commit = self.head() if version is None else self.at(version)
        if commit is None or name not in commit.tables:
            raise FileNotFoundError(f"no {name} in {self.path}")
        return self._read(commit.tables[name])

    def _deltas(self, t: Table) -> tuple[DataFrame, DataFrame | None]:
        """All rows of the deltas, and for a table with a key the number (_order) of the last delta that touches each key."""
        parts = [self.spark.read.parquet(f"{self.path}/{d}") for d in t.deltas]
        if t.key is None:
            return reduce(DataFrame.unionByName, parts), None
        every = reduce(DataFrame.unionByName, [p.withColumn("_order", F.lit(i)) for i, p in enumerate(parts)])
        return every, every.groupBy(t.key).agg(F.max("_order").alias("_order"))

    def _read(self, t: Table) -> DataFrame:
        base = self.spark.read.parquet(f"{self.path}/{t.base}")
        if t.key is not None and self._lists(base, t.key):
            base = base.withColumn(t.key, F.explode(t.key))
        if not t.deltas:
            return base
        every, last = self._deltas(t)
        if last is None:
            return base.unionByName(every)
        # Keys are few beside the base; Spark broadcasts them if their files are small, and shuffles both otherwise.
        fresh = every.where(~F.col(GONE))
        if len(t.deltas) > 1:
            fresh = fresh.join(last, [t.key, "_order"], "left_semi")
        return base.join(last.select(t.key), t.key, "left_anti").select(base.columns).unionByName(fresh.select(base.columns))

    def _sorted(self, t: Table, by: str) -> DataFrame:
        """As _read, sorted by a column that follows from the key. One shuffle brings a key's rows together and sorts them."""
        rows = self.spark.read.parquet(f"{self.path}/{t.base}")
        columns = rows.columns
        rows = rows.withColumns({GONE: F.lit(False), "_order": F.lit(-1)})
        if t.deltas:
            rows = rows.unionByName(self._deltas(t)[0].select(rows.columns))
        last = F.rank().over(Window.partitionBy(by, t.key).orderBy(F.desc("_order")))
        return rows.repartitionByRange(by).withColumn("_last", last).where(f"_last = 1 and not {GONE}").select(columns)
