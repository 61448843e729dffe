"""Shared helpers of the corpus operators: session settings, Arrow mapping, shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def shingles(tokens: list[str], n: int) -> list[str]:
    """Space-joined n-word shingles with repeats; a shorter text is one shingle, no words give none."""
    if not tokens:
        return []
    if len(tokens) <= n:
        return [" ".join(tokens)]
    return list(map(" ".join, zip(*(tokens[i:] for i in range(n)), strict=False)))


def id_crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def fold_of(column: str, modulus: int):
    """crc32 of the decimal id, modulo modulus."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors of a cluster share.

    A local session without the setting, as in tests, gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "local", None)
        if base is None:
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="trawl-shared-")
    return f"{base.rstrip('/')}/trawl-{uuid.uuid4().hex}"


def saved(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict = {}
_asked: set = set()


def kept(key, make):
    """make(), remembered in this worker process under the key as long as its tasks ask for it as they start."""
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def started(start):
    """start() of a task. What it asks for is kept; what earlier tasks of other operators kept is let go."""
    _asked.clear()
    work = start()
    for key in [*_kept]:
        if key not in _asked:
            del _kept[key]
    return work


def map_arrow(df: DataFrame, schema: str, start, rows: int = 512) -> DataFrame:
    """Runs start() once a task; the function it gives turns a list of rows (tuples) into rows.

    Batches are cut into slices of a bounded number of rows, so that long texts do not pile up.
    """
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = started(start)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                if not out:
                    continue
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema
                )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, size: int):
    """Cuts of the batch in which a column of strings holds about `size` bytes; at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Rows that may go to all executors at once: of a few hundred bytes, and of two or three integers.
BROADCAST_ROWS, BROADCAST_KEYS = 1 << 17, 1 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """For one side of a join: a hint to broadcast df, a saved table, if it has few rows; else df, for a join by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows: those whose key has the smallest hashes.

    The bound is found on the key column alone, so no other column is read or moved for the ranking.
    """
    h = F.xxhash64(F.col(key))
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)).limit(n) if last is not None else df.limit(0)


def filter_arrow(df: DataFrame, column: str, start) -> DataFrame:
    """Rows of df, all columns kept, for which start()'s function of a list of the column's values is true."""

    def run(batches):
        work = started(start)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(work(part.column(part.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
