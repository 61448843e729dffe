"""Exact top-k inner products by columnar branch-and-bound.

Vectors are dealt into cells of bounded size and queries into blocks of bounded size; each pair of a
cell and a block is one group, so neither side is ever held whole. In a group the candidates lie
dimension by dimension (vertical layout). Inner products grow by blocks of dimensions; what the rest
can still add is at most the product of the remaining norms (the remaining mass). Candidates whose
upper bound is below the k-th greatest lower bound are dropped and the survivors compacted before
the next block of dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Candidates of a cell and queries of a block, on average.
CELL, BLOCK = 8192, 2048
#: Dimensions added at a time, and queries that share the first product.
DIMENSIONS, TOGETHER = 16, 32


def best(ids: np.ndarray, c: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of each query, itself left out.

    c: (dimensions, candidates), q: (queries, dimensions), whole numbers as float64 whose products
    are exact in it. Ties go to the smaller id.
    """
    dims = len(c)
    order = np.argsort(-np.abs(c).sum(1), kind="stable") if dims else np.arange(0)
    c, q = np.ascontiguousarray(c[order]), np.ascontiguousarray(q[:, order])
    cuts = list(range(0, dims, DIMENSIONS)) or [0]
    mass = lambda x: np.sqrt(x) * (1 + 1e-9)
    rest_c = [mass((c[min(dims, s + DIMENSIONS) :] ** 2).sum(0)) for s in cuts]
    rest_q = [mass((q[:, min(dims, s + DIMENSIONS) :] ** 2).sum(1)) for s in cuts]
    out = []
    for at in range(0, len(q), TOGETHER):
        first = q[at : at + TOGETHER, :DIMENSIONS] @ c[:DIMENSIONS] if dims else np.zeros((len(q[at : at + TOGETHER]), len(ids)))
        for i, part in enumerate(first, at):
            alive = np.flatnonzero(ids != query_ids[i])
            part = part[alive]
            for step, s in enumerate(cuts):
                if step:
                    part = part + q[i, s : s + DIMENSIONS] @ c[s : s + DIMENSIONS][:, alive]
                if len(alive) <= k:
                    continue
                spare = rest_c[step][alive] * rest_q[step][i] + 1e-6
                lower = np.partition(part - spare, len(part) - k)[len(part) - k]
                keep = part + spare >= lower
                alive, part = alive[keep], part[keep]
            top = np.lexsort((ids[alive], -part))[:k]
            out += [(int(query_ids[i]), int(ids[alive[t]]), int(part[t])) for t in top]
    return out


def best_of_big_numbers(ids, c, query_ids, q, k):
    """The same for numbers too large for float64, by Python's integers; scores stop at the range of a long."""
    out = []
    for qi, v in zip(query_ids.tolist(), q, strict=True):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, x, strict=True)), i) for i, x in zip(ids.tolist(), c.T, strict=True) if i != qi)
        out += [(qi, i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scored[:k]]
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(256 x) of a group's vectors, once for each id, with the least vector of a repeated one."""
    least: dict[int, list] = {}
    for i, v in zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist(), strict=True):
        if i not in least or v < least[i]:
            least[i] = v
    return np.array(list(least), np.int64), [np.floor(256 * np.array(v, np.float64)) for v in least.values()]


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of floor(256 x).

    Queries: rows whose id is divisible by `every`; candidates: all rows with another id. Fewer than
    k candidates: all of them. Ties go to the smaller id. Null ids and vectors that are null or hold
    a null or non-finite component take no part; rows that repeat an id count once, with the least of
    their vectors; vectors of unequal length have no score; other columns are ignored; an empty table
    gives an empty result.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    n = vectors.count()
    cells, blocks = max(1, -(-n // CELL)), max(1, -(-n // (every * BLOCK)))
    cell, block = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = v.withColumn("cell", cell).withColumn("block", each(blocks))
    queries = v.where(F.col("vec_id") % every == 0).withColumn("block", block).withColumn("cell", each(cells))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, c = _matrix(left)
        query_ids, q = _matrix(right)
        out = []
        for dims in {len(x) for x in q}:
            mine, asked = np.array([len(x) == dims for x in c], bool), np.array([len(x) == dims for x in q], bool)
            if not mine.any():
                continue
            cm, qm = (np.array([x for x in v if len(x) == dims]).reshape(n, dims) for v, n in ((c, mine.sum()), (q, asked.sum())))
            cm = cm.T
            small = not dims or np.abs(cm).max() * np.abs(qm).max() * dims < 2**52
            out += (best if small else best_of_big_numbers)(ids[mine], cm, query_ids[asked], qm, k)
        return pa.Table.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], schema=schema)

    found = candidates.groupBy("cell", "block").cogroup(queries.groupBy("cell", "block")).applyInArrow(group, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each query; vectors that are null or hold null or non-finite numbers take no part."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
