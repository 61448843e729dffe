"""A file catalog, changes and volumes derived from the benchmark tables, for the registered queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators.catalog import derive, last_wins

#: The moment that relative dates refer to.
NOW = datetime(2024, 1, 31, 12, tzinfo=UTC)
VOLUMES = [("/data/src0", False), ("/data", True), ("/Archive", False)]
_SUFFIXES = [".txt", ".md", ".cpp", ".py", ".JSON", ".h", ".tar.gz", ""]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Epoch seconds of a wall-clock timestamp, whatever the session's time zone."""
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")


def _document_name() -> Column:
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), suffix)


def _document_path() -> Column:
    return F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("lang"))


def _document_time() -> Column:
    return F.lit(1700000000) + F.col("doc_id") * 7919 % 10000000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, path, type, size, mod_time, seq of all sources, repeated paths included."""
    c, lit = F.col, F.lit

    def rows(df: DataFrame, name, path, kind, size, time, seq) -> DataFrame:
        return df.select(name.alias("name"), path.alias("path"), kind.cast("int").alias("type"), size.cast("long").alias("size"), time.cast("long").alias("mod_time"), seq.cast("long").alias("seq"))

    docs = rows(read(spark, sf_dir, "documents"), _document_name(), _document_path(), lit(1), c("n_chars"), _document_time(), lit(1_000_000_000) + c("doc_id"))
    orders = rows(
        read(spark, sf_dir, "orders"),
        F.concat(lit("order_"), c("o_orderkey").cast("string"), lit("_"), F.replace(c("o_orderpriority"), lit(" "), lit("-")), lit(".pdf")),
        F.concat(lit("/Archive/"), F.year("o_orderdate").cast("string"), lit("/"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")),
        lit(1), F.floor("o_totalprice"), seconds("o_orderdate"), lit(2_000_000_000) + c("o_orderkey"),
    )
    kind = F.element_at(F.array(*map(lit, (1, 1, 3, 4, 5))), (c("p_partkey") % 5 + 1).cast("int"))
    parts = rows(
        read(spark, sf_dir, "part"),
        F.concat(c("p_name"), lit("_"), c("p_partkey").cast("string"), F.when(c("p_partkey") % 5 == 4, ".app").otherwise("")),
        F.concat(lit("/catalog/"), c("p_brand"), lit("/"), c("p_type")),
        kind, c("p_size") * 1024, lit(1710000000), lit(3_000_000_000) + c("p_partkey"),
    )
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "^[a-z]+://", "/web/")
    pages = rows(read(spark, sf_dir, "pages").withColumn("u", url), F.regexp_extract("u", "([^/]+)$", 1), F.regexp_replace("u", "/[^/]+$", ""), lit(1), F.octet_length("html"), lit(1715000000), lit(4_000_000_000) + c("page_id"))
    return docs.unionByName(orders).unionByName(parts).unionByName(pages)


def directories(rows: DataFrame) -> DataFrame:
    """A record for every directory above the given ones."""
    parts = F.split("path", "/")
    up = rows.select("path").distinct().select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("full"))
    one = up.groupBy(F.lower("full").alias("key")).agg(F.max("full").alias("full"))
    return one.select(
        F.regexp_extract("full", "([^/]+)$", 1).alias("name"), T.parent_of(F.col("full")).alias("path"),
        F.lit(2).alias("type"), F.lit(0).cast("long").alias("size"), F.lit(1700000000).cast("long").alias("mod_time"), F.lit(5_000_000_000).cast("long").alias("seq"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    every = rows.unionByName(directories(rows))
    # The last row of each path is taken before columns are derived, so the shuffle does not carry those.
    key = F.lower(T.full_path(F.coalesce("path", F.lit("")), F.coalesce("name", F.lit(""))))
    return derive(last_wins(every.withColumn("path_key", key)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_key, content, mod_time of the documents."""
    full = T.full_path(_document_path(), _document_name())
    return read(spark, sf_dir, "documents").select(F.lower(full).alias("path_key"), F.col("text").alias("content"), _document_time().alias("mod_time"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op, full_path, the new record and seq from the events table."""
    c = F.col
    op = F.when(c("event_type") == "signup", "ADD").when(c("event_type") == "error", "REMOVE").otherwise("UPDATE")
    name, path = F.concat(F.lit("f"), (c("event_id") % 7).cast("string"), F.lit(".log")), F.concat(F.lit("/live/u"), c("user_id").cast("string"))
    e = read(spark, sf_dir, "events").select("event_id", op.alias("op"), name.alias("name"), path.alias("path"), F.floor(c("value") * 100).cast("long").alias("size"), seconds("ts").alias("mod_time"))
    return e.select("op", T.full_path(c("path"), c("name")).alias("full_path"), "name", "path", F.lit(1).alias("type"), "size", "mod_time", c("event_id").alias("seq"))


def volumes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOLUMES, "mount string, online boolean")


#: The same files as SQL: the relation `files` for all oracles.
FILES_SQL = r"""
WITH records AS (
  SELECT 'Doc_' || doc_id || ['.txt', '.md', '.cpp', '.py', '.JSON', '.h', '.tar.gz', ''][doc_id % 8 + 1] AS name,
    '/data/' || source || '/' || lang AS path, 1 AS type, n_chars AS size, 1700000000 + doc_id * 7919 % 10000000 AS mod_time, 1000000000 + doc_id AS seq
  FROM documents
  UNION ALL
  SELECT 'order_' || o_orderkey || '_' || replace(o_orderpriority, ' ', '-') || '.pdf', '/Archive/' || strftime(o_orderdate, '%Y/%m'),
    1, CAST(floor(o_totalprice) AS BIGINT), CAST(floor(epoch(o_orderdate)) AS BIGINT), 2000000000 + o_orderkey
  FROM orders
  UNION ALL
  SELECT p_name || '_' || p_partkey || CASE WHEN p_partkey % 5 = 4 THEN '.app' ELSE '' END, '/catalog/' || p_brand || '/' || p_type,
    [1, 1, 3, 4, 5][p_partkey % 5 + 1], p_size * 1024, 1710000000, 3000000000 + p_partkey
  FROM part
  UNION ALL
  SELECT regexp_extract(u, '([^/]+)$', 1), regexp_replace(u, '/[^/]+$', ''), 1, strlen(html), 1715000000, 4000000000 + page_id
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-z]+://', '/web/') AS u FROM pages)
), ups AS (
  SELECT array_to_string(parts[1:n], '/') AS "full" FROM (
    SELECT parts, unnest(range(2, len(parts) + 1)) AS n FROM (SELECT string_split(path, '/') AS parts FROM (SELECT DISTINCT path FROM records)))
), directories AS (
  SELECT regexp_extract("full", '([^/]+)$', 1) AS name, CASE WHEN regexp_replace("full", '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace("full", '/[^/]*$', '') END AS path,
    2 AS type, 0 AS size, 1700000000 AS mod_time, 5000000000 AS seq
  FROM (SELECT max("full") AS "full" FROM ups GROUP BY lower("full"))
), keyed AS (
  SELECT *, CASE WHEN path = '' OR path LIKE '%/' THEN path || name ELSE path || '/' || name END AS full_path
  FROM (SELECT * FROM records UNION ALL SELECT * FROM directories)
), files AS (
  SELECT name, path, CAST(type AS INTEGER) AS type, CAST(size AS BIGINT) AS size, CAST(mod_time AS BIGINT) AS mod_time, full_path,
    lower(full_path) AS path_key, lower(name) AS nl, lower(path) AS pl, lower(path) || '/' || lower(name) AS mp,
    regexp_extract(lower(name), '\.([^.]+)$', 1) AS ext, length(path) - length(replace(path, '/', '')) AS depth,
    strlen(lower(name)) AS name_len, strlen(lower(path)) + 1 + strlen(lower(name)) AS full_len
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(full_path) ORDER BY seq DESC) AS rn FROM keyed) WHERE rn = 1
)
"""
