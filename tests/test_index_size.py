"""What indexes and their stores take on disk."""

from pyspark.sql import functions as F

from trawl import suite
from trawl.operators import content, mutations
from trawl.operators.catalog import Catalog, derive
from trawl.operators.indexes import TrigramIndex
from trawl.sources.store import CLEANUP, Store


def catalog(spark, n):
    return derive(spark.range(n).select(F.format_string("order_%d_urgent.pdf", "id").alias("name"), F.format_string("/archive/%d", F.col("id") % 7).alias("path"), F.lit(1).alias("type"), F.col("id").alias("size"), F.lit(1).cast("long").alias("mod_time")))


def test_an_index_takes_few_bytes_a_pair_and_no_shuffle(spark, tmp_path):
    files = catalog(spark, 20_000)
    assert "Exchange" not in TrigramIndex.arranged(TrigramIndex.pairs(files, "match_path"))._jdf.queryExecution().executedPlan().toString()
    store = Store(spark, f"file://{tmp_path}/s")
    store.replace({"files": (files, "path_key")} | TrigramIndex.built(store, "names", files, "match_path", table="files"))
    t = store.head().tables["names_postings"]
    assert t.rows == store.read("names_postings").count() == TrigramIndex.pairs(files, "match_path").count()
    assert sum(f.stat().st_size for f in (tmp_path / "s" / t.base).glob("*.parquet")) < 4 * t.rows
    assert spark.conf.get(CLEANUP) == "false"


def test_pairs_made_anew_equal_merged_ones(spark, tmp_path):
    files, stores = catalog(spark, 300), []
    batch = spark.createDataFrame([("ADD", "/x/new_name", "new_name", "/x", 1, 1, 1, 1), ("REMOVE", "/archive/3/order_3_urgent.pdf", "", "", 1, 1, 1, 2), ("UPDATE", "/archive/4/order_4_urgent.pdf", "Other", "/archive/4", 1, 1, 1, 3)], "op string, full_path string, name string, path string, type int, size long, mod_time long, seq long")
    for table in ("files", None):
        store = Store(spark, f"file://{tmp_path}/{table}")
        store.replace({"files": (files, "path_key")} | TrigramIndex.built(store, "names", files, "match_path", table=table))
        delta = store.stage(mutations.delta(batch), "files")
        store.change({"files": delta} | TrigramIndex.changed(store, "names", delta.df.where("not gone"), delta.df.where("gone"), "match_path"))
        before = sorted(map(tuple, store.read("names_postings").collect()))
        TrigramIndex.compact(store, "names")
        assert not store.head().tables["names_postings"].deltas and sorted(map(tuple, store.read("names_postings").collect())) == before
        assert [r["name"] for r in Catalog.stored(store).search("other").collect()] == ["Other"] and Catalog.stored(store).search("order_3_").count() == 0
        stores.append(before)
    assert stores[0] == stores[1]


def test_contents_are_folded_by_one_shuffle(spark, tmp_path):
    docs = spark.range(60).select(F.format_string("/d/f%d", "id").alias("path_key"), F.format_string("Text %d", "id").alias("content"), F.lit(1).cast("long").alias("mod_time"))
    store = Store(spark, f"file://{tmp_path}/s")
    store.replace(content.ContentIndex.built(store, docs))
    for n in (2, 3):
        now = docs.where(f"mod_time % {n} = 1").limit(20 * n).withColumns({"content": F.concat("content", F.lit(f" of {n}")), "mod_time": F.lit(n).cast("long")})
        store.change(content.ContentIndex(store).deltas(now, docs.where(f"path_key = '/d/f{n}'")))
    t = store.head().tables["contents"]
    folded = store._sorted(t, "id")
    assert folded._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, store._read(t).collect()))


def test_a_search_makes_the_tables_it_reads_alone(spark, monkeypatch):
    def unasked(*_):
        raise AssertionError("not read by this search")

    sf = "/root/testdata/sf0.001"
    with monkeypatch.context() as m:
        m.setattr(suite.sample, "records", unasked)
        m.setattr(suite, "catalog_files", unasked)
        assert suite.content_search(spark, sf).count() == suite.content_scan(spark, sf).count()
    with monkeypatch.context() as m:
        m.setattr(suite.sample, "documents", unasked)
        assert suite.index_candidates(spark, sf).count() > 0 and suite.regex_atoms_search(spark, sf).count() >= 0
