"""Requests to scan again, by hand and as a stream."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from trawl.operators import mutations
from trawl.operators.catalog import derive
from trawl.sources import storage
from trawl.sources.filesystem import DirectorySource
from trawl.sources.store import Store
from trawl.streaming.changes import read_feed
from trawl.streaming.rescans import Waiting, due_scans, mount_requests, rescan_stream, rescanned

REQUEST = "volume string, path string, ts timestamp"


def test_requests_wait_for_each_other():
    w = Waiting(5, 300)
    assert w.request("/v/a/b", 0) == w.request("/v/a", 4) == w.request("/v/c", 8.9) == []
    assert w.until(13.8) == [] and w.until(13.9) == [("/v/a", 13.9), ("/v/c", 13.9)]
    assert w.until(1000) == [] and w.due is None


def test_a_path_scanned_lately_waits():
    w = Waiting(5, 300)
    assert w.request("/v/a", 0) == [] and w.request("/v/a", 100) == [("/v/a", 5)]
    assert w.until(105) == []  # due, and held back for 300 seconds from then
    assert w.request("/v/b", 200) == [] and w.until(205) == [("/v/b", 205)]  # the same timer: what is held is looked at again
    assert w.until(504) == [] and w.until(505) == [("/v/a", 505)]
    assert w.until(5000) == [] and w.request("/v/z", 5000) == [] and w.until(5005) == [("/v/z", 5005)] and "/v/a" not in w.last


@pytest.mark.parametrize("seed", range(3))
def test_merged_paths(seed):
    rng = random.Random(seed)
    for _ in range(200):
        paths = ["/" + "/".join(rng.choice(["a", "a-b", "ab", "b"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 8))]
        kept = mutations.merge_rescans(set(paths[:3]), paths[3:])
        assert kept == {p for p in paths if not any(q != p and mutations.subsumed(p, q) for q in paths)}


def at(seconds):
    return datetime.fromtimestamp(seconds, UTC)


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_stream_equals_one_clock(spark, tmp_path, cuts):
    """However the feed is cut into micro-batches, a volume's scans are those of a clock that hears each request in turn."""
    rng = random.Random(cuts)
    rows = sorted((t, f"/v{rng.randint(0, 2)}", rng.choice(["/a", "/a/b", "", "/c"])) for t in (rng.randint(0, 4000) for _ in range(150)))
    rows = [(v, v + p, at(t)) for t, v, p in rows] + [("/late", "/late", at(90_000)), ("/x", None, at(5)), ("/x", "/x", None)]
    feed, out, check = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "check"))
    for k in range(cuts):
        spark.createDataFrame(rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts], REQUEST).coalesce(1).write.mode("append").parquet(feed)
        due = due_scans(read_feed(spark, feed, REQUEST), 20, 300)
        due.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    clocks, expected = {}, []
    for v, p, t in rows:
        if p is not None and t is not None:
            expected += [(v, *x) for x in clocks.setdefault(v, Waiting(20, 300)).request(p, t.timestamp())]
    for v, w in clocks.items():
        expected += [(v, *x) for x in w.until(90_000)]
    got = sorted(map(tuple, spark.read.schema(due.schema).parquet(out).collect()))
    assert got == sorted(expected) and len(got) > 10


def test_scans_replace_what_lies_below(spark, tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d" / "new.txt").write_text("x")
    spark.dataSource.register(DirectorySource)
    rows = [("old.txt", f"{root}/d", 1, 5, 1), ("d", str(root), 2, 0, 1), ("dd.txt", str(root), 1, 1, 1)]
    store = Store(spark, f"file://{tmp_path}/s")
    store.replace({storage.FILES: (derive(spark.createDataFrame(rows, "name string, path string, type int, size long, mod_time long")), "path_key")})

    def scan(roots):
        return spark.read.format("directories").load(f"{root}/d")

    feed = f"file://{tmp_path}/feed"
    spark.createDataFrame([(str(root), f"{root}/d", at(10)), (str(root), f"{root}/d/e", at(11)), ("/other", "/other", at(99))], REQUEST).write.parquet(feed)
    for _ in range(2):  # the second time nothing is new
        rescan_stream(read_feed(spark, feed, REQUEST), store.path, f"file://{tmp_path}/check", scan).awaitTermination()
        assert {r["name"] for r in store.read(storage.FILES).collect()} == {"new.txt", "dd.txt"}
    rescanned(store, spark.createDataFrame([("/",)], "path string"), lambda roots: derive(spark.createDataFrame(rows[2:], "name string, path string, type int, size long, mod_time long")))
    assert [r["name"] for r in store.read(storage.FILES).collect()] == ["dd.txt"]


def test_new_mounts_ask_for_scans(spark):
    volumes = lambda *rows: spark.createDataFrame(rows, "mount string, online boolean")
    asked = mount_requests(volumes(("/a", True), ("/b", False)), volumes(("/a", True), ("/b", True), ("/c", True), ("/d", False)), at(7))
    assert sorted((r["volume"], r["path"]) for r in asked.collect()) == [("/b", "/b"), ("/c", "/c")] and asked.where(F.col("ts").isNull()).count() == 0
