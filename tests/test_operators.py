"""Mutations, content, volumes, history, highlighting, storage, sources, streaming and the service."""

import io
import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from trawl.operators import content, highlight, history, mutations, volumes
from trawl.operators.catalog import Catalog, derive, last_wins
from trawl.plans import compile as compile_
from trawl.plans import syntax as S
from trawl.sources import storage
from trawl.sources.filesystem import DirectorySource
from trawl.streaming.changes import merge_stream, read_feed

RECORD = "name string, path string, type int, size long, mod_time long"
CHANGE = f"op string, full_path string, {RECORD}, seq long"


@pytest.fixture
def files(spark):
    return derive(spark.createDataFrame([("hello.txt", "/tmp", 1, 5, 10), ("world.cpp", "/tmp", 1, 6, 20), ("readme.md", "/home", 1, 7, 30), ("testdir", "/var", 2, 0, 40)], RECORD))


def paths(df):
    return sorted(r["full_path"] for r in df.collect())


def test_last_wins(spark):
    rows = [("dup.txt", "/a", 1, s, 0, i) for i, s in enumerate((100, 200, 400))] + [("DUP.TXT", "/A", 1, 300, 0, -1), ("unique.txt", "/a", 1, 1, 0, 9)]
    out = last_wins(derive(spark.createDataFrame(rows, RECORD + ", seq long"))).collect()
    assert sorted((r["full_path"], r["size"]) for r in out) == [("/a/dup.txt", 400), ("/a/unique.txt", 1)]


def test_changes(spark, files):
    changes = spark.createDataFrame(
        [
            ("ADD", "/tmp/new.txt", "new.txt", "/tmp", 1, 1, 1, 1),
            ("REMOVE", "/TMP/hello.txt", None, None, None, None, None, 2),
            ("UPDATE", "/home/readme.md", "readme2.md", "/home/x", 1, 9, 9, 3),
            ("REMOVE", "/none", None, None, None, None, None, 4),
            ("REMOVE", "/tmp/new.txt", None, None, None, None, None, 5),
            ("ADD", "/tmp/new.txt", "new.txt", "/tmp", 1, 2, 2, 6),
        ],
        CHANGE,
    )
    out = mutations.apply_changes(files, changes)
    assert paths(out) == ["/home/x/readme2.md", "/tmp/new.txt", "/tmp/world.cpp", "/var/testdir"]
    share = mutations.dirty_share(files, changes).first()
    assert (share["live"], share["dirty"]) == (4, 5)


def test_subtrees(spark):
    base = derive(spark.createDataFrame([(f"f{i}", "/a/b", 1, 0, 0) for i in range(10)] + [(f"g{i}", "/c/d", 1, 0, 0) for i in range(5)] + [("x", "/a/bc", 1, 0, 0)], RECORD))
    assert mutations.remove_subtree(base, "/A/b/").count() == 6
    fresh = spark.createDataFrame([(f"n{i}", "/a/b", 1, 0, 0) for i in range(3)], RECORD)
    assert mutations.replace_subtree(base, "/a/b", fresh).count() == 9
    assert mutations.remove_subtree(base, "/").count() == 0


def test_maintenance_rules():
    assert mutations.merge_rescans({"/a/b"}, ["/a", "/c", "/ab"]) == {"/a", "/c", "/ab"}
    assert mutations.merge_rescans({"/"}, ["/a"]) == {"/"}
    assert mutations.throttled("/a", {"/a": 100.0}, 399.0) and not mutations.throttled("/a", {"/a": 100.0}, 400.0)
    assert [mutations.flush_interval(s, 0) for s in (0.5, 0.2, 0.05, 0.0)] == [30.0, 150.0, 300.0, 600.0]
    assert mutations.flush_interval(0.0, 3 << 20) == 30.0
    assert mutations.should_compact(70, 30) and not mutations.should_compact(80, 20)


def test_events(spark):
    e = spark.createDataFrame([("/a/x", True, False, False, False, False, 1, 1, 1), ("/a/y", False, True, False, False, False, 1, 1, 2), ("/a/z", False, False, True, False, True, 7, 1, 3), ("/a/Q.app", False, False, True, True, False, 7, 1, 4), ("/a/Q.app/in", False, False, True, False, False, 1, 1, 5), ("/skip/x", False, False, True, False, False, 1, 1, 6), ("/a/n", False, False, False, False, False, 1, 1, 7)], "path string, removed boolean, renamed boolean, exists boolean, is_dir boolean, is_symlink boolean, size long, mod_time long, seq long")
    out = {r["full_path"]: (r["op"], r["type"], r["size"]) for r in mutations.changes_of_events(e, ("/skip",)).collect()}
    assert out == {"/a/x": ("REMOVE", 1, 1), "/a/y": ("REMOVE", 1, 1), "/a/z": ("UPDATE", 3, 0), "/a/Q.app": ("UPDATE", 5, 0)}


def test_content_is_searched_to_its_end(spark):
    text = "x" * (1 << 20) + " needle here"
    docs = spark.createDataFrame([("/long", text)], "path_key string, content string")
    assert [r["match_offset"] for r in content.search(docs, "needle", 0).collect()] == [(1 << 20) + 1]


def test_content(spark):
    rows = [(f"/d/f{i}", "\n".join(["padding line"] * 10 + [f"Found the SearchableKeyword here in file {i}!"] + ["padding line"] * 10), i) for i in range(20)]
    docs = spark.createDataFrame(rows, "path_key string, content string, mod_time long")
    out = content.search(docs, "searchablekeyword", 5).collect()
    assert len(out) == 5 and all("Found the SearchableKeyword" in r["snippet"] and r["snippet"].startswith("...") for r in out)
    assert out[0]["match_offset"] == rows[0][1].index("SearchableKeyword")
    assert content.search(docs, "ab").count() == 0
    assert content.search(docs, "keyword", 0, verify=False).count() == 20
    index = content.with_hash(docs)
    assert content.changed(docs, index).count() == 0
    touched = spark.createDataFrame([("/d/f0", rows[0][1], 99), ("/d/f1", "new", 99), ("/d/new", "x", 1)], docs.schema)
    assert sorted(r["path_key"] for r in content.changed(touched, index).collect()) == ["/d/f1", "/d/new"]
    after = {r["path_key"]: r["mod_time"] for r in content.index(touched, index).collect()}
    assert len(after) == 21 and after["/d/f0"] == 99


def test_readable(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.bin").write_bytes(b"x\0y")
    (tmp_path / "c.txt").write_text("")
    out = content.readable(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r["content"] for r in out] == ["plain"] and out[0]["path_key"] == str(tmp_path / "a.txt").lower()


@pytest.mark.parametrize("extra", [0, 100])
def test_volumes(spark, extra):
    v = spark.createDataFrame([("/Volumes", True), ("/Volumes/System", False), *((f"/m{i}", True) for i in range(extra))], "mount string, online boolean")
    f = derive(spark.createDataFrame([("foo.txt", "/Volumes/System", 1, 0, 0), ("System", "/Volumes", 2, 0, 0), ("x", "/Volumes/System2", 1, 0, 0), ("y", "/else", 1, 0, 0)], RECORD))
    out = {r["full_path"]: r["is_offline"] for r in volumes.flag_offline(f, v).collect()}
    assert out == {"/Volumes/System/foo.txt": True, "/Volumes/System": True, "/Volumes/System2/x": False, "/else/y": False}


def test_volume_registry(spark):
    v = spark.createDataFrame([("/a", True), ("/b", True)], "mount string, online boolean")
    e = spark.createDataFrame([("/a", "UNMOUNT", 1), ("/c", "MOUNT", 2), ("/b", "FORGET", 3)], "mount string, event string, seq long")
    assert sorted(tuple(r) for r in volumes.update(v, e).collect()) == [("/a", False), ("/c", True)]
    assert sorted(tuple(r) for r in volumes.reconcile(v, spark.createDataFrame([("/b",)], "mount string")).collect()) == [("/a", False), ("/b", True)]


def test_history(spark):
    made = spark.createDataFrame([("Foo", 1), ("foo", 2), ("food", 3), ("x", 4), ("infile:q", 5)], "query string, ts long")
    h = history.history(made)
    assert sorted((r["query"], r["count"]) for r in h.collect()) == [("foo", 2), ("food", 1)]
    assert history.suggest(h, "FO").first()["query"] == "foo"
    assert history.suggest_keyword("d") == "da:" and history.suggest_keyword("e") == "exe:" and history.suggest_keyword("a b") is None
    assert history.with_options("x", regex=True) == "regex:x"
    with pytest.raises(ValueError):
        history.with_options("x", regex=True, case=True)


def test_highlight(spark):
    hint = lambda q: [(h.text, h.field) for h in highlight.hints(q)]
    assert hint("hello !secret") == [("hello", "any")] and hint("path:downloads") == [("downloads", "path")] and hint("file:readme") == [("readme", "name")]
    assert hint("/usr/local/test") == [("test", "name")] and len(hint("readme ext:md path:docs")) == 2 and len(hint("hello | world")) == 2
    assert highlight.both("test.md", "/a/b", highlight.hints("test te")) == ([(0, 4)], [])
    assert highlight.both("test.md", "/a/b", [highlight.Hint("b/te")]) == ([(0, 2)], [(3, 4)])
    assert highlight.ranges("foo bar foo", highlight.Hint("foo", mode=S.WHOLE_WORD)) == [(0, 3), (8, 11)]
    assert highlight.ranges("a.cpp", highlight.Hint("*.cpp", mode=S.GLOB)) == [(1, 5)] and highlight.ranges("x", highlight.Hint("[", mode=S.REGEX)) == []
    row = highlight.highlighted(spark.createDataFrame([("test.md", "/a/test")], "name string, path string"), "test").first()["ranges"]
    assert [tuple(x) for x in row["name"]] == [(0, 4)] and [tuple(x) for x in row["path"]] == [(3, 7)]


def test_storage(spark, files, tmp_path):
    base = f"file://{tmp_path}/snap"
    assert storage.metadata(spark, base) is None
    assert storage.write_snapshot(files, base, extra={"a": "b"}, offline=["/x"]) == 0
    assert storage.write_snapshot(files.limit(1), base) == 1 and storage.write_snapshot(files, base, version=1) == 1
    assert storage.read_snapshot(spark, base).count() == 1 and storage.read_snapshot(spark, base, 0).count() == 4
    log = f"file://{tmp_path}/log"
    storage.append_changes(spark.createDataFrame([("ADD", f"/f{i}", f"f{i}", "/", 1, 1, 1, i) for i in range(6)], CHANGE), log)
    rows = storage.read_changes(spark, log)
    assert rows.where("corrupt").count() == 0
    assert storage.compact(spark, base, log, files=1) == 2
    # The log's first event, number 0, is new to a snapshot that has seen none.
    assert sorted(r["name"] for r in storage.read_snapshot(spark, base).collect())[:6] == [f"f{i}" for i in range(6)] and storage.metadata(spark, base)["last_event"] == 5
    broken = rows.selectExpr("* except (corrupt)", "seq = 4 as corrupt")
    assert sorted(r["seq"] for r in mutations.replay(broken).collect()) == [0, 1, 2, 3]


def test_mounts_with_a_slash_at_the_end(spark):
    rows = spark.createDataFrame([("/data/a",), ("/data2/a",), ("/data",), ("/m5/x",)], "path_key string")
    for n in (1, 101):  # few volumes and many
        mounts = spark.createDataFrame([("/data/", False), *((f"/m{i}", True) for i in range(n))], "mount string, online boolean")
        assert {r["path_key"]: r["is_offline"] for r in volumes.flag_offline(rows, mounts).collect()} == {"/data/a": True, "/data2/a": False, "/data": True, "/m5/x": False}


@pytest.mark.parametrize("pattern,fine", [(r"c\++", True), ("[*+]x", True), (r"\\\\1", True), ("a{2}", True), ("a++", False), ("a*+b", False), (r"(a)\1", False), ("(?=a)", False), ("(?<!a)b", False), ("(?>a)", False), ("(?:a|b)+?", True), ("[", False), (r"\Qa++\E", True)])
def test_patterns_read_part_by_part(spark, pattern, fine):
    assert compile_.regex_ok(pattern) is fine


def test_directories(spark, tmp_path):
    (tmp_path / "sub" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "X.app" / "in").mkdir(parents=True)
    for p, n in (("a.txt", 3), (".hidden", 1), ("sub/b", 2), ("sub/deep/c", 1), ("sub/deep/er/d", 4), ("X.app/in/e", 9)):
        (tmp_path / p).write_text("x" * n)
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    spark.dataSource.register(DirectorySource)
    rows = spark.read.format("directories").option("skip_hidden", "true").load(str(tmp_path)).collect()
    found = {os.path.join(r["path"], r["name"]).removeprefix(f"{tmp_path}/"): (r["type"], r["size"]) for r in rows}
    assert found == {"a.txt": (1, 3), "sub": (2, 0), "sub/b": (1, 2), "sub/deep": (2, 0), "sub/deep/c": (1, 1), "sub/deep/er": (2, 0), "sub/deep/er/d": (1, 4), "X.app": (5, 0), "link": (3, 0)}
    assert len(rows) == len(found)
    assert spark.read.format("directories").load(str(tmp_path / "none")).count() == 0


def test_stream_equals_batch(spark, files, tmp_path):
    base, feed, check = (f"file://{tmp_path}/{x}" for x in ("snap", "feed", "check"))
    storage.write_snapshot(files, base)
    rows = [("ADD" if i % 3 else "REMOVE", f"/s/f{i % 5}", f"f{i % 5}", "/s", 1, i, i, i) for i in range(40)]
    every = spark.createDataFrame(rows, CHANGE)
    for lo in (0, 20):
        every.where(f"seq >= {lo} and seq < {lo + 20}").coalesce(1).write.mode("append").parquet(feed)
        merge_stream(read_feed(spark, feed, every.schema), base, check).awaitTermination()
    got = sorted((r["full_path"], r["size"]) for r in storage.read_snapshot(spark, base).collect())
    assert got == sorted((r["full_path"], r["size"]) for r in mutations.apply_changes(files, every).collect())


def test_service(spark, files):
    from trawl.service import Api, rpc, serve_rpc, server

    docs = spark.createDataFrame([("/tmp/hello.txt", "some hello text")], "path_key string, content string")
    api = Api(Catalog(files), docs)
    http = server(api)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{p}"))
    assert [r["name"] for r in get("/api/search?q=hello&limit=5")["results"]] == ["hello.txt"]
    assert get("/api/search/content?q=hello")["results"][0]["snippet"] == "some hello text"
    assert get("/api/search?q=infile:HELLO")["count"] == 1
    assert get("/api/status")["liveRecordCount"] == 4 and get("/api/recent?limit=2")["results"][0]["name"] == "testdir" and get("/api/health") == {"status": "ok"}
    for path, code in (("/api/search", 400), ("/nothing", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    http.shutdown()
    again = Api(None, rebuild={"index": lambda: Catalog(files)})
    assert again.post("/api/index/rebuild", b"")[0] == 200 and again.get("/api/status")[1]["liveRecordCount"] == 4 and again.post("/api/content/rebuild", b"")[0] == 404
    assert [r["name"] for r in Catalog.page(api.catalog.search("t"), 1, 2).collect()] == [r["name"] for r in api.catalog.search("t").collect()[2:4]]
    assert Api(None).get("/api/search?q=a")[0] == 503 and Api(None).post("/api/content/config", b"{")[0] == 400
    assert rpc(api, {"id": 1, "method": "ping"})["result"] == {} and rpc(api, {"method": "note"}) is None
    assert len(rpc(api, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 4
    out = io.StringIO()
    serve_rpc(api, ['{"id":2,"method":"tools/call","params":{"name":"search_files","arguments":{"query":"world"}}}\n', "junk\n"], out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert "world.cpp" in first["result"]["content"][0]["text"] and second["error"]["code"] == -32700


def test_entry_where_the_corpus_part_is_gone(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md"))
    assert not (copy / "trawl" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(o) <= set(q); import trawl.service, trawl.streaming.rescans"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_without_the_corpus_part():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"substr_and", "dir_list", "merge_changes"} <= names and set(entry.oracle_sql()) <= names
