"""Scans by levels: what is met twice, what fails, what is stopped, and the service that starts with one."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from trawl.operators.catalog import DIRECTORY, FILE
from trawl.sources import filesystem
from trawl.sources.filesystem import DirectorySource, Progress, scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for p, n in (("a.txt", 3), (".hidden", 1), ("sub/b", 2), ("sub/deep/er/d", 4), (".git/x", 1), ("X.app/in/e", 9)):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x" * n)
    (root / "link").symlink_to(root)
    return root


def test_equals_the_data_source(spark, tree, tmp_path):
    spark.dataSource.register(DirectorySource)
    for hidden in (False, True):
        done = scan(spark, str(tree), f"file://{tmp_path}/w{hidden}", skip_hidden=hidden)
        other = spark.read.format("directories").option("skip_hidden", str(hidden).lower()).load(str(tree))
        assert sorted(map(tuple, done.records.select(other.columns).collect())) == sorted(map(tuple, other.collect()))
        assert done.errors.count() == 0 and not done.stopped and done.progress[-1].waiting == 0
    assert done.progress[0] == Progress(0, 1, 4, 0, 1)
    kinds = {r["type"]: (r["n"], r["bytes"]) for r in done.kinds().collect()}
    assert kinds[FILE] == (3, 9) and kinds[DIRECTORY][0] == 3


def faked():
    def fake(path, skip_hidden, device, failed):
        """Two paths to each directory, that lead to one another, and some that cannot be read."""
        if path.endswith("bad"):
            failed(path, "EACCES")
            return
        last = path.rsplit("/", 1)[1]
        k = int(last[1:-1]) if last[0] == "L" else 0
        if k < 5:
            for twin in "ab":
                yield f"L{k + 1}{twin}", path, DIRECTORY, 0, 1, 101 + k, 7  # the same inode
            yield "bad", path, DIRECTORY, 0, 1, 500 + k, 7
        yield "L1x", path, DIRECTORY, 0, 1, 101, 7  # a way back
        yield f"file{k}", path, FILE, 5, 1, 900 + k, 7

    return fake  # travels to the workers by value


def test_a_directory_is_walked_once_and_errors_are_kept(spark, tmp_path):
    root = str(tmp_path)
    done = scan(spark, root, f"file://{tmp_path}/w", lister=faked())
    rows = done.records.where("type = 1").collect()
    assert sorted(r["name"] for r in rows) == [f"file{k}" for k in range(6)]  # one path to each level, and no way back
    assert {(r["error"], r["n"]) for r in done.kinds().where("error is not null").collect()} == {("EACCES", done.errors.count())} and done.errors.count() == 5
    assert done.progress[-1].errors == done.errors.count() and done.progress[-1].records == done.records.count()


def test_a_scan_can_be_stopped(spark, tree, tmp_path):
    done = scan(spark, str(tree), f"file://{tmp_path}/w", report=lambda p: p.level < 1)
    assert done.stopped and len(done.progress) == 2 and done.progress[-1].waiting > 0 and done.records.count() == done.progress[-1].records
    none = scan(spark, f"{tmp_path}/none", f"file://{tmp_path}/w2")
    assert none.records.count() == 0 and [tuple(r) for r in none.errors.collect()] == [(f"{tmp_path}/none", "ENOENT")]


def test_hidden_by_flag(tmp_path):
    (tmp_path / "seen").write_text("x")
    (tmp_path / "flagged").write_text("x")

    class Entry:
        def __init__(self, name):
            self.name = name

    class Info:
        st_flags = 0x8000

    assert filesystem._hidden(Entry("flagged"), Info()) and not filesystem._hidden(Entry("seen"), tmp_path.stat()) and filesystem._hidden(Entry(".x"), tmp_path.stat())


def test_service_scans_stores_and_follows_its_settings(spark, tree, tmp_path, monkeypatch):
    from trawl import service

    served = []

    class Stop(Exception):
        pass

    def server(api, port):
        served.append(api)
        raise Stop

    monkeypatch.setattr(service, "server", server)
    (tree / "note.txt").write_text("hello mango")
    (tree / "note.cfg").write_text("mango too")
    (tree / "long.txt").write_text("mango " * 100)
    with pytest.raises(Stop):
        service.main(["--cache-dir", f"file://{tmp_path}/cache", "--root", str(tree)])
    api = served[0]
    found = lambda q: sorted(r["name"] for r in api.get(f"/api/search?q={q}")[1]["results"])
    texts = lambda: sorted(r["fileName"] for r in api.get("/api/search/content?q=mango")[1]["results"])
    assert found("note") == ["note.cfg", "note.txt"] and found("hidden") == [] and texts() == ["long.txt", "note.txt"]
    assert api.post("/api/content/config", json.dumps({"extensions": ["cfg", "txt"], "maxFileSize": 50}).encode())[0] == 200
    assert api.post("/api/content/config", b'{"extensions": 3}')[0] == api.post("/api/content/config", b"[]")[0] == 400
    assert api.post("/api/content/rebuild", b"")[0] == 200 and texts() == ["note.cfg", "note.txt"]
    assert api.get("/api/status")[1]["contentIndexedFileCount"] == 3 and api.answer("DELETE", "/api/search")[0] == 405
    with pytest.raises(Stop):
        service.main(["--cache-dir", f"file://{tmp_path}/cache2", "--root", str(tree), "--show-hidden", "--port", "0"])
    api = served[1]
    assert found("hidden") == [".hidden"]


def test_methods_that_are_not_allowed():
    from trawl.service import Api, server

    http = server(Api(None))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    for method, code in (("PUT", 405), ("DELETE", 405), ("POST", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}/api/search", method=method, data=b"" if method != "DELETE" else None))
        assert e.value.code == code
    http.shutdown()


def test_a_clients_older_search_answers_with_nothing(spark):
    from trawl.operators.catalog import Catalog, derive
    from trawl.service import Api

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    files = derive(spark.range(2).repartition(2).selectExpr("cast(id as string) name", "'/d' path", "1 type", "id size", "1L mod_time"))
    api, answers = Api(Catalog(files.mapInArrow(slow, files.schema))), []
    thread = threading.Thread(target=lambda: answers.append(api.get("/api/search?q=d&session=me")))
    thread.start()
    time.sleep(3)
    quick = Api(Catalog(files))
    assert quick.get("/api/search?q=d&session=me")[1]["count"] == 2
    thread.join(10)
    assert answers and answers[0][0] == 200 and answers[0][1]["results"] == []
