"""Stores, their indexes and the feeds that keep them."""

import random
import re
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trawl.operators import content, mutations
from trawl.operators.catalog import Cancelled, Catalog, derive, session
from trawl.operators.indexes import All, Any, TrigramIndex, codes_of, needs, pattern_needs
from trawl.plans import compile as compile_
from trawl.plans import syntax as S
from trawl.sources import storage
from trawl.sources.store import NO_EVENT, Conflict, Store
from trawl.streaming.changes import GAP, RESET, broken, follow_stream, guarded_stream, merge_stream, read_feed

CHANGE = "op string, full_path string, name string, path string, type int, size long, mod_time long, seq long"


def add(i, op="ADD", seq=None, size=1):
    return (op, f"/d/f{i}.txt", f"f{i}.txt", "/d", 1, size, 1, i if seq is None else seq)


@pytest.fixture
def few(spark):
    return derive(spark.createDataFrame([(f"f{i}.txt", "/d", 1, i, 1) for i in range(4)], "name string, path string, type int, size long, mod_time long"))


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_deltas_equal_a_rewrite(spark, few, tmp_path):
    store, rng = Store(spark, f"file://{tmp_path}/s"), random.Random(3)
    store.replace({"files": (few, "path_key")})
    expected = few
    for n in range(3):
        batch = changes(spark, [add(rng.randint(0, 6), rng.choice(["ADD", "UPDATE", "REMOVE"]), seq, seq) for seq in range(9 * n, 9 * n + 9)])
        store.change({"files": mutations.delta(batch)}, last_event=9 * n + 8)
        expected = mutations.apply_changes(expected, batch)
        rows = lambda df: sorted(map(tuple, df.select("path_key", "full_path", "size", "ext").collect()))
        assert rows(store.read("files")) == rows(expected)
    before = rows(store.read("files"))
    assert store.head().tables["files"].deltas and not store.compact("files").tables["files"].deltas
    assert rows(store.read("files")) == before and rows(store.read("files", 0)) == rows(few) and store.head().last_event == 26
    assert store.vacuum(1) > 0 and store.versions() == [4] and rows(store.read("files")) == before
    with pytest.raises(FileNotFoundError):
        Store(spark, f"file://{tmp_path}/none").read("files")
    with pytest.raises(FileNotFoundError):
        Store(spark, f"file://{tmp_path}/none").change({})


def test_folded_deltas_read_alike(spark, tmp_path, docs, monkeypatch):
    store = indexed_store(spark, tmp_path, docs)
    for n in range(4):
        now = docs.where(f"path_key in ('/d/f{n}.txt', '/d/f9.txt')").withColumns({"content": F.concat(F.lit(f"Round{n} "), "content"), "mod_time": F.lit(10 + n).cast("long")})
        store.change(content.ContentIndex(store).deltas(now, spark.createDataFrame([(f"/d/f{20 + n}.txt",)], "path_key string")))
    state = lambda: (sorted(map(tuple, store.read("contents").collect())), sorted(map(tuple, store.read("words_postings").collect())), sorted(map(tuple, store.read("words_lengths").groupBy("tri").sum("n").collect())))
    before = state()
    assert [len(store.head().tables[t].deltas) for t in ("contents", "words_postings", "words_lengths")] == [4, 4, 4]
    monkeypatch.setattr(storage, "MAX_DELTAS", 3)
    storage.maintain(store, share=9)
    assert [len(store.head().tables[t].deltas) for t in ("contents", "words_postings", "words_lengths")] == [1, 1, 1] and state() == before
    assert store.fold("contents").version == store.head().version  # one delta is not folded
    storage.maintain(store, share=0.01)
    assert not any(store.head().tables[t].deltas for t in ("contents", "words_postings", "words_lengths")) and state()[:2] == before[:2]
    assert sorted(r["path_key"] for r in content.ContentIndex(store).search("round3", 0).collect()) == ["/d/f3.txt", "/d/f9.txt"]


def test_a_change_costs_its_own_size(spark, tmp_path):
    sizes = []
    for n in (10, 4000):
        store = Store(spark, f"file://{tmp_path}/s{n}")
        files = derive(spark.range(n).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("/d").alias("path"), F.lit(1).alias("type"), "id", F.lit(1).alias("mod_time")).withColumnRenamed("id", "size"))
        store.replace({"files": (files, "path_key")})
        folder = store.change({"files": mutations.delta(changes(spark, [add(1)]))}).tables["files"].deltas[0]
        sizes.append(sum(f.stat().st_size for f in (tmp_path / f"s{n}" / folder).iterdir() if f.suffix == ".parquet"))
    assert sizes[0] == sizes[1]


def test_two_writers_lose_nothing(spark, few, tmp_path):
    path = f"file://{tmp_path}/s"
    Store(spark, path).replace({"files": (few, "path_key")}, extra={"k": "v"}, offline=["/Volumes/A"])
    failed = []

    def write(base):
        try:
            for i in range(3):
                Store(spark, path).change({"files": mutations.delta(changes(spark, [add(base + i)]))}, last_event=base + i)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads], [t.join() for t in threads]
    head = Store(spark, path).head()
    assert not failed and head.version == 6 and head.last_event == 22 and head.extra == {"k": "v"} and head.offline == ["/Volumes/A"]
    assert {f"f{i}.txt" for i in (10, 11, 12, 20, 21, 22)} <= set(names(Store(spark, path).read("files")))


def test_who_read_an_old_version_is_told(spark, few, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    read = store.replace({"files": (few, "path_key")}).version
    store.change({"files": mutations.delta(changes(spark, [add(9)]))})
    with pytest.raises(Conflict):
        store.replace({"files": (few, "path_key")}, read=read)
    with pytest.raises(Conflict):
        storage.write_snapshot(few, store.path, read=read)
    assert "f9.txt" in names(store.read("files"))
    # A delta that comes while a compaction runs stays behind the new base.
    slow = lambda df: (store.change({"files": mutations.delta(changes(spark, [add(8)]))}), df)[1]
    assert len(store.compact("files", slow).tables["files"].deltas) == 1 and {"f8.txt", "f9.txt"} <= set(names(store.read("files")))
    with pytest.raises(Conflict):
        store.compact("files", lambda df: (store.replace({"files": (few, "path_key")}), df)[1])


def feed_of(spark, tmp_path, batches):
    """Deliveries to one feed, one at a time; each is followed by running the stream."""
    feed, check = f"file://{tmp_path}/feed", f"file://{tmp_path}/check"

    def deliver(start, rows):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(feed)
        start(read_feed(spark, feed, changes(spark, rows).schema), check).awaitTermination()

    return deliver


def test_compaction_between_micro_batches_loses_nothing(spark, few, tmp_path):
    base, deliver = f"file://{tmp_path}/s", feed_of(spark, tmp_path, 3)
    storage.write_snapshot(few, base, extra={"k": "v"}, offline=["/Volumes/A"])
    start = lambda feed, check: merge_stream(feed, base, check, compact_share=9)
    deliver(start, [add(10)])
    storage.compact(spark, base)
    deliver(start, [add(11, seq=5)])
    assert {"f10.txt", "f11.txt"} <= set(names(storage.read_snapshot(spark, base)))
    now = storage.metadata(spark, base)
    assert now["offline"] == ["/Volumes/A"] and now["extra"]["k"] == "v" and now["last_event"] == 10
    start = lambda feed, check: merge_stream(feed, base, check, compact_share=0.1)
    deliver(start, [add(12)])
    assert not Store(spark, base).head().tables["files"].deltas and "f12.txt" in names(storage.read_snapshot(spark, base))


def indexed_store(spark, tmp_path, docs):
    store = Store(spark, f"file://{tmp_path}/s")
    files = derive(docs.select(F.regexp_extract("path_key", "([^/]*)$", 1).alias("name"), F.lit("/d").alias("path"), F.lit(1).alias("type"), F.length("content").cast("long").alias("size"), "mod_time"))
    store.replace({"files": (files, "path_key")} | TrigramIndex.built(store, "names", files, "match_path") | content.ContentIndex.built(store, docs))
    return store


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(f"/d/f{i}.txt", f"Text {i} über apple" + " pear" * (i % 3), 1) for i in range(30)], "path_key string, content string, mod_time long")


def test_content_follows_in_one_commit(spark, tmp_path, docs, monkeypatch):
    store, deliver = indexed_store(spark, tmp_path, docs), feed_of(spark, tmp_path, 2)
    now = {"f1.txt": "fresh mango", "f50.txt": "New Mango", "f2.txt": "gone elsewhere"}

    def read(files):
        rows = [(f"/d/{n}", t, 7) for n, t in now.items()]
        return spark.createDataFrame(rows, "path_key string, content string, mod_time long").join(files.select("path_key"), "path_key", "left_semi")

    start = lambda feed, check: follow_stream(feed, store.path, check, read, {"txt"})
    batch = [add(1, "UPDATE", 1), add(50, "ADD", 2), add(3, "REMOVE", 3), add(4, "UPDATE", 4)]
    claim, version = Store._claim, store.head().version
    monkeypatch.setattr(Store, "_claim", lambda self, commit: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
    with pytest.raises(Exception, match="killed"):
        deliver(start, batch)
    assert store.head().version == version and "f50.txt" not in names(store.read("files"))  # the files were written, and do not show
    monkeypatch.setattr(Store, "_claim", claim)
    deliver(start, [add(2, "UPDATE", 5)])
    index = content.ContentIndex(store)
    found = lambda word, **k: sorted(r["path_key"] for r in content.ContentIndex(store).search(word, 0, **k).collect())
    assert found("MANGO") == ["/d/f1.txt", "/d/f50.txt"] == found("mango", verify=False) and found("Text 3 ") == [] and found("Text 1 ") == []
    assert found("Text 4 ") == []  # changed, and not to be read any more
    assert found("elsewhere") == ["/d/f2.txt"] and len(found("apple")) == 26
    assert {r["path_key"] for r in index.documents.collect()} <= {r["path_key"] for r in store.read("files").collect()}
    assert names(Catalog.stored(store).search("f50")) == ["f50.txt"] and names(Catalog.stored(store).search("f3.txt")) == []
    content.ContentIndex.compact(store)
    TrigramIndex.compact(store, "names")
    assert found("MANGO") == ["/d/f1.txt", "/d/f50.txt"] and names(Catalog.stored(store).search("f50")) == ["f50.txt"]
    assert TrigramIndex(store, "words").lengths(codes_of("mango")) == dict.fromkeys(codes_of("mango"), 2)


def test_unchanged_contents_are_not_indexed_again(spark, tmp_path, docs):
    store = indexed_store(spark, tmp_path, docs)
    index = content.ContentIndex(store)
    same_time = docs.where("path_key = '/d/f1.txt'").withColumn("content", F.lit("not looked at"))
    same_text = docs.where("path_key = '/d/f2.txt'").withColumn("mod_time", F.lit(9).cast("long"))
    unknown = docs.where("path_key = '/d/f3.txt'").withColumns({"mod_time": F.lit(0).cast("long"), "content": F.lit("kiwi")})
    store.change(index.deltas(same_time.unionByName(same_text).unionByName(unknown), docs.limit(0)))
    rows = {r["path_key"]: r for r in content.ContentIndex(store).documents.collect()}
    assert rows["/d/f1.txt"]["content"] != "not looked at" and rows["/d/f2.txt"]["mod_time"] == 9 and rows["/d/f3.txt"]["content"] == "kiwi" and len(rows) == 30
    delta = spark.read.parquet(f"{store.path}/{store.head().tables['words_postings'].deltas[0]}")
    assert delta.select("id").distinct().count() == 1


@pytest.mark.parametrize("word", ["apple", "Über app", "pear pear", "text 7 ", "ap", "", "nowhere", "r", "ÜBER"])
def test_index_and_scan_agree(spark, tmp_path, docs, word):
    store = indexed_store(spark, tmp_path, docs)
    rows = lambda df: list(map(tuple, df.collect()))
    assert rows(content.ContentIndex(store).search(word, 0)) == rows(content.search(docs, word, 0))


QUERIES = ["f1", "f1 f2", "<f1 | f2 > txt", "!f1", "case:F1", "*1?.txt", "/d/f2", "d/f1*", "ww:f7", "wfn:f7.txt", "regex:f[0-2]+\\.txt", "regex:(f1)+.txt", "regex:f\\x31", "path:/d/f2", "f1 size:>14", "ſtxt", "f1 | size:>16", "parent:/d", "regex:TXT$", "zzz | f9.t"]


def test_indexed_searches_change_no_result(spark, tmp_path, docs, monkeypatch):
    store = indexed_store(spark, tmp_path, docs)
    monkeypatch.setattr("trawl.operators.indexes.SCAN_SHARE", 2.0)
    catalog = Catalog.stored(store)
    for q in QUERIES:
        rows = lambda df: list(map(tuple, df.collect()))
        plain = rows(catalog.search(q, use_index=False))
        assert rows(catalog.search(q)) == plain, q
        tree = S.rewrite(S.parse(q))
        need = needs(tree)
        if need is not None:
            narrow = catalog.index.narrowed(catalog.files, need, 1, share=1e9)
            assert {r[6] for r in plain} <= {r["path_key"] for r in narrow.collect()}, q


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("report[0-9]+final", All(("report", "final"))), ("abc|abd", Any(("abc", "abd"))), ("abc|a", None), ("(foo|bar)baz", All((Any(("foo", "bar")), "baz"))), ("colou?r", "colo"), ("abc*d", "ab" and None),
        ("abcd*e", "abc"), ("abc+d", "abc"), ("(abc)*d", None), ("(abc){2,}", "abc"), (r"a\.txt", "a.txt"), (r"\Qa+b\Ec", "a+bc"), (r"abc\d", "abc"), ("(?i)abc", None), (r"\x41bc", None), ("[abc]def", "def"), ("[a[b]]def", None),
        ("^START$", "start"), ("über.*größe", "ber"), ("(?:one|two)?three", "three"), ("(?<n>one)", "one"), ("", None), ("a{0,2}bcd", "bcd"), ("ab{2}cd", None),
    ],
)
def test_what_a_pattern_needs(pattern, expected):
    assert pattern_needs(pattern) == expected


def test_needs_are_held_by_whatever_matches():
    rng = random.Random(4)
    parts = ["abc", "d", "e+", "(abc|dbe)", "x?", "[ab]", ".", "(cab)*", "bca{2}", "(?:ab|c)+", r"\."]

    def holds(need, text):
        return need in text if isinstance(need, str) else (all if isinstance(need, All) else any)(holds(p, text) for p in need.parts)

    checked = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        need = pattern_needs(pattern)
        if need is None:
            continue
        for _ in range(20):
            text = "".join(rng.choice(["a", "b", "c", "abc", "dbe", "d", "e", "x", ".", "bcaa", "cab"]) for _ in range(rng.randint(1, 6)))
            if re.search(pattern, text):
                checked += 1
                assert holds(need, text), (pattern, text, need)
    assert checked > 500


@pytest.mark.parametrize("pattern, expected", [("(a+)+$", True), ("(a|aa)+$", True), ("(a*)*", True), ("a*a*a*b", True), ("abc+", False), ("[0-9]+_[a-z]+", False), ("(abc)+", False), ("(a{1,9})+", True), (r"(a\+)+", False), ("((ab)?c)+", True)])
def test_patterns_that_backtrack(pattern, expected):
    assert compile_.backtracks(pattern) is expected


def test_regular_expressions_take_linear_time(spark):
    files = derive(spark.createDataFrame([("a" * 60 + "!", "/d", 1, 1, 1), ("AAAA", "/d", 1, 1, 1)], "name string, path string, type int, size long, mod_time long"))
    began = time.perf_counter()
    assert names(Catalog(files).search("regex:^(a+)+$")) == ["AAAA"]
    assert time.perf_counter() - began < 20
    assert names(Catalog(files).search("regex:(a+)+(?=x)")) == names(Catalog(files).search("regex:(a+")) == []


def test_broken_feeds(spark):
    seqs = lambda *s: spark.createDataFrame([(x,) for x in s], "seq long")
    for last, batch, why in ((5, (6, 7), None), (5, (7, 8), GAP), (5, (6, 8), GAP), (5, (6, 6, 7), None), (5, (4, 5), None), (5, (0, 1), RESET), (5, (), None), (NO_EVENT, (3, 4), None), (NO_EVENT, (3, 5), GAP), (5, (4, 5, 6), None)):
        assert broken(seqs(*batch), last) == why, (last, batch)


def test_a_feed_with_a_gap_is_scanned_anew(spark, few, tmp_path):
    base, deliver, scans = f"file://{tmp_path}/s", feed_of(spark, tmp_path, 3), []
    storage.write_snapshot(few, base, extra={"k": "v"})
    truth = [few]

    def rescan():
        scans.append(1)
        return truth[0]

    start = lambda feed, check: guarded_stream(feed, base, check, rescan)
    deliver(start, [add(0), add(1)])
    assert not scans
    truth[0] = mutations.apply_changes(few, changes(spark, [add(i) for i in (7, 8, 9)]))
    deliver(start, [add(9)])  # 2 to 8 never came
    assert scans == [1] and {"f7.txt", "f8.txt", "f9.txt"} <= set(names(storage.read_snapshot(spark, base)))
    deliver(start, [add(20, seq=10)])
    assert scans == [1] and "f20.txt" in names(storage.read_snapshot(spark, base))
    deliver(start, [add(30, seq=0)])  # counted anew
    now = storage.metadata(spark, base)
    assert len(scans) == 2 and now["last_event"] == 0 and now["extra"]["rescanned"] == RESET and now["extra"]["k"] == "v"


def test_an_older_search_of_a_session_ends(spark):
    def slow(batches):
        for b in batches:
            time.sleep(25)
            yield b

    files = derive(spark.range(4).repartition(2).selectExpr("cast(id as string) name", "'/d' path", "1 type", "id size", "1L mod_time"))
    stuck, told = files.mapInArrow(slow, files.schema), []

    def older():
        try:
            with session(spark, "me"):
                Catalog(stuck).search("d").collect()
        except Cancelled:
            told.append(time.perf_counter())

    thread = threading.Thread(target=older)
    thread.start()
    time.sleep(4)
    began = time.perf_counter()
    with session(spark, "you"):
        assert Catalog(files).search("d").count() == 4
    assert not told  # of another session
    with session(spark, "me"):
        thread.join(10)
        assert told and told[0] - began < 5
        assert Catalog(files).search("d").count() == 4
    with session(spark, ""):
        assert Catalog(files).search("d").count() == 4


QUERY_HINTS = ["test", "a | te", "d/te", "b/", "*.t?t", "ww:te", "wfn:TEST.md", "regex:t.s?", "regex:x*", "case:Te", "path:a file:t", "regex:[", "e/é st", "tt t te es", "regex:^(a+)+"]


def test_highlights_as_columns_equal_the_rules(spark):
    from trawl.operators import highlight

    rng = random.Random(8)
    texts = ["test.md", "TEST.md", "Te te-te.txt", "", "aé/É", "tttt", "x", None, "a b/test"] + ["".join(rng.choice("teTsadb/. éx") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(n, p) for n in texts for p in ("/a/b", "", "/d/te", None, "/tést/Te")], "name string, path string").persist()
    for q in QUERY_HINTS:
        wanted = [h for h in highlight.hints(q) if not (h.mode == S.REGEX and compile_.backtracks(h.text))]
        for r in highlight.highlighted(rows, q).collect():
            expected = highlight.both(r["name"] or "", r["path"] or "", wanted)
            assert ([tuple(x) for x in r["ranges"]["name"]], [tuple(x) for x in r["ranges"]["path"]]) == expected, (q, r)


def test_trigrams_of_long_texts(spark):
    from trawl.functions import text as T

    rows = spark.createDataFrame([("ab cd " * 20_000 + "É",), ("ab",), ("",), (None,), ("AbC",)], "t string")
    got = [[bytes(x) for x in r["g"]] for r in rows.select(T.trigrams(F.col("t")).alias("g")).collect()]
    assert got[0] == T.trigrams_of("ab cd " * 3 + "É") and got[1:4] == [[], [], []] and got[4] == [b"abc"]
    began = time.perf_counter()
    found = content.search(spark.createDataFrame([("/a", "x y " * 30_000 + "needle")], "path_key string, content string"), "needle", verify=False)
    assert [r["path_key"] for r in found.collect()] == ["/a"] and time.perf_counter() - began < 30
