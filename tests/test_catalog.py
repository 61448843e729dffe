"""Searches over small catalogs, compared with stated results and with a plain evaluator."""

import random
import re

import pytest

from trawl.operators import postings
from trawl.operators.catalog import Catalog, derive
from trawl.plans import syntax as S
from trawl.plans.syntax import And, Filter, Not, Or, PathSegments, Term


def make(spark, rows):
    rows = [(*r, 1, 0, 0)[:5] if len(r) < 5 else r for r in rows]
    return Catalog(derive(spark.createDataFrame(rows, "name string, path string, type int, size long, mod_time long")).cache())


def names(found):
    return [r["name"] for r in found.collect()]


def test_ranking(spark):
    c = make(spark, [("xalfred", "/tmp"), ("Alfred 5.app", "/Applications"), ("alfred_helper", "/bin"), ("Alfred", "/opt")])
    assert names(c.search("alfred"))[:2] == ["Alfred", "alfred_helper"]
    c = make(spark, [("main.cpp", "/usr/local/src"), ("local.conf", "/etc"), ("readme.md", "/usr/local/docs")])
    assert names(c.search("local"))[0] == "local.conf" and c.search("local").count() == 3
    c = make(spark, [("test.txt", "/a/b/c/d/e"), ("test.txt", "/tmp"), ("test.txt", "/a/b/c")])
    assert [r["path"] for r in c.search("test").collect()] == ["/tmp/test.txt", "/a/b/c/test.txt", "/a/b/c/d/e/test.txt"]
    c = make(spark, [(f"target_{i}.dat", "/t") for i in range(100)] + [("target", "/t")])
    assert names(c.search("target", 5))[0] == "target" and c.search("target", 5).count() == 5


def test_paths(spark):
    c = make(spark, [("config.yaml", "/app/settings"), ("config.yaml", "/other/place"), ("readme.md", "/app/settings"), ("target.txt", "/foo/bar"), ("target.txt", "/foo/mid/bar"), ("target.txt", "/bar/baz"), ("bin", "/usr/local", 2, 0, 0), ("gcc", "/usr/local/bin"), ("ls", "/usr/local/bin"), ("Caps", "/usr", 2, 0, 0), ("in", "/usr/Caps")])
    assert [r["path"] for r in c.search("/settings/config").collect()] == ["/app/settings/config.yaml"]
    assert c.search("/foo/bar/target").count() == 1
    assert c.search("/local/bin/").count() == 1
    assert sorted(names(c.search("/local/bin/*"))) == ["gcc", "ls"]
    assert names(c.search("/usr/Caps/*")) == ["in"]
    assert names(c.search("*/mid/*")) == ["target.txt"]


def test_adjacency_flag(spark):
    c = make(spark, [("n", "/a/x/b"), ("n", "/a/b/x")])
    assert c.search("a/*/b/n").count() != c.search("a/*/b/n", adjacency="documented").count()


def test_index_changes_nothing(spark):
    c = make(spark, [("Hello_World.cpp", "/src/a"), ("hello.TXT", "/doc"), ("other", "/hello/x"), ("né", "/ü")])
    indexed = Catalog(c.files, postings.postings(c.files, "match_path"))
    for q in ("hello", "hello world", "!hello", "hello | né", "ww:hello", "src/hello", "né", "he"):
        assert names(indexed.search(q)) == names(c.search(q)), q


# ---- against a plain evaluator ----

WORDS = ["ab", "a.b", "B", "x_1", "src", "lib", "a b", "é"]


def holds(n, r) -> bool:
    name, path = r["name"].lower(), r["path"].lower()
    whole = f"{path}/{name}"
    if isinstance(n, And):
        return all(holds(p, r) for p in n.parts)
    if isinstance(n, Or):
        return any(holds(p, r) for p in n.parts)
    if isinstance(n, Not):
        return not holds(n.part, r)
    if isinstance(n, PathSegments):
        todo = list(n.segments)
        for part in [x for x in whole.split("/") if x][::-1]:
            if not todo:
                break
            if todo[-1].text in part:
                todo.pop()
            elif len(todo) < len(n.segments) and n.segments[len(todo)].adjacent:
                return False
        return not todo
    if isinstance(n, Term):
        low = n.text.lower()
        if n.mode == S.GLOB:
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in low)
            return bool(re.fullmatch(pattern, whole if "/" in low else name, re.S))
        if n.mode == S.WHOLE_NAME:
            return name == low
        if n.mode == S.WHOLE_WORD:
            return bool(re.search(rf"(?<![a-z0-9]){re.escape(low)}(?![a-z0-9])", name))
        if n.case_sensitive:
            return n.text in (r["name"] if n.name_only else f"{r['path']}/{r['name']}")
        return low in (name if n.name_only else whole)
    if n.name == "ext":
        tail = name.rsplit(".", 1)[1] if "." in name else ""
        return tail != "" and tail in n.argument.lower().split(";")
    if n.name == "folder":
        return r["type"] == 2
    op, a, b = S.comparison(n.argument)
    v = {"size": r["size"], "len": len(name.encode()), "depth": path.count("/")}[n.name]
    return {"=": v == a, ">": v > a, "<": v < a, ">=": v >= a, "<=": v <= a, "..": a <= v <= b}[op]


def random_query(rng, level=0):
    kind = rng.random()
    if level < 3 and kind < 0.5:
        parts = [random_query(rng, level + 1) for _ in range(rng.randint(1, 3))]
        return rng.choice([" ".join(parts), f"<{' | '.join(parts)} >", f"!<{' '.join(parts)} >"])
    w = rng.choice(WORDS)
    return rng.choice([w, f'"{w}"', f"*{w}*", f"{w}?*", f"case:{w.split()[0]}", f"ww:{w.split()[0]}", f"wfn:{w.split()[0]}", f"src/{w.split()[0]}", f"lib/*/src/{w.split()[0]}", "ext:b;c", "size:>5", "len:2..5", "depth:2", "folder:", "src/lib/"])


@pytest.mark.parametrize("seed", range(3))
def test_random_queries(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(WORDS) + rng.choice(["", ".b", ".C", "_ab"]), "/" + "/".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))), rng.choice([1, 2]), rng.randint(0, 10), i) for i in range(120)]
    c = make(spark, rows)
    data = c.files.collect()
    for _ in range(12):
        q = random_query(rng)
        tree = S.parse(S.prepare(q))
        if S.path_query(q).mode == S.CHILDREN:
            continue
        expected = sorted(r["mod_time"] for r in data if tree is not None and holds(S.rewrite(tree), r))
        assert sorted(r["mod_time"] for r in c.search(q).collect()) == expected, q
