"""Phrases by stripes against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from trawl.llm import collocations as C

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, words=4, least=30, subsumed=80, top=2000) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, words + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(x == lang and len(q) > len(p) and 100 * b >= subsumed * a and holds(q) for (x, q), b in cand.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in sorted(n):
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(mine, 1)]
    return sorted(ranked)


def result(df) -> list[tuple]:
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "The", "of", "São", "x", "É", "é", "new", "york", "city", "hall", "\x0c", "a-b", "'"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(["new york city hall", "New York", "of the", rng.choice(words), f"w{rng.randint(0, 60)}"]) + rng.choice([" ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(parts)))
    return [*rows, ("en", None), (None, ""), ("fr", "..,;\n"), ("es", "a a a a " * 20), ("long", "to be " * 3000)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = made(seed, 500)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "lang string, text string, n int, phrase string, next string").repartition(3)
    assert result(C.collocations(docs)) == by_hand(rows)
    assert result(C.collocations(docs, words=3, least=12, subsumed=60, top=4)) == by_hand(rows, 3, 12, 60, 4)


def test_a_full_filter_and_small_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_BITS", 64)
    monkeypatch.setattr(C, "SLICE_BYTES", 200)
    rows = made(9, 300)
    assert result(C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(2))) == by_hand(rows)


def test_filter_keeps_what_it_holds():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    blocks = np.zeros(256, np.uint64)
    for bit in C._bits(h, 64 * 256):
        np.bitwise_or.at(blocks, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    seen = C.Filter(blocks)
    assert seen(h).all() and seen(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.02


def test_edges(spark):
    schema = "lang string, text string"
    assert result(C.collocations(spark.createDataFrame([], schema))) == []
    assert result(C.collocations(spark.createDataFrame([("en", None), (None, "one two")], schema))) == []
    # Products of counts pass 64 bits; ties of cuts go to the shortest first part.
    rows = [("en", "p q r. ")] * 40
    assert result(C.collocations(spark.createDataFrame(rows, schema))) == by_hand(rows) == [("en", 1, "p q r", 40, 40, 40, 120, 1000000)]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(C.ORACLE_SQL)
    assert [d[0] for d in expected.description] == COLUMNS
    rows = sorted(expected.fetchall())
    assert rows and result(C.op13_collocations(spark, SF)) == rows
