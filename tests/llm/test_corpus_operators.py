"""Operators over the whole corpus: near duplicates, containment, line templates, top-k, and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from trawl.llm import decontaminate, exact_topk, line_templates, simhash
from trawl.llm.common import shingles, words


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    s = shingles(words(text), 3)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


def test_anchor_code():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**32, 500, dtype=np.uint32)
    found, real = simhash.anchors(x)
    d = np.bitwise_count(found ^ x[:, None])
    assert (d[:, 0] <= 1).all() and (d[real] <= 2).all()
    for flip in range(32):  # one bit away: its nearest anchor is among those within two
        home = simhash.anchors(x ^ np.uint32(1 << flip))[0][:, 0]
        assert ((found == home[:, None]) & real).any(1).all()


@pytest.mark.parametrize("seed", range(2))
def test_simhash_equals_brute_force(spark, seed, monkeypatch):
    texts = [*near_texts(seed, 60), "", None, "one", "Two words", "one"]
    rows = [(i * 7 + 3, t, "clash", 1, b"x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int, fp binary")
    out = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    expected = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert out == {i: (prints[i], expected[i]) for i in prints}


def test_simhash_tiles(spark, monkeypatch):
    """Hot meeting places cut into many tiles give the same components."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 120:
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = {p - (p >> 63 << 64) for p in prints}  # as signed integers
    nodes = spark.createDataFrame([(p, p) for p in sorted(prints)], "node long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 3)).collect()}
    got = {p: roots.get(p, p) for p in prints}
    assert got == brute_components(sorted(prints), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)


def test_simhash_edges(spark):
    schema = "doc_id long, text string"
    out = simhash.simhash_components(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q"), (9, None), (7, "")], schema)).collect()
    assert sorted(((str(r["doc_id"]), r["component_id"]) for r in out), key=str) == [("5", 5), ("5", 5), ("7", 7), ("9", 7), ("None", 5), ("None", None)]
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(spark.createDataFrame([], schema), max_distance=4)


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts(11, 80)
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    sets = {i: set(shingles(words(t), 5)) for i, t in enumerate(texts)}
    expected = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(expected.values())


def test_near_duplicate_edges(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (2, "a b"), (8, None), (7, ""), (None, "z"), (4, "!")], schema)
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_duplicates(docs).collect()) == ["2", "4", "7", "None"]
    assert simhash.drop_near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_no_near_duplicate_link_is_lost(spark):
    """Short texts, chains of edits and a crowd of copies of one text: the groups are those of brute force."""
    rng = random.Random(3)
    texts = near_texts(12, 60)
    for i in range(150):  # 13 to 20 words with the last one changed, or one more
        w = [f"s{i}x{rng.randrange(10**6)}" for _ in range(rng.choice([13, 20]))]
        texts += [" ".join(w), " ".join([*w[:-1], "other"]) if i % 2 else " ".join([*w, "more"])]
    crowd = [f"c{rng.randrange(10**6)}" for _ in range(60)]
    for _ in range(200):
        w = list(crowd)
        w[rng.randrange(60)] = f"d{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = {i: set(shingles(words(t), 5)) for i, t in enumerate(texts)}
    expected = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    least = {}
    for r in found:
        least[r["root"]] = min(least.get(r["root"], r["id"]), r["id"])
    assert {r["id"]: least[r["root"]] for r in found} == expected


@pytest.mark.parametrize("size", [5, 6, 13, 20, 40])
def test_short_texts_always_meet(size):
    """Texts of few words at 0.8 or more share a value of their prefixes, frequent values or not."""
    rng = random.Random(size)
    for _ in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        hashes = lambda words: simhash.shingle_sets(pa.array([" ".join(words)]), 5)[0]
        a = hashes(w)
        for other in ([*w[:-1], "other"], [*w, "more"], [*w[:-2], "two", "others"]):
            b = hashes(other)
            if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            hot = np.unique(rng.sample(a.tolist(), len(a) // 2)).astype(np.uint64)
            for known in (np.empty(0, np.uint64), hot):
                x, y = (simhash.prefix(v, known, np.full(len(known), 2), 0.8) for v in (a, b))
                assert len(np.intersect1d(x, y))


@pytest.mark.parametrize("tile", [4, 1024])
def test_word_order_and_small_changes(spark, monkeypatch, tile):
    """Triples of a text, its words in another order and a copy with one word changed: only the last is linked."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(8)
    texts = []
    for i in range(200):
        w = [f"t{i}x{rng.randrange(10**6)}" for _ in range(rng.randint(80, 200))]
        other, changed = rng.sample(w, len(w)), list(w)
        changed[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), " ".join(other), " ".join(changed)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {i for i in range(600) if i % 3 < 2}


def test_shingle_sets_equal_strings():
    texts = ["", None, "a", "A b", " a  b\tc d e f ", "é É a b c d e é É a b c d e", "\u00a0x\u2003y z", "a b c d e a b c d e a"] * 2
    sets = simhash.shingle_sets(pa.array(["x y z", *texts]).slice(1), 5)
    strings = [set(shingles(words(t), 5)) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in strings]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(a, b)) == len(strings[i] & strings[j])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, n, replace=False), rng.integers(0, 2**63, m, dtype=np.uint64))) for n, m in rng.integers(1, 700, (60, 2))]
    sketches = simhash.Sketches([simhash.sketch(s) for s in sets])
    for i, a in enumerate(sets):
        d = sketches.differ(np.full(len(sets), i), np.arange(len(sets)))
        for j, b in enumerate(sets):
            if np.isfinite(d[j]):
                assert d[j] <= len(np.setxor1d(a, b))
            else:
                assert min(len(a), len(b)) < 0.8 * max(len(a), len(b))


# ---- decontamination ----


def test_containment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randint(1, 40))) for i in range(40)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for d in range(80):
        w = make(rng.randint(0, 300)).split()
        if d % 2:
            item = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, 2)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((d, " ".join(w)))
    docs += [(100, None), (None, items[0][1]), (101, "ONE  two"), (101, "ONE  two"), (102, "there is one\ttwo in here"), (103, "one and two")]
    expected = []
    for d, t in docs:
        for i, s in items:
            size = min(5, len(words(s)))  # an item of fewer words is one shingle of all of them
            theirs = set(shingles(words(s), 5))
            own = set(shingles(words(t), size)) if size and len(words(t)) >= size else set()
            if theirs and len(theirs & own) >= 0.8 * len(theirs):
                expected.append((i, d, len(theirs), len(theirs & own)))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items + items[:3], "item_id long, text string")
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    for chars in (decontaminate.BLOCK_CHARS, 300):  # one block of items, and many
        blocks = decontaminate.item_blocks
        monkeypatch.setattr(decontaminate, "item_blocks", lambda items, chars=chars, blocks=blocks: blocks(items, block_chars=chars))
        got = [tuple(r)[:4] for r in decontaminate.contained_items(d, i).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
        monkeypatch.undo()
    clean = decontaminate.decontaminate(d, i)
    dirty = {x[1] for x in expected}
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(x for x, _ in docs if x not in dirty)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(d, none).count() == 0 and decontaminate.decontaminate(d, none).count() == len(docs)
    assert decontaminate.contained_items(d.limit(0), i).count() == 0


def test_signatures_lose_nothing():
    for m in range(1, 300):
        assert decontaminate.signature_size(m, 0.8) >= m - -(-8 * m // 10) + 1


# ---- line templates ----


def test_recurring_lines_go_and_copies_stay(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("red green blue old new tall small".split()) + str(rng.choice("abcdefgh")) for _ in range(9))
    docs = [(i, "\n".join([sentence(), f"Posted on day {i} by user{i} here", sentence(), "", "Share this page"])) for i in range(40)]
    docs += [(1000 + i, "A copied text with its own first line\nand its second line\nand the last one") for i in range(50)]
    docs += [(2000, None), (2001, ""), (2001, ""), (None, "Share this page\nx"), (2002, "w " * 30_000)]
    df = spark.createDataFrame([(*d, 5, "q") for d in docs], "doc_id long, text string, n_lines int, id string")
    out = line_templates.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(docs)
    for i in range(40):
        a, _, b, blank, _ = docs[i][1].split("\n")
        assert rows[i]["text"] == "\n".join([a, b, blank]) and rows[i]["n_dropped"] == 2
    assert all(rows[1000 + i]["text"] == docs[40][1] for i in range(50))
    assert (rows[2000]["text"], rows[2000]["n_lines"]) == (None, 0) and (rows[2001]["text"], rows[2001]["n_lines"]) == ("", 1)
    assert rows[None]["text"] == "x"
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


def test_variable_words_are_generalised(spark):
    names = "anna bert cora dirk emil fran gabi hugo ines jona karl lena".split()
    docs = [(i, f"start{i} of text\nWritten by {n} for the daily paper\nend {n}{n} of it") for i, n in enumerate(names)]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all("Written by" not in r["text"] for r in out)


def _prose(rng, n, tag=""):
    return " ".join(f"{tag}{rng.choice('abcdefgh')}{rng.choice('klmnopqr')}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))


def test_line_templates_beside_a_crowd_of_near_copies(spark):
    """A notice in unrelated texts goes, also from a crowd of near copies that holds it; the crowd's own lines stay."""
    rng = random.Random(4)
    notice = "This notice may be copied freely"
    body = [_prose(rng, 12) for _ in range(9)]
    docs = [[_prose(rng, 10) for _ in range(5)] + [notice] for _ in range(30)]
    for _ in range(300):
        copy = [*body, notice]
        for _ in range(2):
            at = rng.randrange(9)
            w = copy[at].split()
            w[rng.randrange(len(w))] = _prose(rng, 1)
            copy[at] = " ".join(w)
        docs.append(copy)
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"].split("\n") for r in line_templates.drop_recurring_lines(df).collect()}
    assert all(out[i] == [x for x in d if x != notice] for i, d in enumerate(docs))


def test_passages_of_several_lines_go(spark):
    """Also their inner lines, and a header that begins every text; of a long line few occurrences are enough."""
    rng = random.Random(5)
    passage, header, long = [_prose(rng, 9) for _ in range(6)], [_prose(rng, 8) for _ in range(3)], _prose(rng, 60)
    docs = []
    for i in range(40):
        own = [_prose(rng, 12) for _ in range(8)]
        at = rng.randrange(9)
        docs.append(header + own[:at] + (passage if i % 2 else []) + own[at:] + ([long] if i < 4 else []))
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"].split("\n") for r in line_templates.drop_recurring_lines(df).collect()}
    gone = {*passage, *header, long}
    assert all(out[i] == [x for x in d if x not in gone] for i, d in enumerate(docs))


def test_templates_share_a_leaf(spark):
    """Three templates of one length and opening, none in half of the leaf's lines, with variable words; prose beside them stays."""
    rng = random.Random(6)
    forms = ["Sent by {} to our readers every week", "Sent by {} from home without any delay", "Sent by {} under terms nobody has read"]
    docs = [[_prose(rng, 11), forms[i % 3].format(_prose(rng, 1)) if i < 60 else "Sent by " + _prose(rng, 6), _prose(rng, 13), _prose(rng, 7)] for i in range(90)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"].split("\n") for r in line_templates.drop_recurring_lines(df).collect()}
    assert all(out[i] == [x for k, x in enumerate(d) if k != 1 or i >= 60] for i, d in enumerate(docs))


# ---- top-k ----


def brute_topk(rows, k=5, every=50):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = min(v.get(i, x), x)
    v = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in x] for i, x in v.items()}
    out = []
    for q in v:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]
            out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 16, 50])
def test_topk_equals_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(exact_topk, "CELL", 120)
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(0, 1, dims).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(500, 520)] + [(600, None), (650, [float("nan")] * dims), (601, [None] * dims), (None, rows[0][1]), (700, rows[0][1]), (700, rows[1][1]), (602, [float("inf")] * dims), (750, [1.0] * (dims + 1)), (751, [2.0] * (dims + 1))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, cell int")
    assert sorted(map(tuple, exact_topk.exact_topk(df).collect())) == brute_topk(rows)
    assert exact_topk.exact_topk(df.limit(0)).count() == 0


def test_topk_huge_numbers_and_empty_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0]), (50, []), (51, []), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, exact_topk.exact_topk(df).collect())) == brute_topk(rows)


# ---- pipeline ----


EDGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[1:])
def test_pipeline_stages_on_edges(spark, name, stage):
    """Nulls in any column, empty, long and repeated texts; extra columns of clashing names go; empty tables."""
    sf = "/root/testdata/sf0.001"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, "word " * 60_000, None, "s", None), (4, None, "en", "s", 1), (5, "\n\n", "en", "s", 2)]
    docs = spark.createDataFrame([(*r, 7, b"x", "y") for r in rows], EDGE_COLUMNS + ", node int, hash binary, places string")
    out = stage(spark, docs.select(*corpus_pipeline.COLUMNS) if name == "bpe" else docs, sf)
    if name != "bpe":
        assert out.columns == corpus_pipeline.COLUMNS
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    # Empty and null texts are alike, and of equal rows one stays; the least id, null before all, is kept.
    assert ids == (["1", "3", "None"] if name == "near_duplicates" else ["1", "1", "2", "3", "4", "5", "None"])
    assert stage(spark, spark.createDataFrame([], EDGE_COLUMNS), sf).count() == 0


def test_language_stage_on_edges(spark):
    """Texts without letters go; without a language to learn, or texts to learn from, all documents stay."""
    stage = dict(corpus_pipeline.STAGES)["language"]
    en = "The quick brown fox jumps over the lazy dog and runs into the woods. "
    rows = [(i, en * 3, "en", "s", 5) for i in range(20)] + [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, "1 2 3", None, None, None), (None, en, None, "s", 1)]
    out = [r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, EDGE_COLUMNS), "").collect()]
    assert sorted(map(str, out)) == sorted(["None", *map(str, range(20))])
    for unlabelled in ([(i, en, None, "s", 5) for i in range(3)], [(i, None, "en", "s", 5) for i in range(3)], [(2, "", "en", "s", 0)]):
        assert stage(spark, spark.createDataFrame(unlabelled, EDGE_COLUMNS), "").count() == len(unlabelled)
    assert stage(spark, spark.createDataFrame([], EDGE_COLUMNS), "").count() == 0


def test_pipeline_stages(spark):
    """Every stage on what the one before kept: columns, and decisions against brute force."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [set(shingles(words(r["text"]), 5)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf).cache()
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name != "bpe":
            assert out.columns == docs.columns
        sets = {i: set(shingles(words(t), 5)) for i, t in before.items()} if name in ("near_duplicates", "decontamination") else {}
        if name == "language":
            assert len(ids) >= 0.99 * len(before)
        if name == "lines":
            assert len(ids) == len(before) and all(set(r["text"].split("\n")) <= {*before[r["doc_id"]].split("\n"), ""} for r in out.collect())
        if name == "near_duplicates":
            by = {}
            for i, s in sets.items():
                for x in s:
                    by.setdefault(x, []).append(i)
            pairs = {(a, b) for v in by.values() if len(v) < 50 for a in v for b in v if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
            caught = sum(not {a, b} <= set(ids) for a, b in pairs)
            assert caught >= 0.97 * len(pairs)
            linked = {i for p in pairs for i in p}
            gone = set(before) - set(ids)
            assert all(i in linked or len(sets[i]) <= 1 for i in gone)
        if name == "decontamination":
            assert set(ids) == {i for i, s in sets.items() if not any(b and len(b & s) >= 0.8 * len(b) for b in bench)}
        if name == "bpe":
            import hashlib

            assert set(ids) == set(before) and all(r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() for r in out.collect())
        docs = out


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """The driver plans every round, so no plan may hold the edges many times; stars take no round at all."""
    plans, written = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, *a))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 120)] + [(7, 7), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert len(plans) > 1 and max(p.count("Relation [") for p in plans[1:]) <= 2
    plans.clear()
    assert simhash.components(spark.createDataFrame([(i, 100) for i in range(101, 120)], "a long, b long")).count() == 20
    assert len(plans) == 1
