"""SentencePiece encoding with spans against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import public_tokenizers as P
from trawl.llm import piece_offsets as O

MODEL = P.path("piece_bpe_32k.model")
MADE = ["", " ", "  ", "a", " a", "a ", "  a  b ", "▁a b", "a ▁▁ b", "ab▁", "\n\n x\t y", "\0x \x00", "<s> </s> <unk> <0x0A>", "😀é汉字 ‍ ☃", "a" * 3000, " " * 700 + "x", "né " * 300, "é ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as f:
        return O.Pieces(f.read())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    letters = " ▁ab theéß\n.,汉😀́\0"
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return MADE + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + given


def test_columns_equal_the_library(library, pieces, texts):
    for some in (texts, [t for t in texts if O.MARK not in t], ["", ""], []):
        ids, ends, counts, raw, sizes = pieces.columns(pa.array(some, pa.string()))
        at, byte = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(sizes))
        for k, text in enumerate(some):
            expected = library.encode(text)
            assert ids[at[k] : at[k + 1]].tolist() == expected, text
            assert bytes(raw[byte[k] : byte[k + 1]]).decode() == library.decode(expected)
            whole = pieces.encode(text)
            assert whole == (expected, ends[at[k] : at[k + 1]].tolist())
            assert not expected or whole[1][-1] == len(text.encode())


def test_spans_equal_the_library(library, pieces, texts):
    for text in texts[:800]:
        proto = library.encode(text, return_type="proto")
        ends = pieces.encode(text)[1]
        assert [p.end for p in proto.pieces] == ends
        assert [p.begin for p in proto.pieces] == [0, *ends][: len(ends)]


def test_decoding_any_ids_equals_the_library(library, pieces):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 29871, 259, 1, 2, 0]) for _ in range(rng.randint(0, 9))]
        assert pieces.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [(True, True), (True, False), (False, True), (False, False)])
def test_compiled_map_equals_the_library(rule, flags):
    prefix, trim = flags
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim)
    own = O.Normalizer(library.serialized_normalizer_spec())
    rng = random.Random(7)
    letters = "  AbＡＢ㍿½é́\t　ﬁÄ ｶﾞ​漢▁"
    for text in ["  ＡＢ ㍿ ½é\tx  ", "", "   ", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(500))]:
        norm, offsets = library.normalize(text, with_offsets=True)
        got, starts = own(text)
        assert got == norm, text
        assert [len(text.encode()[:i].decode("utf-8", "ignore")) for i in starts] == offsets


def test_models_that_are_refused(pieces):
    with open(MODEL, "rb") as f:
        data = f.read()
    with pytest.raises(ValueError):
        O.Pieces(data + b"\x0a\x05\x0a\x01x\x18\x04")  # one more piece, user-defined


def test_operator(spark, library):
    clashing = "doc_id long, text string, ids string, starts int, ends double, n_tokens string"
    rows = [(i, t, "x", 1, 1.0, "y") for i, t in enumerate(MADE)] + [(1, "same", None, None, None, None)] * 2 + [(None, "no id", None, None, None, None), (7, None, None, None, None, None), (8, "word " * 60_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, clashing).repartition(3)
    out = O.piece_encode(docs, MODEL).collect()
    assert len(out) == len(rows)
    expected = sorted((i is None, i or 0, library.encode(t or "")) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in out) == expected
    for r in out:
        assert r["starts"] == [0, *r["ends"]][: len(r["ids"])]
    back = O.piece_decode(O.piece_encode(docs, MODEL), MODEL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((i is None, i or 0, (t or "").replace(O.MARK, " ")) for i, t, *_ in rows)
    digests = {r["doc_id"]: r for r in O.piece_digests(docs.where("doc_id > 8"), MODEL).collect()}
    for i, t in enumerate(MADE):
        if i > 8:
            ids = library.encode(t, add_bos=True, add_eos=True)
            assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert digests[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert O.piece_encode(docs.limit(0), MODEL).count() == O.piece_digests(docs.limit(0), MODEL).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in O.piece_decode(none, MODEL).collect()] == ["", ""]
