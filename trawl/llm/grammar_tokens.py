"""Token ids in files compressed by a Re-Pair grammar, shard by shard.

Documents are dealt by ranges of doc_id and encoded in that order. A shard holds the ids of
consecutive documents. The most frequent adjacent pairs of a shard are replaced by nonterminals,
round by round, until no pair is frequent enough; pairs never span two documents. A shard's row in
the file holds the rules (each a pair of symbols), the length of each rule's expansion, the remaining
symbols, and for each document its first symbol and number of ids, so one document is decoded without
its neighbours.

The files are Parquet, written and read by Spark, with one row a shard:

    part int, seq int         place of the shard: range partition, and order in it
    start_in_part long        ids before the shard in its partition
    doc_ids array<long>       documents in order
    doc_tokens array<int>     ids of each
    doc_at array<int>         first symbol of each
    rules array<int>          left and right symbol of each nonterminal, in turn
    lengths array<int>        ids that each nonterminal stands for
    base int                  first nonterminal; smaller symbols are ids
    width int                 bytes of a symbol, 2 or 4
    symbols binary            little-endian
"""

from __future__ import annotations

import os
import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, shared_dir, slices, table

#: Ids a shard holds before it is closed, and bytes of text that are encoded at a time.
SHARD_TOKENS, SLICE_BYTES = 1 << 21, 1 << 22
#: Occurrences a pair needs. A round replaces the more frequent half of such pairs, at least
#: PER_ROUND if there are; the rest wait for the next.
PER_ROUND, MIN_COUNT = 2048, 24
#: Encoded words that a worker remembers; beyond it they are forgotten.
MAX_WORDS = 500_000
END_ID = 1
_SCHEMA = (
    "part int, seq int, start_in_part long, doc_ids array<long>, doc_tokens array<int>, doc_at array<int>, "
    "rules array<int>, lengths array<int>, base int, width int, symbols binary"
)


def _sorted_pairs(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in ascending order with their places, equal ones by place. Places are ascending."""
    bits = int(place[-1]).bit_length()
    if int(code.max()).bit_length() + bits > 64:  # only in shards of one enormous document
        order = np.argsort(code, kind="stable")
        return code[order], place[order]
    both = np.sort(code << np.uint64(bits) | place.astype(np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one shard: symbols, place of each document's last symbol, rules (n, 2), expansion lengths.

    ids: the shard's ids; ends: place of each document's last id. Of overlapping occurrences the first
    of each run is replaced, then every other one. A pair that is too rare stays so, as only pairs with
    a new nonterminal can gain occurrences; so a round counts those beside the last round's
    replacements and the frequent ones that still wait, not the whole shard again. It ends when no
    pair occurs MIN_COUNT times.
    """
    n = len(ids)
    seq = np.append(ids, 0).astype(np.uint64)
    # Places are linked over those swallowed; n stands for none.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends] = n
    before[np.append(0, ends + 1)] = n
    alive = np.arange(n + 1) < n
    rules, lengths = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    live = np.flatnonzero(after[:n] < n)
    while len(live):
        shift = np.uint64((base + len(lengths)).bit_length())
        code, place = _sorted_pairs(seq[live] << shift | seq[after[live]], live)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        counts = np.diff(np.append(first, len(code)))
        frequent = counts >= MIN_COUNT
        waiting = np.sort(counts[frequent])
        if not len(waiting):
            break
        chosen = counts >= waiting[-min(len(waiting), max(PER_ROUND, len(waiting) // 2))]
        rule = np.full(n, -1, np.int32)
        picked = np.repeat(chosen, counts)
        rule[place[picked]] = np.repeat(np.arange(chosen.sum()), counts[chosen])
        at = np.flatnonzero(rule >= 0)
        run = np.concatenate([[True], at[1:] != after[at[:-1]]])
        begins = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begins) % 2 == 0]
        seq[at] = (rule[at] + base + len(lengths)).astype(np.uint64)
        alive[after[at]] = False
        after[at] = after[after[at]]
        before[after[at]] = at
        changed = np.zeros(n + 1, bool)
        changed[place[np.repeat(frequent & ~chosen, counts)]] = True
        changed[at] = True
        changed[before[at]] = True
        live = np.flatnonzero(changed & alive)
        live = live[after[live] < n]
        pairs = code[first[chosen]]
        both = np.column_stack([pairs >> shift, pairs & np.uint64((1 << int(shift)) - 1)]).astype(np.int64)
        size = np.ones(both.shape, np.int64)
        inner = both >= base
        size[inner] = lengths[both[inner] - base]
        rules.append(both)
        lengths = np.append(lengths, size.sum(1))
    return seq[alive].astype(np.uint32), np.cumsum(alive)[ends] - 1, np.concatenate(rules), lengths


class Grammar:
    """Decoder of one shard's symbols."""

    def __init__(self, rules, lengths, base: int):
        self.base = base
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.empty(self.starts[-1], np.uint32)
        both = np.asarray(rules, np.int64).reshape(-1, 2)
        # Rules whose symbols are ids or earlier rules are expanded together.
        newest, done = np.maximum.accumulate(both.max(1)) if len(both) else both, 0
        while done < len(both):
            to = int(np.searchsorted(newest, base + done))
            self.flat[self.starts[done] : self.starts[to]] = self.expand(both[done:to].ravel())
            done = to

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        inner = np.flatnonzero(symbols >= self.base)
        rule = symbols[inner].astype(np.int64) - self.base
        size = np.ones(len(symbols), np.int64)
        size[inner] = self.lengths[rule]
        out = np.repeat(symbols.astype(np.uint32), size)
        if len(inner):
            # Places of the nonterminals' ids in the output, and where in `flat` each comes from.
            run = size[inner]
            within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
            out[within + np.repeat((np.cumsum(size) - size)[inner], run)] = self.flat[within + np.repeat(self.starts[rule], run)]
        return out


def decode_document(shard, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard's row, by random access."""
    symbols = np.frombuffer(shard["symbols"], f"<u{shard['width']}")
    at = [*shard["doc_at"], len(symbols)]
    return Grammar(shard["rules"], shard["lengths"], shard["base"]).expand(symbols[at[k] : at[k + 1]])


#: Chunks whose pieces are plain to see: Latin letters, and a full stop or comma at the end.
_SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes columns of texts with the tokenizers library, each distinct word once.

    The normaliser and the splitter never join what a space or newline separates, so a text's ids
    are those of its chunks, one after another. Simple chunks go straight to the library's model,
    lower-cased and in byte letters as the library's own steps would hand them on; the rest go
    through all its steps. Cutting, finding what is distinct and putting the ids in order are
    columnar.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        self.letters = "".join(byte_letters())
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        # Simple chunks are only taken apart here if the vocabulary's steps do just that.
        self.simple = True
        probe = ["Der", "ÉÈ,", "ñandú.", "ÿß"]
        ids, sizes = self.encode(pa.array(probe))
        self.simple = ids.tobytes() == b"".join(self.whole(probe))

    def whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def model_ids(self, words: list[str]) -> list[bytes]:
        out, tokenize, letters = [], self.model.tokenize, self.letters
        for w in words:
            raw = w if w.isascii() else charmap_decode(w.encode(), "strict", letters)[0]
            out.append(array("I", [t.id for t in tokenize(raw)]).tobytes())
        return out

    @staticmethod
    def looked_up(keys: pa.Array, known: dict[str, bytes], encode) -> list[bytes]:
        if len(known) >= MAX_WORDS:
            known.clear()
        names = keys.to_pylist()
        found = list(map(known.get, names))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, encode([names[i] for i in new]), strict=True):
            found[i] = known[names[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. A null text has none."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = cut.flatten().dictionary_encode()
        names = chunks.dictionary
        simple = pc.and_(pc.match_substring_regex(names, _SIMPLE), self.simple).to_numpy(zero_copy_only=False)
        bare = pc.utf8_rtrim(names.filter(pa.array(simple)), ".,")
        bare = pc.utf8_lower(bare).dictionary_encode()
        rest = names.filter(pa.array(~simple))
        # Units: nothing, full stop, comma, words, other chunks. A chunk has two, the second for its sign.
        units = [b"", *self.looked_up(pa.array([".", ","]), self.words, self.model_ids), *self.looked_up(bare.dictionary, self.words, self.model_ids)]
        unit = np.zeros((len(names), 2), np.int64)
        unit[simple, 0] = bare.indices.to_numpy() + 3
        unit[:, 1] = np.where(simple, pc.add(pc.cast(pc.ends_with(names, "."), "int8"), pc.multiply(pc.cast(pc.ends_with(names, ","), "int8"), 2)).to_numpy(), 0)
        unit[~simple, 0] = len(units) + np.arange(len(rest))
        units += self.looked_up(rest, self.others, self.whole)
        size = np.fromiter(map(len, units), np.int64, len(units)) // 4
        pool = np.frombuffer(b"".join(units), "<u4")
        stream = unit[chunks.indices.to_numpy()].ravel()
        n = size[stream]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = pool[np.repeat((np.cumsum(size) - size)[stream] - (stop - n), n) + np.arange(total)]
        places = (cut.offsets.to_numpy() - cut.offsets[0].as_py()) * 2
        return ids, np.diff(np.append(0, stop)[places])


def _encoder(data: bytes):
    """One encoder a worker process."""
    key = zlib.crc32(data), len(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key].encode


_encoders: dict[tuple, Encoder] = {}


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of every text, end_id after each document, in ascending doc_id order.

    A null text counts as empty (end_id alone). Null doc_ids come first; rows that repeat a doc_id
    are ordered by text. Other columns are ignored; an empty table gives files without shards.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB at most
    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def run(batches):
        from pyspark import TaskContext

        encode = _encoder(model.value)
        part, seq, written = TaskContext.get().partitionId(), 0, 0
        ids, pieces, sizes, total = [], [], [], 0

        def flush():
            nonlocal seq, written, ids, pieces, sizes, total
            counts, flat = np.concatenate(sizes), np.concatenate(pieces)
            base = max(1 << 15, int(flat.max()) + 1)
            symbols, ends, rules, lengths = compress(flat, np.cumsum(counts) - 1, base)
            width = 2 if base + len(lengths) <= 1 << 16 else 4
            at = np.concatenate([[0], ends[:-1] + 1])
            row = [part, seq, written, ids, counts, at, rules.ravel(), lengths, base, width, symbols.astype(f"<u{width}").tobytes()]
            batch = pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
            seq, written = seq + 1, written + total
            ids, pieces, sizes, total = [], [], [], 0
            return batch

        for batch in batches:
            for cut in slices(batch, 1, SLICE_BYTES):
                new, counts = encode(cut.column(1))
                ids += cut.column(0).to_pylist()
                pieces.append(np.insert(new, np.cumsum(counts), np.uint32(end_id)))
                sizes.append(counts + 1)
                total += len(pieces[-1])
                if total >= SHARD_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the little-endian ids), from the files."""
    shards = spark.read.schema(_SCHEMA).parquet(path)
    size = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row for each range partition, however many shards and documents there are.
    totals = sorted((r["part"], r["n"]) for r in shards.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part], total = total, total + n

    def start():
        def work(rows):
            out = []
            for part, begun, doc_ids, sizes, at, rules, lengths, base, width, symbols in rows:
                ids = Grammar(rules, lengths, base).expand(np.frombuffer(symbols, f"<u{width}")).astype("<u4")
                place, first = before[part] + begun, 0
                for doc_id, n in zip(doc_ids, sizes, strict=True):
                    out.append((doc_id, place, n, zlib.crc32(ids[first : first + n].tobytes())))
                    place, first = place + n, first + n
            return out

        return work

    columns = ["part", "start_in_part", "doc_ids", "doc_tokens", "doc_at", "rules", "lengths", "base", "width", "symbols"]
    return map_arrow(shards.select(*columns), "doc_id long, start long, n_tokens long, ids_crc32 long", start, rows=1)


def op2_grammar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and crc32 of each document's ids, from the files; a null text has the end id alone."""
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path)
