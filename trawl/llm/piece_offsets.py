"""SentencePiece encoding that keeps track of where each piece comes from, and decoding.

A text is normalised by the longest prefix that the model's compiled character map holds, one step after
another; each step notes where in the source it began. Merges run on the normalised text, and the piece
ends they leave are projected through those notes to bytes of the original text. So every piece has a
span, the spans follow one another, and those of a whole text cover it.

The compiled map is a double-array trie: 32-bit units, then the replacements, each ended by a zero byte.
Models with the BPE algorithm and without user-defined pieces are read; others are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, slices, table

#: How a normalised text writes a space.
MARK = "▁"
#: Kinds of piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Bytes of text that are encoded at a time, and chunks that a worker remembers; beyond it they are forgotten.
SLICE_BYTES, MAX_CHUNKS = 1 << 22, 400_000
#: Symbols up to which each merge is found by looking at all pairs; longer chunks keep a heap.
FEW_SYMBOLS = 24
#: The rank of a pair that is no piece.
NEVER = float("inf")


def fields(message: bytes):
    """(field number, value) of a protocol-buffer message: integers, or bytes for all other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            x = message[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """Replacements of the longest prefix, from a compiled map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest known prefix of data[at:] takes, and what replaces them."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _utf8_size(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    """Source text to normalised text with its alignment, by a model's normaliser settings."""

    def __init__(self, spec: bytes):
        found = dict(fields(spec))
        self.map = CharacterMap(found.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(found.get(k, 1)) for k in (3, 4, 5))

    @property
    def plain(self) -> bool:
        """Only spaces change, each by itself: what lies between spaces can be normalised apart."""
        return not self.map.units and not self.trim and self.escape

    def __call__(self, text: str, prefix: bool = True) -> tuple[str, list[int] | range]:
        """Normalised text, and for each of its characters and for its end the source byte where it begins.

        prefix: adds the model's leading space, which comes from no byte.
        """
        if self.plain:
            # A prefix of one known byte or character each: the map is the identity beside the space.
            norm = text.replace(" ", MARK)
            starts = range(len(text) + 1) if text.isascii() else [0, *accumulate([len(c.encode()) for c in text])]
            return (MARK + norm, [0, *starts]) if prefix and self.dummy_prefix and text else (norm, starts)
        data, space = text.encode(), MARK if self.escape else " "
        parts: list[tuple[str, int]] = []
        at = 0
        while self.trim and at < len(data):
            size, new = self._step(data, at)
            if new != " ":
                break
            at += size
        if at == len(data):
            return "", [0]
        if prefix and self.dummy_prefix:
            parts.append((space, at))
        after_space = self.trim
        while at < len(data):
            size, new = self._step(data, at)
            if after_space:
                new = new.lstrip(" ")
            if new:
                parts += [(space if c == " " else c, at) for c in new]
                after_space = self.trim and new.endswith(" ")
            at += size
        while self.trim and parts and parts[-1][0] == space:
            at = parts.pop()[1]
        return "".join(c for c, _ in parts), [*(i for _, i in parts), at]

    def _step(self, data: bytes, at: int) -> tuple[int, str]:
        known = self.map.longest(data, at)
        if known is not None:
            return known[0], known[1].decode()
        size = _utf8_size(data[at])
        return size, data[at : at + size].decode()


class Pieces:
    """A model: merges on normalised text, projection of the pieces, and decoding."""

    def __init__(self, model: bytes):
        trainer = normalizer = b""
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        for field, value in fields(model):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = value
            elif field == 3:
                normalizer = value
        settings = dict(fields(trainer))
        if settings.get(3, 1) != 2 or settings.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models with leading space marks and without user-defined or unused pieces are read")
        self.normalizer = Normalizer(normalizer)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        #: The smaller, the sooner a pair becomes this piece.
        self.order = {p: -scores[i] for p, i in self.ids.items()}
        self.reserved = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k != NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = (self.reserved[settings.get(k, d).decode() if k in settings else d] for k, d in ((46, "<s>"), (47, "</s>")))
        self.unknown_text = settings[44].decode() if 44 in settings else " ⁇ "
        self.byte_ids = [self.reserved[f"<0x{b:02X}>"] for b in range(256)] if settings.get(35, 0) else None
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids or [])}
        #: Ids whose piece is not their text.
        self.spelled = frozenset(self.reserved.values())
        #: Merges never cross the border before a mark if no piece holds a mark after another character.
        self.separable = not any(b == MARK != a for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.chunks: dict[str, tuple[bytes, bytes, bytes]] = {}

    # ---- encoding ----

    def merged(self, norm: str) -> list[str]:
        """The pieces of a normalised text: always the pair whose piece has the best score, the leftmost of equals."""
        order = self.order
        if norm in order and len(norm) == 1:
            return [norm]
        symbols = list(norm)
        if len(symbols) > FEW_SYMBOLS:
            return self._merged_by_heap(symbols)
        get = order.get
        ranks = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(pair + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + pair, NEVER)
        return symbols

    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        order, n = self.order, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            rank = order.get(symbols[i] + symbols[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two was merged otherwise
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]

    def projected(self, norm: str, starts) -> tuple[list[int], list[int]]:
        """Ids of a normalised text, and the source byte where each ends. All but the last of a character's bytes end where it begins."""
        ids, ends, at = [], [], 0
        known, spelled = self.ids, self.byte_ids
        for piece in self.merged(norm):
            begin, at = starts[at], at + len(piece)
            i = known.get(piece)
            if i is not None:
                ids.append(i)
                ends.append(starts[at])
            elif spelled is not None:
                raw = piece.encode("utf-8", "replace")
                ids += [spelled[b] for b in raw]
                ends += [begin] * (len(raw) - 1) + [starts[at]]
            elif ids and ids[-1] == self.unknown:
                ends[-1] = starts[at]
            else:
                ids.append(self.unknown)
                ends.append(starts[at])
        return ids, ends

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a whole text, without begin and end, and the byte of the text where each piece ends."""
        norm, starts = self.normalizer(text)
        return self.projected(norm, starts)

    # ---- decoding ----

    def decode(self, ids, first: bool = True) -> str:
        """The text of ids. first: they begin a text, whose leading space was added and goes."""
        out: list[str] = []
        raw = bytearray()
        strip, trim = first and (self.normalizer.dummy_prefix or self.normalizer.trim), self.normalizer.trim
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_characters(raw))
                raw.clear()
                strip = False
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == UNKNOWN:
                out.append(self.unknown_text)
                strip = False
                continue
            piece = self.pieces[i]
            if strip and piece.startswith(MARK):
                piece = piece[1:]
                strip = trim
            if piece:
                strip = False
            out.append(piece.replace(MARK, " "))
        return "".join(out) + _characters(raw)

    # ---- columns ----

    def chunk(self, source: str) -> tuple[bytes, bytes, bytes]:
        """ids, ends (32-bit integers) and decoded bytes of what lies between two borders, as it stands in a text."""
        ids, ends = self.projected(*self.normalizer(source, prefix=False))
        if self.spelled.isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        else:
            text = self.decode(ids, first=False)
        return array("I", ids).tobytes(), array("I", ends).tobytes(), text.encode("utf-8", "replace")

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview, np.ndarray]:
        """Of all texts, one after another: ids, piece ends (bytes of their own text), how many each text has,
        the decoded bytes, and how many of them each text has.

        Where only spaces change and merges do not cross them, texts are cut before each run of spaces,
        and each distinct chunk is normalised, merged, projected and decoded once.
        """
        texts = pc.fill_null(texts, "")
        whole = not (self.normalizer.plain and self.separable and self.normalizer.dummy_prefix)
        odd = np.ones(len(texts), bool) if whole else pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._one_by_one(texts, odd)
        cut = pc.split_pattern(texts, " ")
        flat, offsets = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # A chunk ends at each word, and at a text's end: the empty strings before it are spaces, as is the added one.
        last = np.zeros(len(flat), bool)
        last[offsets[1:] - 1] = True
        ends = np.flatnonzero((pc.binary_length(flat).to_numpy() > 0) | last)
        text_of = np.searchsorted(offsets, ends, "right") - 1
        lead = np.diff(ends, prepend=-1)
        first = np.concatenate([[True], text_of[1:] != text_of[:-1]]) if len(ends) else np.zeros(0, bool)
        lead[first] = ends[first] - offsets[text_of[first]] + 1
        kept = pc.binary_length(texts).to_numpy()[text_of] > 0
        ends, text_of, lead = ends[kept], text_of[kept], lead[kept]
        words = flat.take(pa.array(ends)).dictionary_encode()
        names, unit = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        size = pc.binary_length(words.dictionary).to_numpy().astype(np.int64)[unit] + lead
        keys = [" " + w for w in names]
        wide = np.flatnonzero(lead > 1)
        if len(wide):
            more = {}
            for i, w, n in zip(wide.tolist(), unit[wide].tolist(), lead[wide].tolist(), strict=True):
                unit[i] = more.setdefault((w, n), len(names) + len(more))
            keys += [" " * n + names[w] for w, n in more]
        if len(self.chunks) >= MAX_CHUNKS:
            self.chunks.clear()
        known, chunk = self.chunks, self.chunk
        found = list(map(known.get, keys))
        for i, value in enumerate(found):
            if value is None:
                found[i] = known[keys[i]] = chunk(keys[i])
        stream = pa.array(unit)
        ids, local, decoded = (pa.array([f[k] for f in found], pa.binary()).take(stream) for k in range(3))
        n_units = pc.binary_length(ids).to_numpy() // 4
        begun = np.cumsum(size) - size  # of each chunk, among all chunks
        chunks = np.bincount(text_of, minlength=len(texts))
        at = np.cumsum(chunks) - chunks
        base = np.append(begun, size.sum())[at]
        # The added space is no byte of the text.
        shift = begun - base[text_of] - 1
        spans = _flat(local, "<u4").astype(np.int64) + np.repeat(shift, n_units)
        counts = np.bincount(text_of, n_units, len(texts)).astype(np.int64)
        n_bytes = np.bincount(text_of, pc.binary_length(decoded).to_numpy(), len(texts)).astype(np.int64)
        # Each text's first decoded byte is the added space.
        out = _flat(decoded, np.uint8)
        if len(out):
            keep = np.ones(len(out), bool)
            keep[(np.cumsum(n_bytes) - n_bytes)[n_bytes > 0]] = False
            out = out[keep]
        return _flat(ids, "<u4"), spans, counts, memoryview(out), np.maximum(n_bytes - 1, 0)

    def _one_by_one(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview, np.ndarray]:
        """As columns, for texts some of which have to be encoded whole."""
        parts, at = [], 0
        borders = [0, *(np.flatnonzero(odd[1:] | odd[:-1]) + 1).tolist(), len(texts)]
        for at, to in zip(borders, borders[1:], strict=False):
            if not odd[at]:
                parts.append(self.columns(texts.slice(at, to - at)))
                continue
            for text in texts.slice(at, to - at).to_pylist():
                ids, ends = self.encode(text)
                raw = self.decode(ids).encode("utf-8", "replace")
                parts.append((np.array(ids, "<u4"), np.array(ends, np.int64), np.array([len(ids)]), memoryview(raw), np.array([len(raw)])))
        ids, ends, counts, raw, sizes = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(ends), np.concatenate(counts), memoryview(b"".join(raw)), np.concatenate(sizes)


def _flat(column: pa.Array, kind) -> np.ndarray:
    """The bytes of a binary column, one after another."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind) if data is not None and len(bounds) else np.zeros(0, kind)


def _characters(raw: bytes) -> str:
    """UTF-8; each byte that is part of no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            size = _utf8_size(raw[at])
            try:
                out.append(bytes(raw[at : at + size]).decode())
            except UnicodeDecodeError:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


_models: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """One model a worker process, shared by its tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model)
    return _models[key]


def _encoded(docs: DataFrame, model_file: str, id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    """rows(model, ids, ends, texts' bounds in them, decoded bytes, texts' bounds in those) gives the columns after id_col."""
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB at most
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        pieces = loaded(model.value)
        for batch in batches:
            for cut in slices(batch, 1, SLICE_BYTES):
                ids, ends, counts, raw, sizes = pieces.columns(cut.column(1))
                columns = rows(pieces, ids, ends, np.append(0, np.cumsum(counts)).tolist(), raw, np.append(0, np.cumsum(sizes)).tolist())
                arrays = [cut.column(0).cast(out[0].type), *(pa.array(c, type=f.type) for c, f in zip(columns, list(out)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def piece_encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the bytes of it that each piece stands for.

    Returns doc_id, ids, starts and ends (of the ids' spans in the UTF-8 text, end exclusive). Begin and
    end ids are not among them. Of the ids that spell a character by its bytes the last has its span, the
    others an empty one. A null text counts as empty and has no ids. Null and repeated doc_ids keep their
    rows; other columns are ignored; an empty table gives no rows.
    """

    def rows(pieces, ids, ends, at, raw, raw_at):
        cut = [(a, b) for a, b in zip(at, at[1:], strict=False)]
        return [ids[a:b] for a, b in cut], [np.append(0, ends[a : b - 1]) if b > a else ends[a:b] for a, b in cut], [ends[a:b] for a, b in cut]

    return _encoded(docs, model_file, id_col, text_col, f"{id_col} long, ids array<int>, starts array<long>, ends array<long>", rows)


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What piece_encode and piece_decode give for every whole text, as digests, without moving the ids.

    Returns doc_id, n_tokens (begin and end ids counted), ids_sha256 (of all ids as little-endian 32-bit
    integers), decoded_sha256 (of the decoded text's bytes) and ends_sha256 (of the piece ends as
    little-endian 64-bit integers). Nulls and other columns as in piece_encode: a null text has two ids.
    """

    def rows(pieces, ids, ends, at, raw, raw_at):
        sha256, cut = hashlib.sha256, list(zip(at, at[1:], strict=False))
        first, last = np.array([pieces.begin], "<u4").tobytes(), np.array([pieces.end], "<u4").tobytes()
        id_bytes, end_bytes = memoryview(ids).cast("B"), memoryview(ends.astype("<i8")).cast("B")
        digests = []
        for a, b in cut:
            digest = sha256(first)
            digest.update(id_bytes[4 * a : 4 * b])
            digest.update(last)
            digests.append(digest.hexdigest())
        return [b - a + 2 for a, b in cut], digests, [sha256(raw[a:b]).hexdigest() for a, b in zip(raw_at, raw_at[1:], strict=False)], [sha256(end_bytes[8 * a : 8 * b]).hexdigest() for a, b in cut]

    return _encoded(docs, model_file, id_col, text_col, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string", rows)


def piece_decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids, begin and end ids among them or not. Null ids count as none: an empty text.

    Ids that spell bytes become characters; a byte that is part of none becomes U+FFFD, as does every byte
    of a character cut short. An id that the model lacks, or a null one, fails.
    """
    with open(model_file, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def start():
        pieces = loaded(model.value)
        return lambda rows: [(doc_id, pieces.decode(ids or [])) for doc_id, ids in rows]

    return map_arrow(encoded.select(id_col, ids_col), f"{id_col} long, text string", start, rows=128)


def op11_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces; a null text is empty: begin and end ids alone, decoded to nothing."""
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
