"""Phrases that occur more often than their parts suggest, by the stripes pattern.

A stripe belongs to a prefix, a run of 0 to 3 words of a language, and counts the words that follow it.
Tasks count stripes of their own texts, which are merged element by element. A merged stripe is held as
rows (lang, prefix, next, n), as that of a frequent word has no bound. All that is asked for is read from
these: a phrase's count is an element, that of a cut's parts too (an element of a shorter prefix's stripe),
and the greatest count of the phrases one word longer is a maximum over a stripe, or over those elements
whose words end in the phrase.

Stripes grow by one word a round. A phrase cannot be frequent unless both of its parts that are one word
shorter are: these go into a filter of bounded size, which lets a few others through and none of them is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import saved, slices, table

#: What ends a piece of text, and what else divides words. BREAK is no word, as it would end a piece.
PIECE_ENDS, BREAK = r"[.,;:!?\n\x0B\f\r]", "."
#: Most words of a phrase, least occurrences, percent of them at which a longer phrase stands for a shorter, phrases reported a language.
WORDS, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
SLICE_BYTES = 3 << 20
#: Bits of a filter for each phrase it holds, and of any filter.
BITS_EACH, MAX_BITS = 16, 1 << 27
#: Parts into which each language is cut for its first ranking.
RANK_PARTS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases made one word longer."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _word_hashes(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], np.uint64)


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(37)) & mask).astype(np.int64)


class Filter:
    """Frequent phrases of one length by hash; says yes to each of them, and rarely to another."""

    def __init__(self, blocks: np.ndarray):
        self.blocks, self.size = blocks, 64 * len(blocks)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for bit in _bits(h, self.size):
            out &= (self.blocks[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def _filter(frequent: DataFrame, words: int) -> Filter:
    """Of the phrases of a round: as many bits as they need, MAX_BITS at most."""
    size = 64
    need = BITS_EACH * frequent.count()
    while size < min(need, MAX_BITS):
        size *= 2

    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            tokens = pc.split_pattern(batch.column(1), " ").flatten().dictionary_encode()
            word = _word_hashes(tokens.dictionary)[tokens.indices.to_numpy()].reshape(-1, words)
            h = _mix(word[:, 0] ^ _word_hashes(langs.dictionary)[langs.indices.to_numpy()])
            for k in range(1, words):
                h = _grown(h, word[:, k])
            bit = np.unique(np.concatenate(_bits(h, size)))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(bit & 63)], ["block", "bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "block long, bit long")
    # At most MAX_BITS / 64 rows reach the driver.
    rows = bits.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()
    blocks = np.zeros(size // 64, np.uint64)
    blocks[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Filter(blocks)


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words and breaks of all texts, and the number of the text that each is in."""
    low = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\t", " ")
    cut = pc.split_pattern(pc.replace_substring_regex(low, PIECE_ENDS, f" {BREAK} "), " ")
    flat = cut.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    return flat.filter(there).dictionary_encode(), text[there.to_numpy(zero_copy_only=False)]


def _counted(texts: pa.Array, langs: pa.Array, k: int, seen: Filter | None) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array, np.ndarray]:
    """The stripes of prefixes of k words: lang, prefix, and for all of them on end the next words, their counts, and where each stripe's begin."""
    tokens, text = _tokens(texts)
    names, word = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    lang = langs.dictionary_encode()
    lang_of = lang.indices.to_numpy().astype(np.int64)[text]
    n = len(word)
    # Places where a run of words begins that lies in one piece, and whether its first k and its last k words are frequent.
    runs = word != pc.index(names, BREAK).as_py()
    one = runs
    if k:
        hashed = _word_hashes(names)[word]
        h = _mix(hashed ^ _word_hashes(lang.dictionary)[lang_of])
        for m in range(1, k):
            runs, h = runs[:-1] & one[m:] & (text[m:] == text[: n - m]), _grown(h[:-1], hashed[m:])
        runs = runs & seen(h) if len(h) else runs
        runs = runs[:-1] & runs[1:] & (text[k:] == text[: n - k])
    at = np.flatnonzero(runs)
    # Prefixes are numbered word by word; the last step is counted.
    width = max(1, len(names))
    code = lang_of[at] if len(at) else at
    for m in range(k):
        code = np.unique(code * width + word[at + m], return_inverse=True)[1]
    code, first, counts = np.unique(code * width + word[at + k], return_index=True, return_counts=True)
    place = at[first]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] // width != code[:-1] // width])) if len(code) else np.zeros(0, np.int64)
    head = place[begin]
    parts = [names.take(pa.array(word[head + m])) for m in range(k)]
    prefix = pc.binary_join_element_wise(*parts, " ") if k else pa.array([""] * len(head), pa.string())
    return lang.dictionary.take(pa.array(lang_of[head])), prefix, names.take(pa.array(word[place + k])), pa.array(counts), np.append(begin, len(code))


def _stripes(docs: DataFrame, k: int, seen: Filter | None) -> DataFrame:
    """Stripes of tasks' slices (lang, prefix, counts: a map of next words), from lang and text."""
    schema = to_arrow_schema(StructType.fromDDL("lang string, prefix string, counts map<string,long>"))
    held = docs.sparkSession.sparkContext.broadcast(seen) if seen is not None else None

    def run(batches):
        known = held.value if held is not None else None
        for batch in batches:
            for cut in slices(batch, 1, SLICE_BYTES):
                lang, prefix, words, counts, offsets = _counted(cut.column(1), cut.column(0), k, known)
                counters = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), words, counts.cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([lang, prefix, counters.cast(schema.field(2).type)], schema=schema)

    return docs.mapInArrow(run, "lang string, prefix string, counts map<string,long>")


def stripes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """Merged stripes of prefixes of 0 to words - 1 words: lang, prefix, next, phrase (prefix and next), n.

    The elements that occur `least` times are kept. The stripe of the empty prefix counts all words, and
    its element "" is their number. Counts are per language (null: und). ASCII capitals count as small
    letters; a null text is empty; repeated rows count again; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rounds: list[DataFrame] = []
    seen = None
    for k in range(words):
        elements = _stripes(rows, k, seen).select("lang", "prefix", F.explode("counts").alias("next", "n"))
        # One string is a smaller row to shuffle than three; words hold no newline.
        merged = elements.groupBy(F.concat_ws("\n", "prefix", "next", "lang").alias("key")).agg(F.sum("n").alias("n"))
        if k:
            merged = merged.where(F.col("n") >= least)
        parts = F.split("key", "\n", 3)
        merged = merged.select(parts[2].alias("lang"), parts[0].alias("prefix"), parts[1].alias("next"), "n")
        if k == 0:
            merged = saved(merged)
            every = merged.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("").alias("prefix"), F.lit("").alias("next"), "n")
            merged = merged.where(F.col("n") >= least).unionByName(every)
        phrase = F.col("next") if k == 0 else F.concat_ws(" ", "prefix", "next")
        rounds.append(saved(merged.select("lang", "prefix", "next", phrase.alias("phrase"), "n")))
        if k + 1 < words:
            seen = _filter(rounds[k].where("next <> ''"), k + 1)
    return rounds


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """The best phrases of 2 to `words` words of each language.

    A phrase of a occurrences is cut where a is least beyond what its two parts, with l and r occurrences,
    suggest: score is the floor of 2,000,000 a / (l + r), equal scores go to the shortest first part.
    Phrases inside a longer one that occurs `subsumed` percent as often are dropped; one word more decides
    this, as no phrase is rarer than what holds it. Returns lang, rank (from 1), phrase, a, l, r, n (all
    words of the language), score: `top` phrases a language by score, a, and phrase in byte order. A
    language without such phrases, and an empty table, give no rows.
    """
    rounds = stripes(docs, lang_col, text_col, words, least)
    counted = rounds[0].where("next <> ''")
    for r in rounds[1:]:
        counted = counted.unionByName(r)
    candidates = rounds[1].withColumn("words", F.lit(2))
    for k, r in enumerate(rounds[2:], 3):
        candidates = candidates.unionByName(r.withColumn("words", F.lit(k)))
    # Each element counts towards its own prefix, and towards what is left without the first word.
    longer = candidates.where("words > 2")
    shorter = F.explode(F.array("prefix", F.expr("substr(phrase, instr(phrase, ' ') + 1)")))
    longest = longer.select("lang", shorter.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products may pass 64 bits
    kept = candidates.join(longest, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (exact("longest") * 100 < exact("n") * subsumed))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the best of each of its parts first.
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for by in (["lang", "part"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    every = rounds[0].where("next = ''").select("lang", "n")
    return scored.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language (null: und) of documents; null texts are empty."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split(translate(p, chr(9), ' '), ' '), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), run AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*)::HUGEINT AS n FROM run GROUP BY ALL),
cand AS (SELECT * FROM f WHERE m > 1 AND n >= 30),
inside AS (SELECT DISTINCT s.lang, s.p FROM cand s JOIN cand b ON s.lang = b.lang AND s.m < b.m AND 100 * b.n >= 80 * s.n
  AND (b.p[1:s.m] = s.p OR b.p[2:s.m + 1] = s.p OR (b.m - s.m = 2 AND b.p[3:4] = s.p))),
cut AS (SELECT lang, p, n AS a, m, unnest(range(1, m)) AS k FROM cand ANTI JOIN inside USING (lang, p)),
scored AS (SELECT cut.lang, cut.p, a, k, l.n AS l, r.n AS r, (2000000 * a) // (l.n + r.n) AS score FROM cut
  JOIN f l ON l.lang = cut.lang AND l.m = cut.k AND l.p = cut.p[:k] JOIN f r ON r.lang = cut.lang AND r.m = cut.m - cut.k AND r.p = cut.p[k + 1:]),
best AS (SELECT *, array_to_string(p, ' ') AS phrase FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS c FROM scored) WHERE c = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, e.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang) e USING (lang) WHERE rank <= 2000
"""
