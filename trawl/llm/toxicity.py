"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Folding lower-cases, drops invisible characters, maps look-alike letters of other scripts to Latin
ones and, inside words, digits and signs to the letters they stand for. Lexicon entries are whole
words or word beginnings; their weights are log-odds learned from labelled documents. Exception
phrases, two words one of which is an entry, are learned from labelled documents too: where they are
common in clean texts, a match inside them counts nothing. A text's matched weight, per word and in
all, goes through a logistic function.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, map_arrow, saved, shingles, table

#: Labelled documents of each class that the lexicon is learned from, at most.
FIT_DOCS = 4000
#: Entries kept, at most: those of the strongest evidence.
MAX_ENTRIES = 3000
#: Lengths of the word beginnings tried as entries.
PREFIXES = (3, 4, 5, 6)
#: Evidence an entry needs: the log-likelihood ratio of its documents' labels to all labels, and its log-odds.
MIN_EVIDENCE, MIN_WEIGHT = 12.0, 4.0
#: Log-odds of what is looked at for exception phrases.
LOOSE_WEIGHT = 1.0

# Look-alike letters of Cyrillic, Greek and full-width script.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
_LETTERS = {ord(a): b for a, b in HOMOGLYPHS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_ODD = re.compile("[" + "".join(map(chr, _LETTERS)) + "]")
# Digits and signs written for letters.
_LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_WORD = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[^\W\d_])(?=[\w@$!]*[0-9@$])[\w@$!]*[\w@$]")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words between single spaces, a space at each end."""
    t = text.lower()
    if _ODD.search(t):
        t = t.translate(_LETTERS)
    if _DIGIT_OR_SIGN.search(t):
        t = _LEET_WORD.sub(lambda m: m[0].translate(_LEET) if 2 * sum(map(str.isalpha, m[0])) >= len(m[0]) - 1 else m[0], t)
    return f" {_GAP.sub(' ', t).strip()} "


_DIGIT_OR_SIGN = re.compile("[0-9@$]")


def terms(folded: str) -> set[str]:
    """Candidates for entries: ` word ` and ` begin`."""
    out = set()
    for w in set(folded.split()):
        if len(w) > 1:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


class Lexicon:
    """weights: of entries; exceptions: phrases; coefficients: of the logistic function."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), coefficients=(0.35, 1.5, -1.5)):
        self.weights, self.exceptions, self.coefficients = weights, set(exceptions), tuple(coefficients)
        self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None}

    def automaton(self):
        if self.machine is None and self.weights:
            self.machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.machine.add_word(entry, (len(entry), weight))
            self.machine.make_automaton()
        return self.machine

    def matches(self, folded: str) -> dict[int, float]:
        """Place of each matched word and the greatest weight of its entries, exception phrases left out."""
        found: dict[int, float] = {}
        machine = self.automaton()
        if machine is None:
            return found
        for end, (n, weight) in machine.iter(folded):
            at = end - n + 1
            if weight > found.get(at, 0.0):
                found[at] = weight
        if self.exceptions:
            for at in list(found):
                end = folded.index(" ", at + 1)
                after = folded[at : folded.find(" ", end + 1) + 1] if end + 1 < len(folded) else ""
                before = folded[folded.rfind(" ", 0, at) : end + 1] if at else ""
                if after in self.exceptions or before in self.exceptions:
                    del found[at]
        return found

    def measures(self, text: str | None) -> tuple[float, float]:
        """Matched weight per hundred words (short texts count as 20 words) and its total, both damped."""
        folded = fold(text or "")
        total = sum(self.matches(folded).values())
        return math.log1p(100 * total / max(20, folded.count(" ") - 1)), math.log1p(total)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.measures(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * x + b * y + c))))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a weak prior; classes weighted alike."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (y - p)) - 0.1 * w
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hess, grad), -1, 1)
    return tuple(map(float, w))


def learn(labelled: DataFrame) -> Lexicon:
    """Lexicon from a bounded table of text and toxic (0 or 1).

    Near copies would make all their words look telling, so of texts that share the least hash of
    their five-word shingles one is used.
    """
    spark = labelled.sparkSession

    def keyed():
        def work(rows):
            out = []
            for text, toxic in rows:
                f = fold(text or "")
                hashes = sorted(xxhash.xxh64_intdigest(s) >> 1 for s in set(shingles(f.split(), 5)))
                out.append((f, toxic, hashes[0] if hashes else 0, hashes[1] if len(hashes) > 1 else 0))
            return out

        return work

    sample = map_arrow(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), "folded string, toxic int, k1 long, k2 long", keyed)
    # Of texts with a key in common the least counts, so that every run learns the same.
    for key in ("k1", "k2"):
        sample = sample.groupBy(key).agg(F.min(F.struct("folded", "toxic", "k1", "k2")).alias("row")).select("row.*")
    sample = saved(sample)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})

    def counted(candidates):
        def start():
            def work(rows):
                counts: Counter = Counter()
                for folded, toxic in rows:
                    counts.update((t, toxic) for t in candidates(folded))
                return [(t, v if y else 0, 0 if y else v) for (t, y), v in counts.items()]

            return work

        each = map_arrow(sample.select("folded", "toxic"), "term string, t long, c long", start, rows=4096)
        return each.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    def weighed(counts: DataFrame, least: float) -> dict[str, float]:
        t, c, share = F.col("t"), F.col("c"), n1 / (n1 + n0)
        odds = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
        evidence = t * F.log(F.greatest(t, F.lit(1)) / ((t + c) * share)) + c * F.log(F.greatest(c, F.lit(1)) / ((t + c) * (1 - share)))
        best = counts.withColumns({"weight": odds, "evidence": evidence}).where((F.col("weight") >= least) & (F.col("evidence") >= MIN_EVIDENCE))
        return {r["term"]: r["weight"] for r in best.orderBy(F.desc("evidence"), "term").limit(MAX_ENTRIES).collect()}

    # What looks telling at first, the phrases that make it harmless, and what is telling outside of them.
    lexicon = Lexicon(weighed(counted(terms), LOOSE_WEIGHT))

    def phrases(folded):
        out = set()
        for at in lexicon.matches(folded):
            end = folded.index(" ", at + 1)
            if end + 1 < len(folded):
                out.add(folded[at : folded.find(" ", end + 1) + 1])
            if at:
                out.add(folded[folded.rfind(" ", 0, at) : end + 1])
        return out

    benign = counted(phrases).where((F.col("c") >= 5) & (F.col("c") * n1 >= 9.0 * F.col("t") * n0)).orderBy(F.desc("c"), "term").limit(MAX_ENTRIES)
    exceptions = {r["term"] for r in benign.collect()}
    rest = Lexicon(lexicon.weights, exceptions)

    def outside(folded):
        out = set()
        for at in rest.matches(folded):
            word = folded[at : folded.index(" ", at + 1) + 1]
            out.update(e for e in (word, *(word[: k + 1] for k in PREFIXES if len(word) > k + 2)) if e in rest.weights)
        return out

    lexicon = Lexicon(weighed(counted(outside), MIN_WEIGHT), exceptions)

    def measured():
        return lambda rows: [(*lexicon.measures(f), y) for f, y in rows]

    points = np.array([tuple(r) for r in map_arrow(sample.select("folded", "toxic"), "x double, y double, toxic int", measured).collect()])
    lexicon.coefficients = _calibrated(points[:, :2], points[:, 2])
    return lexicon


def learn_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = FIT_DOCS) -> Lexicon:
    """Learns from at most n labelled documents of each class whose id's crc32 modulo 5 is not 0."""
    known = labels.select(id_col, "toxic").where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(id_col, 5) != 0)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(known.where("toxic = 1"), id_col, n).unionByName(bounded_sample(known.where("toxic = 0"), id_col, n))
    return learn(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col))  # picked: at most 2 n rows


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and n_matches of every whole text.

    Null and empty texts get the score of a text without matches. Null and repeated doc_ids keep
    their rows; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most MAX_ENTRIES entries and phrases

    def start():
        lex = shared.value
        return lambda rows: [(d, lex.score(t)) for d, t in rows]

    return map_arrow(docs.select(id_col, text_col), f"{id_col} long, score double", start)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document, empty and null texts too, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, learn_from_labels(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
