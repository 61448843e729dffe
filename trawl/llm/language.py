"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response
in a window feeds a softmax over the languages. A filter on one-hot bytes is a sum of table rows, one
per offset, so inference looks up byte pairs in tables built from the filters. The whole text is cut
into windows; the window probabilities, weighted by their bytes, average to the text's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, filter_arrow, fold_of, id_crc, map_arrow, table

#: Bytes of a window; shorter ends are padded with zero bytes, which add nothing.
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled documents the network is trained on, at most.
FIT_DOCS = 2500
#: Windows taken from each of them for training.
FIT_WINDOWS = 3
UNDETERMINED = "und"


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes of the whole text, ASCII lower-cased, and the bytes used of each window."""
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    used = np.full(n, WINDOW)
    used[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), used


@dataclass
class ByteConvNet:
    labels: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray  # of the filters
    weight: np.ndarray  # (filters, labels)
    offset: np.ndarray  # of the labels
    pairs: np.ndarray | None = None

    @classmethod
    def new(cls, labels: list[str], seed: int = 5) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        total = FILTERS * len(WIDTHS)
        for f in filters:
            f[:, 0] = 0
        return cls(labels, filters, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteConvNet:
        """Adam on the softmax loss, classes weighted to count alike."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.labels))
        importance = (len(y) / np.maximum(share, 1) / max(1, (share > 0).sum()))[y].astype(np.float32)
        params = [*self.filters, self.bias, self.weight, self.offset]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                xb, tops, places = x[rows], [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    conv = sum(f[k][xb[:, k : WINDOW - w + 1 + k]] for k in range(w))
                    at = conv.argmax(1)
                    places.append(at)
                    tops.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
                pooled = np.concatenate(tops, 1) + self.bias
                hidden = np.maximum(pooled, 0)
                d = softmax(hidden @ self.weight + self.offset)
                d[np.arange(len(rows)), y[rows]] -= 1
                d *= (importance[rows] / len(rows))[:, None]
                back = (d @ self.weight.T) * (pooled > 0)
                grads = []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = np.zeros_like(f)
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        symbols = np.take_along_axis(xb, places[i] + k, 1)
                        np.add.at(g[k], (symbols, np.arange(FILTERS)[None, :]), part)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ d, d.sum(0)]
                step += 1
                for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return self

    def compiled(self) -> ByteConvNet:
        """Rows by byte pair: both bytes of width 2, the first two of width 3, the first and the last two of width 4."""
        two, three, four = self.filters
        both = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.pairs = np.concatenate([both(two[0], two[1]), both(three[0], three[1]), both(four[0], four[1]), both(four[2], four[3])], 1)
        return self

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """(windows, labels); block windows at a time, so that the responses stay in the cache."""
        f, last = FILTERS, self.filters[1][2]
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), block):
            xb = x[at : at + block]
            rows = self.pairs[(xb[:, :-1].astype(np.uint16) << 8) | xb[:, 1:]]
            top = np.concatenate([
                rows[:, :, :f].max(1),
                (rows[:, :-1, f : 2 * f] + last[xb[:, 2:]]).max(1),
                (rows[:, :-2, 2 * f : 3 * f] + rows[:, 2:, 3 * f :]).max(1),
            ], 1)
            out[at : at + block] = softmax(np.maximum(top + self.bias, 0) @ self.weight + self.offset)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Label and mean probability of each text; no letters: undetermined, 0."""
        parts = [windows(t) if t and any(map(str.isalpha, t)) else None for t in texts]
        known = [p for p in parts if p]
        if not known:
            return [(UNDETERMINED, 0.0)] * len(texts)
        p = self.probabilities(np.concatenate([x for x, _ in known])) * np.concatenate([u for _, u in known])[:, None]
        starts = np.cumsum([0, *(len(x) for x, _ in known[:-1])])
        mean = np.add.reduceat(p, starts, axis=0).astype(float)
        mean /= mean.sum(1, keepdims=True)
        best = iter(zip(mean.argmax(1), mean.max(1), strict=True))
        return [(self.labels[(b := next(best))[0]], float(min(1.0, b[1]))) if part else (UNDETERMINED, 0.0) for part in parts]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 4) -> ByteConvNet:
    """Trains on (text, label) rows; a label is what the text's windows learn."""
    drawn = []
    for k, (text, label) in enumerate(rows):
        drawn += [(w, label) for w in sampled_windows(text, seed * 1_000_003 + k)]
    return fit_windows(drawn)


def sampled_windows(text: str, seed: int) -> list[bytes]:
    """At most FIT_WINDOWS of the text's windows, chosen alike in every run; ends that are too short teach nothing."""
    x, used = windows(text)
    x = x[used >= WINDOW // 8]
    return [w.tobytes() for w in x[np.random.default_rng(seed).permutation(len(x))[:FIT_WINDOWS]]]


def fit_windows(drawn: list[tuple[bytes, str]]) -> ByteConvNet:
    """Trains on (window, label) rows; without any the network knows no language."""
    if not drawn:
        return ByteConvNet.new([UNDETERMINED]).compiled()
    labels = sorted({label for _, label in drawn})
    x = np.frombuffer(b"".join(w for w, _ in drawn), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet.new(labels).train(x, np.array([labels.index(label) for _, label in drawn])).compiled()


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = FIT_DOCS) -> ByteConvNet:
    """Learns from at most n documents with a language and a text whose id's crc32 modulo 4 is not 2, and
    from at most FIT_WINDOWS windows of each, wherever in the text they are.

    Windows are drawn by the tasks, so a text of any length can be learned from and the driver sees
    n x FIT_WINDOWS x WINDOW bytes at most. Without any text to learn from, as in an empty table, the
    network knows no language and says `und` of all.
    """
    known = docs.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) >= WINDOW // 8) & (fold_of(id_col, 4) != 2))

    def start():
        return lambda rows: [(i, lang, w) for i, text, lang in rows for w in sampled_windows(text, id_crc(i))]

    drawn = map_arrow(bounded_sample(known, id_col, n), f"{id_col} long, {lang_col} string, window binary", start, rows=16).collect()
    return fit_windows([(w, lang) for _, lang, w in sorted((r[id_col], r[lang_col], bytes(r["window"])) for r in drawn)])


def identify_language(docs: DataFrame, model: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (mean probability of lang_pred) of every whole text.

    A null text and one without letters give `und` and 0. Null and repeated doc_ids keep their rows;
    other columns are ignored; an empty table gives an empty result.
    """
    net = docs.sparkSession.sparkContext.broadcast(model)  # about 8 MB whatever the input

    def start():
        return lambda rows: [(d, *p) for (d, _), p in zip(rows, net.value.predict([t for _, t in rows]), strict=True)]

    return map_arrow(docs.select(id_col, text_col), f"{id_col} long, lang_pred string, score double", start, rows=256)


#: A document whose language is less likely than this is rejected: it is hardly text of any known one.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, model: ByteConvNet, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, whose language is determined with at least min_score.

    Null texts and texts without letters go. A model that has learned no language can reject none: all
    documents stay. Repeated rows are treated alike; an empty table gives an empty result.
    """
    if model.labels == [UNDETERMINED]:
        return docs
    net = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda texts: [lang != UNDETERMINED and score >= min_score for lang, score in net.value.predict(texts)]

    return filter_arrow(docs, text_col, start)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of them; null texts and texts without letters are `und`."""
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, fit_documents(docs))
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
