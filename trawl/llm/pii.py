"""Personal data: base patterns, and further spans picked by gradient-boosted trees.

Generators of high recall propose spans, which may overlap: e-mail addresses with spelled-out signs,
telephone numbers without a plus, card numbers with unusual separators, addresses with bracketed dots
or of version 6, and secrets: keys, tokens and passwords. Boosted trees score each candidate by its
format and context; on texts kept apart, Platt scaling turns scores into probabilities, and on
others each kind gets the threshold that reaches the precision asked for. What the base patterns find
stays whatever the trees say.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, map_arrow, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Documents the trees are fitted on, at most: those with the smallest hash of doc_id, unless they have more bytes than this.
FIT_DOCS, FIT_BYTES = 1000, 1 << 16
#: Precision that a kind's threshold must reach on the held-out candidates.
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def _octet(s: str) -> bool:
    s = s.lstrip("0") or "0"
    return len(s) <= 3 and int(s) <= 255


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, chain = m.start(), []
        for part in m.group().split("."):
            chain = [*chain, (at, part)] if part else []
            at += len(part) + 1
            if len(chain) == 4:
                if all(_octet(p) for _, p in chain):
                    yield chain[0][0], at - 1
                chain = []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end (code points) of what the base patterns match, leftmost and not overlapping per kind."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Candidate generators by kind.
_PROPOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[({<] ?(?:at|@) ?[\])}>] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?|\.| dot )[A-Za-z0-9-]{2,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\[\.\]|\(\.\)| \. | ?\[dot\] ?| dot )[0-9]{1,4}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:{1,2}){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{2,6}(?:[ ._/-]{1,3}[0-9]{2,6}){1,6}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{12,20}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:00[0-9]|\([0-9]{2,5}\)|[0-9]{2,5})[ ./()-]{0,2}[0-9]{2,8}(?:[ ./()-]{1,2}[0-9]{2,8}){0,5}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{10,}={0,2}|(?<=[=:\"'])(?=[!-~]*[0-9])[!#-&(-~]{6,}"),
}
#: What a text must hold, in lower case, to have candidates at all.
_NEEDS = {"email": re.compile(r"[\[({<] ?(?:at|@) ?[\])}>]| at [a-z0-9-]+(?:\.[a-z]| ?[\[({<] ?dot| dot )"), **dict.fromkeys(("ip", "card", "phone", "secret"), re.compile("[0-9]"))}
#: Words that stand before personal data, by kind.
_CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "addr", "host", "server"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "contact", "whats"),
    "secret": ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer"),
}
_SEPARATORS = " .-/()[]_:"


def candidates(text: str, kinds=KINDS):
    for kind in kinds:
        if _NEEDS[kind].search(text.lower() if kind == "email" else text):
            for m in _PROPOSE[kind].finditer(text):
                yield kind, m.start(), m.end()


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and of its surroundings."""
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    ip = [int(g) for g in groups[:4] if len(g) < 5]
    sizes = [len(g) for g in groups] or [0]
    classes = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "." for c in span]
    letters = re.findall("[A-Za-z]+", span)
    counts = Counter(span)
    return [
        len(span), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(sizes)),
        *(span.count(c) for c in _SEPARATORS),
        len({c for c in span if c in _SEPARATORS}),
        float(luhn(digits)) if digits else 0.0,
        float(len(ip) == 4 and all(x < 256 for x in ip)),
        float(digits[:1] == "0"), float(digits[:2] == "00"), float(digits[:1] in "3456"),
        float(len(groups) == 3 and sizes == [4, 2, 2]), float(len(groups) == 3 and sizes == [3, 3, 4]),
        float(bool(groups) and len(groups[0]) == 4 and 1900 <= int(groups[0]) <= 2100),
        sum(c.isalpha() for c in span),
        float(any(w in before.lower() for w in _CUES[kind])),
        float(before[-1:].isalnum()), float(before[-1:] in "=#$€£:\"'/"), float(after[:1].isalnum()), float(after[:1] in "%€$\"'/"),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / len(span),
        -sum(c / len(span) * np.log2(c / len(span)) for c in counts.values()),
        max(map(len, letters), default=0), classes.count("A") / len(span), classes.count("a") / len(span),
        float(all(c in "0123456789abcdefABCDEF" for c in span)), sum(c in "aeiouAEIOU" for c in span) / len(span),
    ]


class BoostedTrees:
    """Logistic gradient boosting of regression trees of fixed depth over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.scale = 0.0, (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q) + 1e-6
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    best = 1e-6
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f, e in enumerate(edges):
                        if not len(rows) or not len(e):
                            continue
                        gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        if gain[i := int(gain.argmax())] > best:
                            best, feature[k], cut[k] = gain[i], f, e[i]
                    node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling: logistic regression on the score, with smoothed targets and damped steps."""
        n1 = y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        s = self.raw(x)
        w = np.array([1.0, 0.0])
        z = np.stack([s, np.ones_like(s)], 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (target - p) - 0.01 * (w - [1.0, 0.0])
            hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
            w = w + np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        self.scale = (max(float(w[0]), 0.05), float(w[1]))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def _some(rng, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high + 1))))


_DIGITS, _LOWER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_ALNUM = _DIGITS + _LOWER + _LOWER.upper()


def _made(kind: str, rng) -> str:
    """Personal data of a kind, made up, in the form that the base patterns match; of a secret, any."""
    if kind == "email":
        return f"{_some(rng, _LOWER, 2, 8)}{'._'[rng.integers(2)]}{_some(rng, _LOWER + _DIGITS, 1, 8)}@{_some(rng, _LOWER, 3, 10)}.{('com', 'org', 'net', 'de', 'co.uk')[rng.integers(5)]}"
    if kind == "ip":
        return ".".join(map(str, rng.integers(1, 256, 4)))
    if kind == "card":
        d = "3456"[rng.integers(4)] + _some(rng, _DIGITS, 14, 14)
        return next(d + c for c in _DIGITS if luhn(d + c))
    if kind == "phone":
        return f"+{rng.integers(1, 99)} {_some(rng, '123456789', 1, 1)}{_some(rng, _DIGITS, 8, 9)}"
    body = (
        lambda: _some(rng, _LOWER.upper(), 2, 5) + _some(rng, _LOWER.upper() + _DIGITS, 14, 30),
        lambda: _some(rng, _HEX, 16, 64),
        lambda: _some(rng, _ALNUM, 14, 48),
        lambda: f"{_some(rng, _LOWER, 2, 4)}{'_-'[rng.integers(2)]}{_some(rng, _ALNUM, 16, 40)}",
        lambda: _some(rng, _ALNUM + "+/", 24, 60) + "="[: rng.integers(2)],
        lambda: _some(rng, _ALNUM + "!#%*", 8, 16),
    )
    form = int(rng.integers(len(body)))
    value = body[form]()
    while not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        value = body[form]()
    return value


def _rewritten(kind: str, span: str, rng) -> str:
    """Personal data in a form that the base patterns miss."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        local, host = span.split("@", 1)
        at = ("[at]", "(at)", " [at] ", " (at) ", "{at}", "[@]", " at ")[rng.integers(7)]
        dot = (".", "[dot]", " (dot) ", " dot ", "[.]")[rng.integers(5) if at != " at " else 3]
        return local + at + host.replace(".", dot)
    if kind == "ip":
        if rng.integers(4) == 0:
            return ":".join(_some(rng, _HEX, 1, 4) for _ in range(8))
        return span.replace(".", ("[.]", "(.)", " . ", "[dot]", " dot ")[rng.integers(5)])
    if kind == "card":
        sep = (".", "/", "_", " - ", "  ")[rng.integers(5)]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "secret":
        return span
    d = digits[-10:]
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:2]} {d[:3]} {d[3:]}", f"0{d[1:4]}/{d[4:]}", f"0{d[1:5]} {d[5:]}", f"{d[:3]} {d[3:6]} {d[6:]}")[rng.integers(7)]


def _decoy(kind: str, rng) -> str:
    """Something of similar shape that is no personal data."""
    n = lambda k: _some(rng, _DIGITS, k, k)
    w = lambda: _some(rng, _LOWER, 3, 11)
    if kind == "email":
        return (f"{n(3)} (at) {n(2)}.{n(2)}", f"{w()} at {w()}.{w().title()}", f"{w()} at {w()} dot {w()}")[rng.integers(3)]
    if kind == "ip":
        return (("[.]", " . ", "(.)")[rng.integers(3)].join(str(x) for x in rng.integers(256, 2000, 4)), f"{n(2)}:{n(2)}:{n(2)}:{n(3)}", f"{n(1)}:{n(2)}:{n(2)}:{n(1)}")[rng.integers(3)]
    if kind == "card":
        d = _some(rng, _DIGITS, 12, 19)
        d = d[:-1] + str((int(d[-1]) + 1) % 10) if luhn(d) else d
        sep = ("", ".", "/", "_", " - ", "  ", " ", "-")[rng.integers(8)]
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "secret":
        forms = (
            f"{w()}{w()}{n(4)}", f"{w()}-{w()}-{n(2)}-{w()}", f"{w()}_{w()}_v{n(1)}", f"{w().title()}{w().title()}{n(2)}", f"{w()}-20{n(2)}-{n(2)}-{n(2)}", f"{n(4)}-{n(2)}-{n(2)}T{n(2)}",
            f"{w()}/{w()}/{n(3)}/{w()}", f"{w().upper()}-{n(5)}", f"{n(6)}{w()[:2]}{n(6)}", f"{w()}{n(1)}-{w()}{n(1)}", f"{w()}{n(6)}", f"{n(13)}X"[-12:],
        )
        return forms[rng.integers(len(forms))]
    y, m = rng.integers(1900, 2100), f"{rng.integers(1, 13):02d}"
    return (f"{y}-{m}-{n(2)}", f"{n(2)}.{m}.{y}", f"{n(2)}/{m}/{y}", f"{y}-{y + 1}", f"{n(3)}.{n(2)}", _some(rng, _DIGITS, 4, 8), f"{n(2)} {n(3)}", f"{n(3)}.{n(3)}.{n(3)}", f"{n(4)}-{n(2)}", f"{n(3)}.{n(3)}")[rng.integers(10)]


#: What may stand before a made-up secret, and after it.
_SETTING = (("", ""), ("", ""), ("password=", ""), ("token = \"", "\""), ("api_key: ", ""), ("secret='", "'"), ("key=", ""))


def fit(texts: list[str], seed: int = 7) -> tuple[dict[str, BoostedTrees], dict[str, float]]:
    """Trees and thresholds by kind; none without texts, or where no threshold reaches PRECISION.

    Positive candidates are base matches in the given texts, all of them, and made-up data put
    between words, rewritten into forms that the base patterns miss; negative ones are look-alikes
    put in the same places, and what the generators propose elsewhere in the texts beside the base
    matches, except secrets, which texts may hold unmarked. Six texts of ten fit the trees, two
    the scaling and two the threshold.
    """
    rng = np.random.default_rng(seed)
    rows = {k: ([], [], []) for k in KINDS}

    def add(kind, part, left, new, right, label):
        text, lo, hi = left + new + right, len(left), len(left) + len(new)
        for k, s, e in candidates(text, (kind,)):
            if s < hi and e > lo:
                rows[k][0].append(features(k, text, s, e))
                rows[k][1].append(float(label and s <= lo and e >= hi))
                rows[k][2].append(part)

    for text in texts:
        part = int(rng.integers(10))
        spans = base_spans(text)
        places = [(kind, lo, hi, text[lo:hi]) for kind, lo, hi in spans]
        blanks = [i for i, c in enumerate(text[:-1]) if c == " "]
        if blanks:
            places += [(kind, at, at, _made(kind, rng)) for kind in KINDS for at in [blanks[rng.integers(len(blanks))] + 1]]
        for kind, lo, hi, found in places:
            left, right = text[max(0, lo - 60) : lo], text[hi : hi + 60]
            right = right if hi > lo else " " + right
            for label in (1, 1, 0, 0):
                before, after = _SETTING[rng.integers(len(_SETTING))] if kind == "secret" and label else ("", "")
                new = _rewritten(kind, found, rng) if label else _decoy(kind, rng)
                add(kind, part, left + before, new, after + right, label)
        taken = _Intervals((lo, hi) for _, lo, hi in spans)
        for kind, lo, hi in candidates(text, BASE_KINDS):
            if not taken.meets(lo, hi):
                rows[kind][0].append(features(kind, text, lo, hi))
                rows[kind][1].append(0.0)
                rows[kind][2].append(part)
    models, thresholds = {}, {}
    for kind, (xs, ys, parts) in rows.items():
        x, y, part = np.array(xs), np.array(ys), np.array(parts)
        trained, scaled, judged = part < 6, (part == 6) | (part == 7), part > 7
        if any(len(set(y[p].tolist())) < 2 for p in (trained, scaled, judged)):
            continue
        model = BoostedTrees().fit(x[trained], y[trained]).calibrate(x[scaled], y[scaled])
        p = model.probability(x[judged])
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(y[judged][order]) / np.arange(1, len(order) + 1)
        last = np.append(p[order][1:] != p[order][:-1], True)  # a threshold takes all candidates of one probability
        good = np.flatnonzero((precision >= PRECISION) & last)
        if len(good):
            models[kind], thresholds[kind] = model, max(0.5, float(p[order][good[-1]]))
    return models, thresholds


class _Intervals:
    """Spans that do not overlap after adding; whether another meets one of them takes a bisection."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            self.add(s, e)

    def add(self, start: int, end: int) -> None:
        """Those it meets are joined with it."""
        i, j = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def meets(self, start: int, end: int) -> bool:
        return bisect.bisect_right(self.ends, start) < bisect.bisect_left(self.starts, end)


def find(texts: list[str], models: dict, thresholds: dict) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text: base matches (marked so), then accepted candidates that overlap no other span."""
    base = [base_spans(t) for t in texts]
    taken = [_Intervals((s, e) for _, s, e in b) for b in base]
    spans = [[(*x, True) for x in b] for b in base]
    for kind, model in models.items():
        found = [(i, s, e) for i, t in enumerate(texts) for _, s, e in candidates(t, (kind,)) if not taken[i].meets(s, e)]
        if not found:
            continue
        p = model.probability(np.array([features(kind, texts[i], s, e) for i, s, e in found]))
        for k in np.argsort(-p, kind="stable"):
            i, s, e = found[k]
            if p[k] >= thresholds[kind] and not taken[i].meets(s, e):
                spans[i].append((kind, s, e, False))
                taken[i].add(s, e)
    order = {k: i for i, k in enumerate(KINDS)}
    return [sorted(s, key=lambda x: (order[x[0]], x[1])) for s in spans]


def fit_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = FIT_DOCS, size: int = FIT_BYTES) -> list[str]:
    """Texts of at most n documents, without those of more than `size` bytes: no more than n times size bytes."""
    return [r[0] or "" for r in bounded_sample(docs.select(id_col, text_col), id_col, n).where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= size).select(text_col).collect()]


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id and spans, an array of kind, start, end (code points, end exclusive) and base,
    which tells what the base patterns matched; ordered by kind, then start. A null or empty text has no
    spans. Null and repeated doc_ids keep their rows; other columns are ignored. An empty table gives an
    empty result; without texts to learn from only base matches are found.
    """
    models, thresholds = model or fit(fit_sample(docs, id_col, text_col))

    def start():
        def work(rows):
            found = find([t or "" for _, t in rows], models, thresholds)
            return [(d, [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in f]) for (d, _), f in zip(rows, found, strict=True)]

        return work

    return map_arrow(docs.select(id_col, text_col), f"{id_col} long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", start)


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one."""
    out, at = [], 0
    for kind, s, e in sorted(((k, s, e) for k, s, e in spans), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base spans of each kind, their digest, all spans as text, and counts of secrets, which
    have no base pattern, and of all spans. Of nulls, empty tables and repeated rows see detect_pii()."""
    found = detect_pii(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    n = lambda k, c: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    digest = F.sha2(text(base), 256).alias("base_sha256")
    return found.select("doc_id", *(n(k, base) for k in BASE_KINDS), digest, text(F.col("spans")).alias("spans"), n("secret", "spans"), F.size("spans").cast("long").alias("n_spans"))
