"""Column functions on names, paths and texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def extension(name_lower: Column) -> Column:
    """What follows the last dot; empty if there is nothing."""
    return F.regexp_extract(name_lower, r"\.([^.]+)$", 1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def full_path(path: Column, name: Column) -> Column:
    return F.when((path == "") | path.endswith("/"), F.concat(path, name)).otherwise(F.concat(path, F.lit("/"), name))


def parent_of(full: Column) -> Column:
    """Directory of a full path; that of a top-level entry is `/`."""
    up = F.regexp_replace(full, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def under(path: Column, prefix: str) -> Column:
    """The path is prefix or lies below it; everything lies below `/`."""
    prefix = prefix if prefix == "/" else prefix.rstrip("/")
    return F.lit(True) if prefix == "/" else (path == prefix) | path.startswith(prefix + "/")


def glob(text: Column, pattern: str) -> Column:
    """Whole-string match; * is any run, ? one character, nothing else is special."""
    literal = pattern.strip("*")
    if not re.search(r"[*?]", literal):
        head, tail = pattern.startswith("*"), pattern.endswith("*")
        if not head and not tail:
            return text == literal
        if head and tail:
            return F.contains(text, F.lit(literal))
        return text.endswith(literal) if head else text.startswith(literal)
    return text.like(re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_"))


def whole_word(text: Column, word: str) -> Column:
    """word with no ASCII letter or digit on either side; an empty word matches nothing."""
    if not word:
        return F.lit(False)
    # Most texts do not hold the word at all, which is cheaper to see than a pattern's match.
    return text.contains(word) & text.rlike(f"(?s)(^|[^a-zA-Z0-9]){java_quote(word)}([^a-zA-Z0-9]|$)")


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+\-?^$|#&~])", r"\\\1", text)


def path_segments(path: Column, segments, adjacency: str = "reference") -> Column:
    """Segments occur in the components of a path, from the right, greedily and without going back.

    The rightmost may skip components; an earlier one only where adjacency is lifted: by the segment
    to its right ("reference"), or by itself ("documented").
    """
    n = len(segments)
    if n == 1:
        return F.contains(path, F.lit(segments[0].text))
    texts = F.array(*(F.lit(s.text) for s in segments))
    lifted = [not (segments[k + 1] if adjacency == "reference" else segments[k]).adjacent for k in range(n - 1)]
    skips = F.array(*map(F.lit, [*lifted, True]))
    parts = F.reverse(F.filter(F.split(path, "/"), lambda x: x != ""))

    def step(k: Column, part: Column) -> Column:
        # k: segment sought, -1 when all are found, -2 when it failed.
        place = F.greatest(k, F.lit(0)) + 1
        hit = F.contains(part, F.element_at(texts, place))
        return F.when(k < 0, k).when(hit, k - 1).when(F.element_at(skips, place), k).otherwise(F.lit(-2))

    return F.aggregate(parts, F.lit(n - 1), step) == -1


def trigrams(text: Column) -> Column:
    """Distinct three-byte substrings of the ASCII-lowered UTF-8 bytes, in order of appearance; a null text has none."""
    # As a variable of a lambda the bytes are made once, not anew for each trigram; as hexadecimal digits equal ones are found by hash.
    def of(raw: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - 2, F.lit(1)))
        every = F.array_distinct(F.transform(places, lambda i: F.hex(F.substr(raw, i, F.lit(3)))))
        return F.when(F.octet_length(raw) < 3, F.array().cast("array<binary>")).otherwise(F.transform(every, lambda x: F.unhex(x)))

    return F.element_at(F.transform(F.array(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "utf-8")), of), 1)


def trigrams_of(text: str) -> list[bytes]:
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return list(dict.fromkeys(raw[i : i + 3] for i in range(len(raw) - 2)))


def snippet(content: Column, keyword: str, context: int = 80) -> tuple[Column, Column]:
    """(snippet, offset) of the first hit, ASCII case ignored; offset -1 and an empty snippet without one.

    The context begins after the last newline before the hit if that lies inside it; newlines become
    spaces; dots mark what is cut off. Offsets are characters.
    """
    low = keyword.translate(str.maketrans(_ASCII_UPPER, _ASCII_LOWER))
    hit = F.instr(ascii_lower(content), low) - 1
    start = F.greatest(hit - context, F.lit(0))
    end = F.least(hit + len(keyword) + context, F.length(content))
    before = F.substr(content, start + 1, hit - start + 1)
    newline = F.instr(F.reverse(before), "\n")
    start = F.when((start > 0) & (newline > 0), start + F.length(before) - newline + 1).otherwise(start)
    text = F.btrim(F.translate(F.substr(content, start + 1, end - start), "\n\r", "  "), F.lit(" \t"))
    dots = F.lit("...")
    whole = F.concat(F.when(start > 0, dots).otherwise(""), text, F.when(end < F.length(content), dots).otherwise(""))
    return F.when(hit >= 0, whole).otherwise(""), hit.cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
