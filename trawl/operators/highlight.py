"""Which parts of names and paths a query's terms match."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import syntax as S
from ..plans.compile import backtracks, regex_ok

NAME, PATH, ANY = "name", "path", "any"


@dataclass(frozen=True)
class Hint:
    text: str
    field: str = ANY
    mode: str = S.SUBSTRING
    case_sensitive: bool = False


def hints(query: str) -> list[Hint]:
    """Hints of all terms outside negations, of path: and of file: arguments."""
    tree = S.parse(S.prepare(query))
    out: list[Hint] = []

    def walk(node) -> None:
        if isinstance(node, S.Term) and node.text:
            out.append(Hint(node.text, NAME if node.name_only else ANY, node.mode, node.case_sensitive))
        elif isinstance(node, S.And | S.Or):
            for p in node.parts:
                walk(p)
        elif isinstance(node, S.Filter) and node.argument and node.name in ("path", "file"):
            out.append(Hint(node.argument, PATH if node.name == "path" else NAME))

    walk(S.rewrite(tree) if tree is not None else None)
    return out


def ranges(text: str, hint: Hint) -> list[tuple[int, int]]:
    """Ranges (end exclusive) of one hint in a text."""
    flags = re.NOFLAG if hint.case_sensitive else re.IGNORECASE
    match hint.mode:
        case S.WHOLE_NAME:
            same = text == hint.text or (not hint.case_sensitive and text.lower() == hint.text.lower())
            return [(0, len(text))] if same and text else []
        case S.REGEX:
            pattern = hint.text
        case S.WHOLE_WORD:
            pattern = rf"\b{re.escape(hint.text)}\b"
        case S.GLOB:
            pattern = "|".join(re.escape(p) for p in sorted(re.split(r"[*?]+", hint.text), key=len, reverse=True) if p)
        case _:
            pattern = re.escape(hint.text)
    try:
        return [m.span() for m in re.finditer(pattern, text, flags) if m.end() > m.start()] if pattern else []
    except re.error:
        return []


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def both(name: str, path: str, wanted: list[Hint]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges in the name and in the path; a text with a slash is sought in path/name and cut at the slash."""
    in_name, in_path = [], []
    for h in wanted:
        if h.field == ANY and h.mode == S.SUBSTRING and "/" in h.text:
            cut = len(path)
            for s, e in ranges(f"{path}/{name}", h):
                if s < cut:
                    in_path.append((s, min(e, cut)))
                if e > cut + 1:
                    in_name.append((max(s, cut + 1) - cut - 1, e - cut - 1))
            continue
        if h.field != PATH:
            in_name += ranges(name, h)
        if h.field != NAME:
            in_path += ranges(path, h)
    return merged(in_name), merged(in_path)


# ---- as columns ----

#: Noncharacters, which stand before and after a match while it is looked for.
_OPEN, _CLOSE = "\ufffe", "\uffff"


def _pattern(hint: Hint) -> str | None:
    """What ranges() looks for, for Java; None if it is nothing."""
    quote = T.java_quote
    match hint.mode:
        case S.WHOLE_NAME:
            pattern = rf"\A{quote(hint.text)}\z"
        case S.REGEX:
            pattern = hint.text if regex_ok(hint.text) and not backtracks(hint.text) else ""
        case S.WHOLE_WORD:
            pattern = rf"\b{quote(hint.text)}\b"
        case S.GLOB:
            pattern = "|".join(quote(p) for p in sorted(re.split(r"[*?]+", hint.text), key=len, reverse=True) if p)
        case _:
            pattern = quote(hint.text)
    # U: word borders by Unicode's letters.
    return f"({'(?U)' if hint.case_sensitive else '(?iuU)'}(?:{pattern}))" if pattern else None


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def found_in(text: Column, hint: Hint) -> Column:
    """Array of the ranges of one hint in a column of texts."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    pattern = _pattern(hint)
    if pattern is None:
        return none
    # Each part but the first begins with a match; what lies before it is counted as the parts go by.
    parts = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$1{_CLOSE}"), _OPEN)
    begin = F.struct(F.length(parts[0]).alias("at"), none.alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.instr(part, _CLOSE) - 1
        found = F.when(end > state["at"], F.concat(state["found"], F.array(_range(state["at"], end)))).otherwise(state["found"])
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), found.alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), begin, step, lambda state: state["found"])


def joined(found: Column) -> Column:
    """As merged(), for an array of ranges."""

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"])
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_range(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when(touches, longer).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(found), F.array().cast("array<struct<start:int,end:int>>"), step)


def highlighted(rows: DataFrame, query: str, name: str = "name", path: str = "path") -> DataFrame:
    """Adds ranges: the parts of the name and of the path (a directory) that the query's terms match.

    Nulls count as empty texts. Regular expressions that a backtracking engine could not bound highlight nothing.
    """
    names, paths = (F.coalesce(F.col(c), F.lit("")) for c in (name, path))
    none = F.array().cast("array<struct<start:int,end:int>>")
    in_name, in_path = [none], [none]
    cut = F.length(paths)
    for h in hints(query):
        if h.field == ANY and h.mode == S.SUBSTRING and "/" in h.text:
            across = found_in(F.concat(paths, F.lit("/"), names), h)
            in_path.append(F.transform(F.filter(across, lambda r: r["start"] < cut), lambda r: _range(r["start"], F.least(r["end"], cut))))
            in_name.append(F.transform(F.filter(across, lambda r: r["end"] > cut + 1), lambda r: _range(F.greatest(r["start"], cut + 1) - cut - 1, r["end"] - cut - 1)))
            continue
        if h.field != PATH:
            in_name.append(found_in(names, h))
        if h.field != NAME:
            in_path.append(found_in(paths, h))
    return rows.withColumn("ranges", F.struct(joined(F.concat(*in_name)).alias("name"), joined(F.concat(*in_path)).alias("path")))


def shown(ranges: Column) -> Column:
    """An array of ranges as text: start-end, joined by commas."""
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
