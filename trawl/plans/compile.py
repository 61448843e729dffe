"""Syntax tree to Column over the catalog's columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import syntax as S
from .dates import Calendar

#: Parts of a pattern that are read as a whole: quoted text, an escape, a class (brackets in it escaped or not), a quantifier, a group's opening.
_PARTS = re.compile(r"\\Q.*?(?:\\E|$)|\\k<|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})[+?]?|\(\?(?:<[=!]|[=!>])|.", re.S)
_REFUSED = re.compile(r"\\[1-9]|\\k<|(?:[*+?]|\{.*\})\+|\(\?(?:<[=!]|[=!>])")


def regex_ok(pattern: str) -> bool:
    """A pattern without look-around, back-references or possessive parts that Java accepts.

    A bad pattern would only fail while the job runs, so it is found out here and matches nothing.
    """
    if any(_REFUSED.fullmatch(m[0]) for m in _PARTS.finditer(pattern)):
        return False
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # the gateway wraps Java's PatternSyntaxException
            return False
        return True
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


#: Repetitions without an upper bound that a backtracking engine may try in turn; more of them go to the other engine.
FEW_REPEATS = 2
_UNBOUNDED = re.compile(r"[*+]\??|\{[0-9]+,\}\??")


def backtracks(pattern: str) -> bool:
    """Whether a backtracking engine may take more than a small power of a text's length: repetitions, or
    alternatives, inside a repetition, or many repetitions in a row."""
    groups: list[bool] = []  # of each open group: whether there is a choice inside
    repeats, choice = 0, False  # choice: inside the group that ended just now
    for m in _PARTS.finditer(pattern):
        part = m[0]
        if part.startswith("("):
            groups.append(False)
            continue
        many = _UNBOUNDED.fullmatch(part) is not None
        if part == ")":
            choice = groups.pop() if groups else False
            if groups and choice:
                groups[-1] = True
            continue
        if many:
            repeats += 1
            if choice:
                return True
        if groups and (many or part in ("|", "?", "??") or part.startswith("{")):
            groups[-1] = True
        choice = False
    return repeats > FEW_REPEATS


def linear_match(pattern: str):
    """A Column function that matches as rlike, letters of either case, by an automaton: in time linear in the
    text, whatever the pattern. None if the pattern is not one for it."""
    pattern = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.escape(m[1]), pattern, flags=re.S)
    try:
        pc.match_substring_regex(pa.array([""]), pattern, ignore_case=True)
    except pa.ArrowInvalid:
        return None

    @F.arrow_udf("boolean")
    def matches(texts: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(texts, pattern, ignore_case=True), False)

    return matches


def compared(column: Column, op: str, a: int, b: int) -> Column:
    match op:
        case "..":
            return column.between(a, b)
        case ">":
            return column > a
        case ">=":
            return column >= a
        case "<":
            return column < a
        case "<=":
            return column <= a
    return column == a


class Compiler:
    """now and tz settle relative dates; adjacency as in path_segments."""

    def __init__(self, now: datetime | None = None, tz: str = "UTC", adjacency: str = "reference"):
        self.calendar = Calendar(now or datetime.now(UTC), tz)
        self.adjacency = adjacency

    def column(self, node) -> Column:
        if isinstance(node, S.And):
            return T.all_of([self.column(p) for p in sorted(node.parts, key=cost)])
        if isinstance(node, S.Or):
            return T.any_of([self.column(p) for p in sorted(node.parts, key=cost)])
        if isinstance(node, S.Not):
            return ~self.column(node.part)
        if isinstance(node, S.PathSegments):
            return T.path_segments(F.col("match_path"), node.segments, self.adjacency)
        return self.term(node) if isinstance(node, S.Term) else self.filter(node)

    def term(self, t: S.Term) -> Column:
        name, path, low = F.col("name_lower"), F.col("match_path"), t.text.lower()
        match t.mode:
            case S.GLOB:
                return T.glob(path if "/" in low and not t.name_only else name, low)
            case S.REGEX:
                pattern = f"(?iu){t.text}"
                if not regex_ok(pattern):
                    return F.lit(False)
                if backtracks(t.text):
                    matches = linear_match(t.text)
                    return matches(name) | matches(path) if matches else F.lit(False)
                return name.rlike(pattern) | path.rlike(pattern)
            case S.WHOLE_WORD:
                return T.whole_word(name, low)
            case S.WHOLE_NAME:
                return name == low
        if t.case_sensitive:
            where = F.col("name") if t.name_only else F.concat(F.col("path"), F.lit("/"), F.col("name"))
            return F.contains(where, F.lit(t.text))
        return F.contains(name if t.name_only else path, F.lit(low))

    def filter(self, f: S.Filter) -> Column:
        c, low = F.col, f.argument.lower()
        match f.name:
            case "ext":
                wanted = [e for e in low.split(";") if e]
                return c("ext").isin(wanted) if wanted else F.lit(False)
            case "size" | "len" | "depth":
                return compared(c({"size": "size", "len": "name_len", "depth": "depth"}[f.name]), *S.comparison(f.argument))
            case "file":
                return c("type") == 1
            case "folder":
                return c("type") == 2
            case "type":
                kind = {"file": 1, "folder": 2, "dir": 2}.get(f.argument)
                return c("type") == kind if kind else F.lit(False)
            case "path":
                return F.contains(c("match_path"), F.lit(low))
            case "nopath":
                return ~F.contains(c("match_path"), F.lit(low))
            case "parent":
                return c("path_lower") == low
            case "dm" | "datemodified" | "dc" | "datecreated" | "da" | "dateaccessed":
                # Only the time of modification is recorded; all three names read it.
                found = self.calendar.comparison(f.argument)
                return compared(c("mod_time"), *found) if found else F.lit(False)
            case name if name in S.MACROS:
                return c("ext").isin(S.MACROS[name])
        return F.lit(True)  # content: has no meaning inside a file query


def cost(node) -> int:
    """Cheap and pushable conditions first."""
    if isinstance(node, S.Filter):
        return 0 if node.name in ("size", "type", "file", "folder", "dm", "dc", "da") else 1
    if isinstance(node, S.Term):
        return {S.WHOLE_NAME: 1, S.SUBSTRING: 3, S.GLOB: 4, S.WHOLE_WORD: 6, S.REGEX: 7}[node.mode]
    if isinstance(node, S.PathSegments):
        return 5
    return max(map(cost, node.parts)) if isinstance(node, S.And | S.Or) else cost(node.part)


def priority(text: str | None) -> Column:
    """0 the name is the text, 1 it begins with it, 2 it holds it (or there is no text), 3 only the path does."""
    if text is None:
        return F.lit(2)
    name = F.col("name_lower")
    return F.when(name == text, 0).when(name.startswith(text), 1).when(F.contains(name, F.lit(text)), 2).otherwise(3)


def required_texts(node) -> list[str]:
    """Substrings that every match holds in its path or name, for sound prefilters."""
    if isinstance(node, S.Term) and node.mode in (S.SUBSTRING, S.WHOLE_NAME, S.WHOLE_WORD):
        return [node.text.lower()]
    if isinstance(node, S.PathSegments):
        return [s.text for s in node.segments]
    if isinstance(node, S.Filter) and node.name == "path":
        return [node.argument.lower()]
    return [t for p in node.parts for t in required_texts(p)] if isinstance(node, S.And) else []
