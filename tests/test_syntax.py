"""Lexer, parser, rewrites, numbers and dates."""

from datetime import UTC, datetime

import pytest

from trawl.plans import syntax as S
from trawl.plans.dates import Calendar
from trawl.plans.syntax import And, Filter, Not, Or, PathQuery, PathSegments, Segment, Term


def test_tokens():
    kinds = [t.kind for t in S.tokenize('foo !bar | <baz "hello"> ext:h')]
    assert kinds == ["WORD", "!", "WORD", "|", "<", "WORD", "QUOTED", ">", "FILTER"]
    assert S.tokenize("unknown:value")[0].kind == "WORD"
    assert (S.tokenize("EXT:cpp")[0].name, S.tokenize("EXT:cpp")[0].text) == ("ext", "cpp")
    assert S.tokenize('"unclosed')[0].text == "unclosed"
    assert S.tokenize("size:>1kb")[0].text == ">1kb"
    assert [t.text for t in S.tokenize('a"b c"d')] == ["a", "b c", "d"]


@pytest.mark.parametrize(
    "query, tree",
    [
        ("a b", And((Term("a"), Term("b")))),
        ("a | b c", Or((Term("a"), And((Term("b"), Term("c")))))),
        ("!a", Not(Term("a"))),
        ("a !", And((Term("a"), Term("!")))),
        ("<a | b> c", And((Or((Term("a"), Term("b"))), Term("c")))),
        ("<a | b", Or((Term("a"), Term("b")))),
        ("a > b", Term("a")),
        ("a | | b", Term("a")),
        ("| a", None),
        ("> a", None),
        ("", None),
        ("<>", None),
        ("<ext:a | ext:h>", Or((Filter("ext", "a"), Filter("ext", "h>")))),
        ("case:A", Term("A", case_sensitive=True)),
        ("wholeword:a", Term("a", S.WHOLE_WORD)),
    ],
)
def test_parse(query, tree):
    assert S.parse(query) == tree


@pytest.mark.parametrize(
    "text, expected",
    [
        ("hello", PathQuery(S.PLAIN, "hello")),
        ("/abc/def", PathQuery(S.SEGMENTS, "def", (Segment("abc"),))),
        ("/abc/def/", PathQuery(S.DIRECTORY, "def", (Segment("abc"),))),
        ("/abc/def/*", PathQuery(S.CHILDREN, "def", (Segment("abc"),))),
        ("/abc/*/def", PathQuery(S.SEGMENTS, "def", (Segment("abc", False),))),
        ("/usr", PathQuery(S.SEGMENTS, "usr")),
        ("A/b/c", PathQuery(S.SEGMENTS, "c", (Segment("a"), Segment("b")))),
        ("*/lib/*", PathQuery(S.PLAIN, "*/lib/*")),
        ("a/b*/c", PathQuery(S.PLAIN, "a/b*/c")),
        ("/", PathQuery(S.PLAIN)),
    ],
)
def test_path_query(text, expected):
    assert S.path_query(text) == expected


def test_rewrite():
    assert S.rewrite(Term("A/b")) == And((PathSegments((Segment("a"),)), Term("b", name_only=True)))
    assert S.rewrite(Term("a/b/")) == And((PathSegments((Segment("a"),)), And((Term("b", S.WHOLE_NAME, name_only=True), Filter("folder")))))
    assert S.rewrite(Term("*.CPP")) == Term("*.cpp", S.GLOB)
    assert S.rewrite(Term("a*", S.REGEX)) == Term("a*", S.REGEX)
    assert S.scoring_text(S.rewrite(S.parse("!x ext:a <*.b | Cde>"))) == "cde"
    assert S.scoring_text(S.rewrite(S.parse("regex:a ext:b"))) is None


@pytest.mark.parametrize(
    "argument, expected",
    [
        (">1kb", (">", 1024, 0)), ("<=1.5k", ("<=", 1536, 0)), ("5", ("=", 5, 0)), ("", ("=", 0, 0)), ("1mb..2mb", ("..", 1 << 20, 2 << 20)),
        ("..1mb", ("..", 0, 1 << 20)), ("1mb..", ("..", 1 << 20, 0)), ("100kb-5mb", ("=", 100, 0)), ("3parsecs", ("=", 3, 0)), (">=2T", (">=", 2 << 40, 0)), ("abc", ("=", 0, 0)),
    ],
)
def test_comparison(argument, expected):
    assert S.comparison(argument) == expected


CAL = Calendar(datetime(2024, 1, 31, 12, tzinfo=UTC))
DAY = 86400
JAN31 = 1706659200


@pytest.mark.parametrize(
    "argument, expected",
    [
        ("today", ("..", JAN31, JAN31 + DAY - 1)), ("yesterday", ("..", JAN31 - DAY, JAN31 - 1)), ("thisweek", ("..", JAN31 - 3 * DAY, JAN31 + 4 * DAY - 1)), ("lastweek", ("..", JAN31 - 10 * DAY, JAN31 - 3 * DAY - 1)),
        ("thismonth", ("..", JAN31 - 30 * DAY, JAN31 + DAY - 1)), ("lastmonth", ("..", 1701388800, 1704067199)), ("lastyear", ("..", 1672531200, 1704067199)), ("last7days", ("..", JAN31 - 7 * DAY, JAN31 + DAY // 2)),
        ("last1month", ("..", 1703980800, JAN31 + DAY // 2)), ("2024-01-15", ("..", 1705276800, 1705363199)), ("2023", ("..", 1672531200, 1704067199)), (">2024-01-01", (">", 1704153599, 0)), (">=2024-01-01", (">=", 1704067200, 0)),
        ("<today", ("<", JAN31, 0)), ("<=today", ("<=", JAN31 + DAY - 1, 0)), ("2023..today", ("..", 1672531200, JAN31 + DAY - 1)), ("junk", ("..", 0, 0)), (">junk", (">", 0, 0)), ("2024-ab", None), ("", ("=", 0, 0)), ("lastfoo", ("..", 0, 0)),
    ],
)
def test_dates(argument, expected):
    assert CAL.comparison(argument) == expected


def test_dates_follow_the_wall_clock():
    berlin = Calendar(datetime(2024, 4, 2, 12, tzinfo=UTC), "Europe/Berlin")
    lo, hi = berlin.bounds("2024-03-31")
    assert hi - lo + 1 == 23 * 3600


def test_home():
    assert S.prepare("  ~/x ", "/home/me") == "/home/me/x"
    assert S.prepare("~", "/home/me") == "/home/me"
    assert S.prepare("a~/x", "/home/me") == "a~/x"
