"""Search history and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The keywords that are suggested.
KEYWORDS = [f"{k}:" for k in "ext size file folder path nopath parent depth len dm dc da datemodified datecreated dateaccessed case nocase regex ww wfn wholeword wholefilename audio video pic doc exe zip content type".split()]
CAP = 200


def history(searches: DataFrame, cap: int = CAP) -> DataFrame:
    """query, last_used, count from searches (query, ts): case ignored, last casing kept, the latest cap entries.

    Queries of one character and content searches (infile:) are left out.
    """
    q = searches.select(F.trim("query").alias("query"), "ts").where((F.length("query") >= 2) & ~F.lower("query").startswith("infile:"))
    each = q.groupBy(F.lower("query").alias("key")).agg(F.max_by("query", F.struct("ts", "query")).alias("query"), F.max("ts").alias("last_used"), F.count("*").alias("count"))
    return each.orderBy(F.desc("last_used"), "key").limit(cap).select("query", "last_used", "count")


def suggest(entries: DataFrame, prefix: str) -> DataFrame:
    """The entry that begins with prefix (case ignored) of the greatest count, then the latest."""
    hit = entries.where(F.lower("query").startswith(prefix.lower()) if prefix else F.lit(False))
    return hit.orderBy(F.desc("count"), F.desc("last_used"), "query").limit(1)


def suggest_keyword(text: str) -> str | None:
    """The shortest keyword that begins with a single unfinished word."""
    low = text.lower()
    if not low or " " in low or ":" in low:
        return None
    return min((k for k in KEYWORDS if k.startswith(low)), key=lambda k: (len(k), k), default=None)


def with_options(text: str, *, regex: bool = False, case: bool = False, whole_word: bool = False, whole_name: bool = False) -> str:
    """A query with one option as its prefix. Options that cannot be combined are refused."""
    chosen = [p for p, on in (("regex:", regex), ("case:", case), ("ww:", whole_word), ("wfn:", whole_name)) if on]
    if len(chosen) > 1:
        raise ValueError(f"{' and '.join(chosen)} cannot be combined")
    return chosen[0] + text if chosen and text else text
