"""The role of an expression from its text, as a Spark column: the twin of `sql_text.classify` for bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.sql_text import AGGREGATES, HASHES, LONG_TYPES

_QUOTED = r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`"
_TYPE = "(?:" + "|".join(t.replace(" ", r"\s+") for t in sorted(LONG_TYPES, key=len, reverse=True)) + r"|\w+)(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?"
_VALUE = r"(?:\w+(?:\.\w+)*|q)"
_BARE_CAST = rf"(?i)^(?:cast|try_cast|safe_cast)\s*\(\s*(.*)\s+as\s+{_TYPE}\s*\)$"
_SHORT_CAST = rf"(?i)^(.*[\w)])\s*::\s*{_TYPE}$"
#: Casts nested deeper than this are not peeled.
DEPTH = 4


def _balanced(text: Column) -> Column:
    """Whether every closing parenthesis closes one that the text has opened."""
    marks = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    depth = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, c: F.struct(
            (a["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"),
            F.least(a["low"], a["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("low"),
        ),
    )
    return (depth["now"] == 0) & (depth["low"] == 0)


def _peel(text: Column) -> Column:
    """The text without one cast or pair of parentheses around it."""
    one = F.regexp_extract(text, _BARE_CAST, 1)
    two = F.regexp_extract(text, _SHORT_CAST, 1)
    three = F.regexp_extract(text, r"^\((.*)\)$", 1)
    peeled = F.when((one != "") & _balanced(one), one).when((two != "") & _balanced(two), two).when((three != "") & _balanced(three), three)
    return F.trim(F.coalesce(peeled, text))


def with_role(frame: DataFrame, text: str, source: str, target: str, into: str = "role") -> DataFrame:
    """Adds passthrough, rename, cast, transform, hash, aggregate or window; names in quotes and strings are no calls.

    Each peeled form is a column of its own, so that the next one refers to it and the plan stays small.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    frame = frame.withColumn("_plain", F.trim(F.regexp_replace(given, _QUOTED, "q"))).withColumn("_inner", F.col("_plain"))
    for _ in range(DEPTH):
        frame = frame.withColumn("_inner", _peel(F.col("_inner")))
    plain, inner = F.col("_plain"), F.col("_inner")
    window = plain.rlike(r"(?i)\bover\s*\(|\bover\s+\w+\s*$")
    aggregate = plain.rlike(r"(?i)(?<![\w.])(" + "|".join(sorted(AGGREGATES)) + r")\s*\(")
    call = F.regexp_extract(inner, r"(?i)^(" + "|".join(sorted(HASHES)) + r")\s*\((.*)\)$", 2)
    is_hash = inner.rlike(r"(?i)^(" + "|".join(sorted(HASHES)) + r")\s*\(.*\)$") & _balanced(call)
    cast = (inner != plain) & inner.rlike(rf"^{_VALUE}$") & plain.rlike(r"(?i)::|\b(cast|try_cast|safe_cast)\s*\(")
    copy = F.when(F.lower(source) == F.lower(target), "passthrough").otherwise("rename")
    bare = inner.rlike(r"^\w+(?:\.\w+)*$") & ~inner.rlike(r"^\d") & (inner != "q") & ~inner.rlike(r"(?i)^(null|true|false)$")
    found = F.when(plain == "", copy).when(window, "window").when(aggregate, "aggregate").when(is_hash, "hash").when(cast, "cast").when(bare, copy).otherwise("transform")
    return frame.withColumn(into, found).drop("_plain", "_inner")


def cut(text: Column, most: int = 500) -> Column:
    """(text, cut): at most `most` characters of a text, and whether some are missing."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.char_length(text) > most).alias("cut"))
