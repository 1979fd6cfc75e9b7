"""Dates in notice texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound

#: fixed values: German month names without accents
MONTHS = "januar februar marz april mai juni juli august september oktober november dezember".split()
WEEKDAYS = "montag dienstag mittwoch donnerstag freitag samstag sonntag".split()
DAY = r"(\d{1,2})\.\s*(\d{1,2})\."
_MONTH = "|".join(MONTHS).replace("marz", "m[aä]rz")
#: a date as d.m. or as d. month, either with a year or not
PART = rf"(?:\d{{1,2}}\.\s?\d{{1,2}}\.\s?(?:20\d{{2}})?|(?:(?:{'|'.join(WEEKDAYS)}),?\s?)?\d{{1,2}}\.\s?(?:{_MONTH})(?:\s?20\d{{2}})?)"
DASHED = rf"(?i){PART}\s?[–—-]\s?{PART}"
WORDED = rf"(?i)\bvom\b\s?{PART}.{{0,40}}?\bbis\b\s?(?:zum\s)?{PART}"


def _int(x: Column) -> Column:
    return x.try_cast("int")


def make(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where the calendar has no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def normalize(x: Column) -> Column:
    """ISO dates, d.m.yyyy and German textual dates; else null."""
    t = F.trim(F.lower(F.translate(F.coalesce(x, F.lit("")), "äÄ", "aa")))
    iso = F.regexp_extract(t, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    part = lambda p, i: F.regexp_extract(t, p, i)
    dotted, word = r"^(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})$", r"(?:^|,\s*)(\d{1,2})\.?\s+([a-z]+)\s+(\d{4})$"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), part(word, 2))
    return F.coalesce(
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
        make(part(dotted, 3), part(dotted, 2), part(dotted, 1)),
        make(part(word, 3), month, part(word, 1)),
    )


def with_range(rows: DataFrame, text: str, first: str, last: str) -> DataFrame:
    """Adds the first and last day of a range in a text: 'a - b', else 'vom a bis b', the days in figures or with a
    month's name.

    A missing year is the other's; a start without a year that would lie after the end is a year earlier. Without a year
    or a valid day at both ends there is no range. The span is searched once and its ends are read from it alone, and
    both are made as rows of a list, so that no later filter on them reads the text again.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")
    span = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, p, 0), F.lit("")) for p in (DASHED, WORDED)))
    patterns = (rf"(?i)^(?:vom\s?)?({PART})", rf"(?i)({PART})$")
    ends = lambda x: F.struct(*(F.lower(F.regexp_extract(x, p, 1)).alias(k) for k, p in zip("ab", patterns, strict=True)))
    month = lambda c: F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.translate(F.regexp_extract(c, rf"({_MONTH})", 1), "ä", "a"))
    of = lambda c: F.struct(
        F.regexp_extract(c, r"20\d{2}", 0).try_cast("int").alias("y"),
        F.coalesce(F.regexp_extract(c, r"\d{1,2}\.\s?(\d{1,2})\.", 1).try_cast("long"), month(c)).alias("m"),
        F.regexp_extract(c, r"(\d{1,2})\.", 1).try_cast("int").alias("d"),
    )
    days = lambda e: F.struct(of(e["a"]).alias("a"), of(e["b"]).alias("b"))

    def dated(e):
        a, b = e["a"], e["b"]
        return F.struct(a.alias("a"), b.alias("b"), make(F.coalesce(a["y"], b["y"]), a["m"], a["d"]).alias("start"), make(F.coalesce(b["y"], a["y"]), b["m"], b["d"]).alias("end"))

    def settled(r):
        late = (r["start"] > r["end"]) & r["a"]["y"].isNull()
        return F.struct(F.when(late, make(r["b"]["y"] - 1, r["a"]["m"], r["a"]["d"])).otherwise(r["start"]).alias("start"), r["end"].alias("end"))

    def both(r):
        there = r["start"].isNotNull() & r["end"].isNotNull()
        return F.struct(F.when(there, r["start"]).alias(first), F.when(there, r["end"]).alias(last))

    found = plain
    for step in (span, ends, days, dated, settled, both):
        found = bound(found, step)
    return rows.select(*(c for c in rows.columns if c not in (first, last)), F.inline(F.array(found)).alias(first, last))


def import_dates(rows: DataFrame, publication: Column, deadline: Column, text: str, reference: Column) -> DataFrame:
    """Adds publication_date and deadline_date: a range in the text beats the fields; a publication after the reference is blanked."""
    rows = with_range(rows, text, "_first", "_last")
    pub = F.coalesce("_first", publication)
    return rows.withColumns({"publication_date": F.when(pub <= reference, pub), "deadline_date": F.coalesce("_last", deadline)}).drop("_first", "_last")
