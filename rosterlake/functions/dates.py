"""Dates, ages and experience; the current day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound

#: Days after which a record is stale, and the labels of dates in texts.
STALE_DAYS = 548
DATE = r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b|\b(\d{4})-(\d{2})-(\d{2})\b"
BIRTH = r"(?iu)(?:дата рождения|родил(?:ся|ась)|д\.\s?р\.)\s*:?\s*(\d{1,2}[./]\d{1,2}[./](\d{4})|(\d{4}))|\b(\d{4})\s*г\.?\s*р\.?"
UPDATED = r"(?iu)(?:резюме обновлено|обновлено|дата резюме|дата обновления|актуально на)\s*:?\s*(\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2})"


def parse_date(text: Column) -> Column:
    """The first date of the text; null if it doesn't exist."""
    part = lambda k: F.regexp_extract(text, DATE, k)
    day_first = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    iso = F.concat_ws("-", part(4), part(5), part(6))
    return F.try_to_date(F.when(part(1) != "", day_first).when(part(4) != "", iso), "yyyy-MM-dd")


def parse_year(text: Column) -> Column:
    alone = F.regexp_extract(text, r"^\s*(\d{4})(?:\.0)?\s*$", 1)
    return F.coalesce(F.year(parse_date(text)), F.when(alone != "", alone.cast("int")))


def birth_year(text: Column, as_of: Column) -> Column:
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, BIRTH, k), F.lit("")) for k in (2, 3, 4))).cast("int")
    return F.when(found.between(1930, F.year(as_of) - 14), found)


def updated_on(text: Column) -> Column:
    return parse_date(F.regexp_extract(text, UPDATED, 1))


def is_stale(day: Column, as_of: Column) -> Column:
    return day.isNull() | (F.datediff(as_of, day) > STALE_DAYS)


def month_index(text: Column, end: bool = False) -> Column:
    """``YYYY`` or ``YYYY-MM`` as months; a lone year begins in January and ends in December."""
    month = lambda said: F.when(F.length(said) > 4, F.substring(said, 6, 2).cast("int")).otherwise(12 if end else 1)
    return bound(F.regexp_extract(text, r"^\d{4}(?:-\d{1,2})?", 0), lambda said: F.when(said != "", F.substring(said, 1, 4).cast("int") * 12 + month(said) - 1))


def union_months(spans: Column) -> Column:
    """Months covered by an array of half-open ``struct(start, stop)``; overlaps and touching spans count once."""
    ordered = F.sort_array(F.filter(spans, lambda s: s["start"] < s["stop"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-(1 << 31)).cast("long").alias("reach"))

    def add(done: Column, span: Column) -> Column:
        fresh = F.greatest(span["stop"] - F.greatest(span["start"], done["reach"]), F.lit(0))
        return F.struct((done["total"] + fresh).cast("long").alias("total"), F.greatest(done["reach"], span["stop"]).cast("long").alias("reach"))

    return F.aggregate(ordered, start, add, lambda done: done["total"])
