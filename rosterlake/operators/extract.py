"""Profiles: a pluggable extractor, and the checks of what it says.

An extractor is a callable from text to a dict. Failures become rows with ``status`` failed, never failed tasks; network errors are
tried again a few times. The default one works by rules, so results are the same everywhere.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fields, text
from ..functions.bind import bound

POSITION = "struct<title:string,company:string,start:string,end:string,is_current:boolean,source_lines:array<int>>"
PROFILE = f"struct<desired_position:string,positions:array<{POSITION}>,skills:array<string>,total_years:double,city:string,summary:string>"
_STRINGS = pa.list_(pa.string())
_POSITION = pa.struct({"title": pa.string(), "company": pa.string(), "start": pa.string(), "end": pa.string(), "is_current": pa.bool_(), "source_lines": pa.list_(pa.int32())})
_PROFILE = pa.struct({"desired_position": pa.string(), "positions": pa.list_(_POSITION), "skills": _STRINGS, "total_years": pa.float64(), "city": pa.string(), "summary": pa.string()})
#: Spellings of "until now", and attempts after network errors.
NOW, ATTEMPTS = r"(?iu)^(?:по )?(?:настоящее время|н\.?\s?в\.?|сейчас|present|now)$", 3

_JOB = re.compile(r"\s*(\d{4}(?:-\d{2})?)\s*[-–—]\s*(\d{4}(?:-\d{2})?|[^\d,]+?)\s*[:,]?\s+([^,]+),\s*(.+)")
_SKILLS = re.compile(r"(?i)\s*(?:навыки|skills)\s*:\s*(.+)")


class TemporaryError(Exception):
    """A network error or a busy service: worth another try."""


def rule_extractor(body: str) -> dict:
    """Positions of lines like ``2019-03 - 2021-05 Welder, Steel Works``; skills after ``skills:``."""
    positions, skills, lines = [], [], (body or "").split("\n")
    for k, line in enumerate(lines, 1):
        if m := _JOB.match(line):
            start, end, title, company = m.groups()
            positions.append({"title": title.strip(), "company": company.strip(), "start": start, "end": end.strip(), "source_lines": [k]})
        elif m := _SKILLS.match(line):
            skills += [s.strip() for s in m[1].split(",") if s.strip()]
    first = next((x.strip() for x in lines if x.strip()), None)
    return {"desired_position": first, "positions": positions, "skills": skills}


def extract(docs: DataFrame, extractor: Callable[[str], dict] = rule_extractor, pause: float = 0.5) -> DataFrame:
    """``doc_id, text, profile, status, error`` of each row of ``docs(doc_id, text)``."""

    def one(body: str) -> tuple[dict | None, str, str | None]:
        for k in range(ATTEMPTS):
            try:
                return extractor(body), "parsed", None
            except TemporaryError as e:
                error = str(e)
                time.sleep(pause * 2**k)
            except Exception as e:  # this record's own failure
                return None, "failed", str(e)
        return None, "failed", error

    def listed(x):
        return x if x is None or isinstance(x, list) else list(x)

    def plain(p: dict) -> dict:
        jobs = [{k: x.get(k) for k in jobs_have} | {"source_lines": listed(x.get("source_lines"))} for x in p.get("positions") or []]
        return {k: p.get(k) for k in has} | {"positions": jobs, "skills": listed(p.get("skills"))}

    jobs_have, has = [f.name for f in _POSITION], [f.name for f in _PROFILE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profiles, status, errors = zip(*map(one, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            held = pa.array([None if p is None else plain(p) for p in profiles], _PROFILE, from_pandas=True)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), held, pa.array(status, pa.string()), pa.array(errors, pa.string())], ["doc_id", "text", "profile", "status", "error"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, profile {PROFILE}, status string, error string")


def checked(parsed: DataFrame, as_of_month: int) -> DataFrame:
    """Adds what code can verify: line ranges, company keys, open ends, and years counted from the positions.

    Each column comes from ``profile`` and ``text`` alone, so Spark doesn't compute those that nobody reads."""

    def is_now(p: Column) -> Column:
        return F.coalesce(p["is_current"], F.lit(False)) | F.coalesce(p["end"].rlike(NOW), F.lit(False))

    def fixed(p: Column, now: Column, all_lines: Column) -> Column:
        return F.struct(
            fields.without_company(p["title"], p["company"]).alias("title"),
            p["company"].alias("company"),
            fields.company_key(p["company"]).alias("company_key"),
            p["start"].alias("start"),
            F.when(~now, p["end"]).alias("end"),
            now.alias("is_current"),
            text.valid_range(p["source_lines"], all_lines).isNotNull().alias("lines_ok"),
        )

    def span(p: Column) -> Column:
        stop = F.when(is_now(p), F.lit(as_of_month)).otherwise(dates.month_index(p["end"], True)) + 1
        return F.struct(dates.month_index(p["start"]).cast("long").alias("start"), stop.cast("long").alias("stop"))

    each = lambda all_lines: F.transform("profile.positions", lambda p: bound(is_now(p), lambda now: fixed(p, now, all_lines)))
    years = F.round(dates.union_months(F.transform("profile.positions", span)) / 12, 1)
    rows = parsed.withColumn("positions", bound(text.lines(F.col("text")), each)).withColumn("company_keys", F.transform("profile.positions.company", fields.company_key))
    rows = rows.withColumn("years_counted", years).withColumn("relocation", text.relocation(F.col("text"), F.lit("unknown")))
    rows = rows.withColumn("city", F.coalesce(fields.normalize_city(F.col("profile.city")), fields.extract_city(F.col("text"))))
    stated = F.col("profile.total_years")
    return rows.withColumn("years_mismatch", F.coalesce(F.abs(stated - F.col("years_counted")) > 1, F.lit(False))).withColumn("summary", text.grounded(F.col("profile.summary"), F.col("text"), F.col("years_counted")))


def passage(profile_columns: DataFrame, most: int = 1500) -> DataFrame:
    """``doc_id, passage``: what is embedded of a record; without a profile the beginning of its text."""
    jobs = F.transform(F.slice("profile.positions", 1, 4), lambda p: F.concat_ws(", ", p["title"], p["company"]))
    card = F.concat_ws("\n", "profile.desired_position", F.array_join(jobs, "\n"), F.array_join("profile.skills", ", "), "profile.summary", "profile.city")
    return profile_columns.select("doc_id", F.when(F.col("profile").isNotNull(), card).otherwise(F.substring("text", 1, most)).alias("passage"))


#: Fields that take lists and numbers; all others take text.
LIST_FIELDS, NUMBER_FIELDS = ("skills", "languages"), ("total_years", "salary_amount")


def checked_edit(field: Column, raw: Column) -> Column:
    """``struct(value, error)`` of what a person typed: lists lose blanks, numbers become plain ones; a number that isn't one, or is below zero, is an error."""
    parts = F.array_join(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    number = F.translate(F.regexp_replace(raw, r"(?U)\s", ""), ",", ".").try_cast("double")
    good = number.isNotNull() & (number >= 0) & (number < F.lit(float("inf")))
    shown = F.when((field == "salary_amount") | (number == F.floor(number)), F.floor(number).cast("string")).otherwise(number.cast("string"))
    numeric = field.isin(*NUMBER_FIELDS)
    value = F.when(field.isin(*LIST_FIELDS), parts).when(numeric, F.when(good, shown)).otherwise(F.trim(raw))
    return F.struct(value.alias("value"), F.when(numeric & ~F.coalesce(good, F.lit(False)), "a number from zero on is needed").alias("error"))


def edited(values: DataFrame, edits: DataFrame) -> DataFrame:
    """``doc_id, field, value, edited_at``: a person's last good edit of ``edits(doc_id, field, value, at)`` wins over what is extracted again."""
    good = edits.withColumn("_checked", checked_edit(F.col("field"), F.col("value"))).where("_checked.error IS NULL")
    latest = good.groupBy("doc_id", "field").agg(F.max_by("_checked.value", "at").alias("edit"), F.max("at").alias("edited_at"))
    rows = values.join(latest, ["doc_id", "field"], "full")
    return rows.select("doc_id", "field", F.when(F.col("edited_at").isNotNull(), F.col("edit")).otherwise(F.col("value")).alias("value"), "edited_at")
