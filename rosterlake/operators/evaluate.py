"""Checklists: verdicts, scores, categories, ties, reasons, and what to evaluate again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bind import bound
from .ranked import neighbours, ranked
from .stored import Scratch

#: Worth of verdicts, cap of a vetoed score, thresholds, and the gap of a tie.
VALUES = {"met": 1.0, "partial": 0.5, "no_data": 0.25, "not_met": 0.0}
CAP, FIT_FROM, MAYBE_FROM, TIE = 30, 75, 55, 5
CHECKS = "array<struct<id:string,kind:string,weight:int,verdict:string>>"


def value(verdict: Column) -> Column:
    out = F.lit(VALUES["no_data"])
    for name, worth in VALUES.items():
        out = F.when(verdict == name, worth).otherwise(out)
    return out


def _sum(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))


def _count(array: Column, holds) -> Column:
    return F.size(F.filter(array, holds))


def vetoed(checks: Column) -> Column:
    return F.exists(checks, lambda c: ((c["kind"] == "must") & (c["verdict"] == "not_met")) | ((c["kind"] == "avoid") & (c["verdict"] == "met")))


def score(checks: Column) -> Column:
    """0 to 100, half to even; capped if vetoed, 0 without requirements."""
    counted = F.filter(checks, lambda c: c["kind"].isin("must", "nice"))
    total = _sum(counted, lambda c: c["weight"].cast("double"))
    points = F.bround(100 * _sum(counted, lambda c: c["weight"] * value(c["verdict"])) / F.when(total > 0, total)).cast("int")
    return F.when(total == 0, 0).when(vetoed(checks), F.least(points, F.lit(CAP))).otherwise(points)


def category(checks: Column, points: Column, ok: Column) -> Column:
    kind = lambda k: F.filter(checks, lambda c: c["kind"] == k)
    must, nice = kind("must"), kind("nice")
    met = lambda a: _count(a, lambda c: c["verdict"] == "met")
    some = _count(must, lambda c: c["verdict"].isin("met", "partial"))
    return (
        F.when(~ok | points.isNull(), "failed")
        .when(vetoed(checks), "unfit")
        .when((F.size(must) > 0) & (met(must) == F.size(must)), F.when((F.size(nice) == 0) | (2 * met(nice) > F.size(nice)), "fit").otherwise("maybe"))
        .when((F.size(must) == 0) & (points >= FIT_FROM), "fit")
        .when(2 * some < F.size(must), "unfit")
        .otherwise(F.when(points >= MAYBE_FROM, "maybe").otherwise("unfit"))
    )


def top_reasons(checks: Column, n: int = 3) -> Column:
    """The first good requirements: met before partial, must before nice, in their order."""
    good = F.filter(F.transform(checks, lambda c, k: F.struct(c["verdict"] != "met", c["kind"] != "must", k, c["id"].alias("id"), c["kind"].alias("kind"), c["verdict"].alias("verdict"))), lambda c: (c["kind"] != "avoid") & c["verdict"].isin("met", "partial"))
    return F.transform(F.slice(F.array_sort(good), 1, n), lambda c: c["id"])


def tied(rows: DataFrame, by: list[str], order: list[Column], points: str = "score") -> DataFrame:
    """Adds ``tied``: whether a neighbour in its group's order is less than ``TIE`` away. Places are found in two passes, not in a task for a group."""
    beside = neighbours(rows, Scratch(rows.sparkSession, "ties"), "beside", by, order, [points])
    near = lambda other: F.coalesce(F.abs(F.col(f"{other}.{points}") - F.col(points)) < TIE, F.lit(False))
    return beside.withColumn("tied", near("_before") | near("_after")).drop("_before", "_after")


def counter(checks: Column) -> Column:
    """Met of all, for musts and nice-to-haves that exist."""
    part = lambda k: F.when(_count(checks, lambda c: c["kind"] == k) > 0, F.concat(F.lit(f"{k} "), _count(checks, lambda c: (c["kind"] == k) & (c["verdict"] == "met")).cast("string"), F.lit("/"), _count(checks, lambda c: c["kind"] == k).cast("string")))
    return F.concat_ws(" ", part("must"), part("nice"))


def plan(pool: DataFrame, matches: DataFrame, version: int, feedback: DataFrame, limit: int | None = None, top_n: int | None = None) -> DataFrame:
    """``id, reason`` of what to evaluate: ``pool(id, hash[, place])`` against ``matches(id, status, version, hash, decision, evaluated_at[, change_reason])``
    and ``feedback(id, at)``; what is up to date or rejected doesn't come.

    limit: so many of the pool by its ``place``; from ``top_n`` on the run is full and takes all matches of old versions too, which are then part of
    ``pool`` beyond the limit. A failed match is tried again for its old reason, ``retry`` if that isn't known."""
    rows = pool.join(matches.withColumnRenamed("hash", "old_hash"), "id", "left").join(feedback.groupBy("id").agg(F.max("at").alias("at")), "id", "left")
    if limit is not None:
        chosen = F.col("place") <= limit
        rows = rows.where(chosen | (F.col("version") != version) if top_n is not None and limit >= top_n else chosen)
    again = F.coalesce("change_reason", F.lit("retry")) if "change_reason" in matches.columns else F.lit("retry")
    reason = (
        F.when(F.col("status").isNull(), "new")
        .when((F.col("version") != version) | (F.col("at") > F.col("evaluated_at")), "vacancy_changed")
        .when(~F.col("hash").eqNullSafe(F.col("old_hash")), "resume_updated")
        .when(F.col("status") == "failed", again)
    )
    return rows.where(~F.col("decision").eqNullSafe("reject")).withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")


ANSWERS = "array<struct<requirement_id:string,verdict:string,evidence_lines:array<int>,note:string>>"


def rule_answers(requirements: Column, body: Column) -> Column:
    """The default evaluator's answers (``ANSWERS``), as one expression: a requirement is met by a line with all of its words' first five letters, partly met by
    one with half of them; of equal lines the first counts."""
    words = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)), lambda w: F.substring(w, 1, 5)))

    def one(r: Column, held: Column) -> Column:
        def judged(wanted: Column) -> Column:
            shares = F.transform(held, lambda line, k: F.struct((F.size(F.array_intersect(wanted, line)) / F.greatest(F.size(wanted), F.lit(1))).alias("share"), (-k).alias("k")))
            return bound(F.array_max(shares), found)

        def found(best: Column) -> Column:
            verdict = F.when(best["share"] == 1, "met").when(best["share"] >= 0.5, "partial").otherwise("no_data")
            lines = F.when(best["share"] >= 0.5, F.array(1 - best["k"]))
            return F.struct(r["id"].alias("requirement_id"), verdict.alias("verdict"), lines.alias("evidence_lines"), F.lit("").alias("note"))

        return bound(words(F.coalesce(r["name"], F.lit(""))), judged)

    return bound(F.transform(text.lines(F.coalesce(body, F.lit(""))), words), lambda held: F.transform(requirements, lambda r: one(r, held))).cast(ANSWERS)


def answers(rows: DataFrame, evaluator: Callable[[list[dict], str], list[dict]] | None = None) -> DataFrame:
    """``rows(.., requirements, text)`` with ``answers, status, error`` of the evaluator, or of the default rules; a record that an evaluator fails on is a row with
    status failed."""
    if evaluator is None:
        return rows.withColumns({"answers": rule_answers(F.col("requirements"), F.col("text")), "status": F.lit("ok"), "error": F.lit(None).cast("string")})
    keys = ("requirement_id", "verdict", "evidence_lines", "note")

    def run(batches):
        for batch in batches:
            given, status, error = [], [], []
            for requirements, body in zip(batch["requirements"], batch["text"], strict=True):
                try:
                    asked = [r if isinstance(r, dict) else r.asDict() for r in requirements]
                    given.append([{k: a.get(k) for k in keys} for a in evaluator(asked, body)])
                    status.append("ok")
                    error.append(None)
                except Exception as e:  # this record's own failure
                    given.append(None)
                    status.append("failed")
                    error.append(str(e))
            yield batch.assign(answers=given, status=status, error=error)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, answers {ANSWERS}, status string, error string")


def checked(requirements: Column, given: Column, body: Column) -> Column:
    """Verdicts of an array of requirements by an evaluator's answers, as ``array<struct<id, kind, weight, verdict, lines, note, quote>>``.

    A verdict without lines that exist and say something is ``no_data``, as is a requirement without an answer, and one to avoid that its lines
    don't confirm."""

    def one(r: Column) -> Column:
        def with_lines(answer: Column, span: Column) -> Column:
            denied = (r["kind"] == "avoid") & (answer["verdict"] == "met") & ~text.shows(body, span, r["name"])
            verdict = F.when(span.isNull() | denied, "no_data").otherwise(F.coalesce(answer["verdict"], F.lit("no_data")))
            return bound(verdict, lambda v: told(answer, span, v))

        def told(answer: Column, span: Column, verdict: Column) -> Column:
            good = verdict != "no_data"
            return F.struct(
                r["id"].alias("id"),
                r["kind"].alias("kind"),
                r["weight"].alias("weight"),
                verdict.alias("verdict"),
                F.when(good, span).alias("lines"),
                F.coalesce(F.when(good, answer["note"]), F.lit("")).alias("note"),
                F.when(good, text.quote(body, span)).alias("quote"),
            )

        answer = F.try_element_at(F.filter(given, lambda a: a["requirement_id"] == r["id"]), F.lit(1))
        return bound(answer, lambda a: bound(text.valid_lines(a["evidence_lines"], body), lambda span: with_lines(a, span)))

    return F.transform(requirements, one)


def evaluated(rows: DataFrame, evaluator: Callable[[list[dict], str], list[dict]] | None = None) -> DataFrame:
    """``rows(.., requirements, text)`` with ``answers, status, checks, score, reasons``: the evaluator's answers, checked and scored."""
    out = answers(rows, evaluator).withColumn("checks", checked(F.col("requirements"), F.col("answers"), F.col("text")))
    out = out.withColumn("score", F.when(F.col("status") == "ok", score(F.col("checks"))))
    return out.withColumn("reasons", top_reasons(F.col("checks")))


def audited(rows: DataFrame, by: list[str]) -> DataFrame:
    """What an evaluator's raw answers are worth, by group of ``rows(.., answers, checks, text)``: ``claimed`` verdicts of something, ``with_lines`` of them with
    lines, ``valid`` with lines that exist and say something, and ``kept`` after all checks."""
    each = rows.select(*by, "text", F.explode(F.arrays_zip("answers", "checks")).alias("x")).select(*by, F.col("x.answers").alias("a"), F.col("x.checks.verdict").alias("verdict"), "text")
    claimed = F.col("a.verdict").isin("met", "partial")
    lines = F.coalesce(F.size("a.evidence_lines") > 0, F.lit(False))
    valid = text.valid_lines(F.col("a.evidence_lines"), F.col("text")).isNotNull()
    return each.groupBy(*by).agg(F.count_if(claimed).alias("claimed"), F.count_if(claimed & lines).alias("with_lines"), F.count_if(claimed & valid).alias("valid"), F.count_if(claimed & (F.col("verdict") != "no_data")).alias("kept"))


def shortlisted(matches: DataFrame, who: str) -> DataFrame:
    """Who goes on a shortlist of ``matches(decision, category)``: those invited (``who = 'invite'``), else all who fit and aren't rejected."""
    if who == "invite":
        return matches.where("decision = 'invite'")
    return matches.where(~F.col("decision").eqNullSafe("reject") & (F.col("category") == "fit"))


def in_shortlist_order() -> list[Column]:
    """The order of a shortlist: stale records last, then by score; no score is 0."""
    return [F.coalesce("stale", F.lit(False)), F.coalesce("score", F.lit(0)).desc(), F.col("id")]


def saved_score(old_status: Column, old_score: Column, old_previous: Column, reason: Column) -> Column:
    """The previous score after a new evaluation."""
    return F.when((old_status == "ok") & old_score.isNotNull(), old_score).when(reason == "new", F.lit(None)).otherwise(old_previous)


def in_group_order() -> list[Column]:
    return [F.col("stale"), F.desc("score"), F.coalesce("rank", F.lit(0)), F.col("id")]


def placed(pool: DataFrame, order: list[Column], by: list[str], place: str = "rank") -> DataFrame:
    """Adds each row's place in its group, in two passes; ``order`` ends with a unique id."""
    return ranked(pool, Scratch(pool.sparkSession, "places"), "rows", by, order, place)
