"""Vacancies: requirements, queries from them, corrections, runs and their reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts, names, text
from ..functions.bind import bound
from . import ranked
from .stored import Scratch

#: Requirements kept of each kind, and wording that is unfair or vague. Ages in numbers are unfair where a line isn't of experience.
MOST = {"must": 6, "nice": 4, "avoid": 3}
_NOT_EXPERIENCE = r"(?![^\n]*(?:опыт|стаж|человек|сотрудник|подчинен|команд))"
UNFAIR = (
    r"(?iumU)возраст|\bлет\s+до\b|\bдо\s+\d{2}\s+лет|\bот\s+\d{2}\s+до\s+\d{2}\s+лет|моложе|старше\s+\d"
    r"|мужчин|женщин|\bпол\b|национальн|славян|внешност|семейн|замуж|женат|без\s+детей"
    r"|\bдет(?:и|ей)\b|беремен|прописк|девушк|\bпар(?:ень|ни|ня)\b"
    r"|молод(?:ой|ая|ые|ых|ого|ому|ым|ую)\b|холост|детьми|бездет"
    r"|(?:мужск|женск)\w*\s+пол[аеу]?\b"
    rf"|^{_NOT_EXPERIENCE}[^\n]*?\b\d{{2}}\s*[–—-]\s*\d{{2}}\s*лет"
    rf"|^{_NOT_EXPERIENCE}(?=[^\n]*(?:возраст|кандидат|не\s+старше))[^\n]*?\b\d{{2}}\s*\+"
)
VAGUE = (
    r"(?iuU)^(?:есть\s+|наличие\s+|иметь\s+)?опыт(?:\s+работы)?\.?$|^хорош\w*\s|^отличн\w*\s"
    r"|стрессоустойчив|коммуникабельн|ответственн|исполнительн|желание\s+работать|обучаем"
)


def flag(name: Column) -> Column:
    """Unfair beats vague."""
    return F.when(name.rlike(UNFAIR), "discriminatory").when(name.rlike(VAGUE), "vague")


def kept_requirements(drafts: DataFrame) -> DataFrame:
    """The first of each kind of ``drafts(vacancy, place, name, kind)``, numbered and flagged."""
    order = F.row_number().over(Window.partitionBy("vacancy", "kind").orderBy("place"))
    most = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in MOST.items()))
    kept = drafts.withColumn("_k", order).where(F.col("_k") <= most).drop("_k")
    number = F.row_number().over(Window.partitionBy("vacancy").orderBy("place"))
    weight = F.when(F.col("kind") == "nice", 1).otherwise(2)
    return kept.withColumns({"id": F.concat(F.lit("r"), number.cast("string")), "weight": weight, "flag": flag(F.col("name"))})


def next_id(ids: Column) -> Column:
    """The id after the largest number in use."""
    return F.concat(F.lit("r"), (F.coalesce(F.array_max(F.transform(ids, lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("int"))), F.lit(0)) + 1).cast("string"))


def query_text(title: Column, requirements: Column, description: Column) -> Column:
    """Title, what is wanted, and the description; what to avoid isn't searched for."""
    wanted = F.transform(F.filter(requirements, lambda r: r["kind"] != "avoid"), lambda r: r["name"])
    return F.concat_ws("\n", title, F.array_join(wanted, "\n"), description)


def scored_requirements(requirements: Column) -> Column:
    return F.filter(requirements, lambda r: ~r["flag"].eqNullSafe("discriminatory"))


#: What a note says of an evaluation, by its kind.
NOTES = {"not_in_resume": "isn't in the text", "misread": "was understood wrongly", "irrelevant": "doesn't matter here"}


#: Fixed value: keys over which the pairs of a vacancy are dealt.
_DEALS = 64


def corrections(feedback: DataFrame, pairs: DataFrame) -> DataFrame:
    """``vacancy_id, candidate_id, corrections`` for each of ``pairs(vacancy_id, candidate_id)``: lines, by id, of what ``feedback(id, vacancy_id,
    candidate_id, scope, kind, comment)`` says of it: notes on the candidate for this vacancy or for all, and what is irrelevant to the whole
    vacancy, or to all of them, whoever it was noted on.

    Notes on everything are read as one value. A note is in one of the lists only, so no list is searched for another's notes: what is irrelevant to a
    vacancy is said to its pairs anyway and left out of the candidates' notes. Lists are sorted before they meet, and pairs without notes of their own take their
    vacancy's lines as they are."""
    said = F.coalesce(*(F.when(F.col("kind") == k, x) for k, x in NOTES.items()), F.lit("isn't agreed with"))
    everywhere, general = F.col("scope").eqNullSafe("all"), F.col("kind").eqNullSafe("irrelevant")
    told = feedback.select("vacancy_id", "candidate_id", everywhere.alias("everywhere"), general.alias("general"), F.struct(F.col("id").cast("long").alias("id"), F.concat(F.lit("«"), F.coalesce("comment", F.lit("")), F.lit("» "), said).alias("line")).alias("note"))
    gathered = lambda rows, name, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_set("note")).alias(name))
    for_all = told.where("general AND everywhere")
    of_vacancy = told.where("general AND NOT everywhere").select("vacancy_id", "note").join(for_all.select("note").distinct(), "note", "left_anti")
    pairs = pairs.select("vacancy_id", "candidate_id")
    single = told.where("NOT general")
    one = single.where("NOT everywhere").select("vacancy_id", "candidate_id", "note")
    rest = single.where("everywhere").select("candidate_id", "note").join(pairs.distinct(), "candidate_id").select("vacancy_id", "candidate_id", "note")
    own = gathered(one.union(rest), "own", "vacancy_id", "candidate_id")
    lines = lambda notes: F.transform(notes, lambda x: x["line"])
    every = for_all.agg(F.sort_array(F.collect_set("note")).alias("notes")).select(F.struct("notes", lines(F.col("notes")).alias("said"))).scalar()
    whole = gathered(of_vacancy, "whole", "vacancy_id").withColumn("every", every)
    whole = whole.select("vacancy_id", F.sort_array(F.concat("whole", "every.notes")).alias("whole"))
    # a vacancy's pairs are dealt over several keys
    whole = whole.withColumns({"said": lines(F.col("whole")), "_deal": F.explode(F.sequence(F.lit(0), F.lit(_DEALS - 1)))})
    rows = pairs.join(own, ["vacancy_id", "candidate_id"], "left").withColumn("_deal", F.pmod(F.xxhash64("candidate_id"), F.lit(_DEALS)).cast("int"))
    rows = rows.join(whole, ["vacancy_id", "_deal"], "left").withColumn("every", every)
    shared, as_is = F.coalesce("whole", "every.notes"), F.coalesce("said", "every.said")
    merged = F.when(F.col("own").isNull(), as_is).otherwise(lines(F.sort_array(F.concat("own", shared))))
    return rows.select("vacancy_id", "candidate_id", merged.alias("corrections"))


def fair_description(description: Column, requirements: Column) -> Column:
    """``struct(kept, cut)``: the description's sentences without and with what is unfair, or what a requirement flagged so names."""
    parts = F.filter(F.transform(F.split(F.coalesce(description, F.lit("")), r"(?U)(?<=[.!?;])\s+|\n+"), lambda x: F.trim(x)), lambda p: p != "")
    flagged = F.transform(F.filter(requirements, lambda r: r["flag"].eqNullSafe("discriminatory")), lambda r: F.lower(r["name"]))
    unfair = lambda p: p.rlike(UNFAIR) | F.exists(flagged, lambda name: F.contains(F.lower(p), name))
    return bound(parts, lambda ps: F.struct(F.filter(ps, lambda p: ~unfair(p)).alias("kept"), F.filter(ps, unfair).alias("cut")))


def prompts(rows: DataFrame) -> DataFrame:
    """Adds ``prompt``, what an evaluator is asked about each of ``rows(vacancy_id, candidate_id, title, description, requirements, corrections, structure,
    name, text)``: the fair part of the description, the requirements in use, corrections without personal data, what is known, and numbered lines.

    ``text`` is de-identified already; ``structure`` is null for a record that isn't parsed."""
    asked = F.transform(scored_requirements(F.col("requirements")), lambda r: F.concat(F.lit("- "), r["id"], F.lit(" ["), r["kind"], F.lit("] "), r["name"]))
    noted = F.transform("corrections", lambda x: text.anonymize(x, F.col("name")))
    section = lambda head, body: F.concat(F.lit(f"{head}\n"), body)
    parts = [
        F.concat(F.lit("Vacancy "), F.col("vacancy_id").cast("string"), F.lit(", candidate "), F.col("candidate_id").cast("string")),
        F.concat(F.lit("Title: "), F.col("title")),
        section("Description:", F.array_join(fair_description(F.col("description"), F.col("requirements"))["kept"], " ")),
        section("Requirements:", F.array_join(asked, "\n")),
        F.when(F.size("corrections") > 0, section("Corrections of earlier evaluations:", F.array_join(noted, "\n"))),
        F.concat(F.lit("Known: "), F.coalesce("structure", F.lit("not parsed"))),
        section("Text, lines numbered:", text.numbered(F.col("text"))),
    ]
    return rows.withColumn("prompt", F.concat_ws("\n\n", *parts))


def recount(matches: DataFrame, kind: Column | str) -> DataFrame:
    """One row: how many candidates of ``matches(decision)`` a correction scores again: one, or all that aren't rejected if it is irrelevant."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return matches.agg(F.when(kind == "irrelevant", F.count_if(~F.col("decision").eqNullSafe("reject"))).otherwise(1).cast("long").alias("n"))


def renumbered(requirements: Column, edit: str, item: Column | None = None) -> Column:
    """Requirements after an edit: ``add`` appends, ``drop`` removes the one with the id of ``item``, ``set`` replaces it."""
    if edit == "add":
        return F.array_append(requirements, item)
    if edit == "drop":
        return F.filter(requirements, lambda r: r["id"] != item["id"])
    return F.transform(requirements, lambda r: F.when(r["id"] == item["id"], item).otherwise(r))


def edited(vacancies: DataFrame, edit: str, item: Column) -> DataFrame:
    """``vacancies(requirements, version)`` after an edit; the version, by which evaluations are outdated, goes up where something changed."""
    after = renumbered(F.col("requirements"), edit, item)
    return vacancies.withColumns({"requirements": after, "version": F.col("version") + (~after.eqNullSafe(F.col("requirements"))).cast("int")})


def hard_filters(held: dict) -> dict:
    """A vacancy's filters as the search takes them: blanks and zeros are none; only fresh records can be asked for."""
    number = lambda k: float(held[k]) if held.get(k) not in (None, "") else None
    return {"city": held.get("city") or "", "min_years": number("min_years"), "max_salary": number("max_salary"), "fresh": "fresh" if held.get("fresh") else ""}


def query_kind(query: str, surname_exists) -> str:
    """How to search: by address, phone, name, surname, or by meaning."""
    q = query.strip()
    if re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", q):
        return "email"
    if sum(c.isdigit() for c in q) >= 10 and not re.search(r"[^\W\d_]", q):
        return "phone"
    words = q.split()
    if 2 <= len(words) <= 3 and all(re.fullmatch(r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?", w) for w in words):
        return "name"
    return "surname" if len(words) == 1 and surname_exists(words[0]) else "meaning"


def by_contact(people: DataFrame, kind: str, query: str) -> DataFrame:
    """Records with exactly this address, phone or name; a surname is a whole first word."""
    q = F.lit(query.strip())
    if kind == "email":
        return people.where(F.array_contains("emails", F.lower(q)))
    if kind == "phone":
        return people.where(F.exists("phones", lambda p: p.eqNullSafe(contacts.normalize_phone(q))))
    if kind == "name":
        return people.where(names.names_compatible(F.col("full_name"), q) & F.col("full_name").isNotNull())
    return people.where((F.lower("full_name") == F.lower(q)) | F.lower("full_name").startswith(F.concat(F.lower(q), F.lit(" "))))


def since_last_success(rows: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """Rows after the start of the last run that ended well."""
    return rows.withColumn("_since", runs.where("status = 'done'").agg(F.max("started_at").alias("t")).scalar()).where(F.col("_since").isNull() | (F.col(at) > F.col("_since"))).drop("_since")


def repaired_runs(runs: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """Runs that say they go on without a live job have failed."""
    alive = live_jobs.select("run_id").distinct().withColumn("_alive", F.lit(True))
    state = F.when((F.col("status") == "running") & F.col("_alive").isNull(), "failed").otherwise(F.col("status"))
    return runs.join(alive, "run_id", "left").withColumn("status", state).drop("_alive")


def lateness(planned: Column, started: Column, waited_for: Column, grace: int = 600) -> Column:
    """Why a run began late; null if it didn't."""
    late = F.unix_timestamp(started) - F.unix_timestamp(planned) > grace
    return F.when(late, F.when(waited_for.isNotNull(), F.concat(F.lit("waited for "), waited_for)).otherwise("slept"))


def once_a_minute(requests: DataFrame, key: list[str], at: str, id: str | None = None) -> DataFrame:
    """Requests but for repeats: those within a minute of the last one that wasn't a repeat, in order of time and ``id``, which is unique (without one, of the
    hash of all columns: then only equal rows tie).

    After a pause of more than a minute the next request always counts, so only the requests between two pauses meet in a task; such a burst
    is known by its first request, and pauses are found without a window over a whole key."""
    tables, order = Scratch(requests.sparkSession, "repeats"), [F.col("_s"), F.col("_id")]
    rows = requests.withColumns({"_s": F.unix_timestamp(at), "_id": F.col(id) if id else F.xxhash64(*requests.columns)})
    beside = ranked.neighbours(rows, tables, "beside", key, order, ["_s"])
    starts = beside.withColumn("_new", (F.col("_before").isNull() | (F.col("_s") - F.col("_before._s") > 60)).cast("long")).drop("_before", "_after")
    numbered = ranked.ranked(starts, tables, "bursts", key, order, sums={"_burst": "_new"}).withColumn("_burst", F.col("_burst") + F.col("_new"))
    names_ = [*key, "_burst"]
    ordered = numbered.drop("_new").repartition(*names_).sortWithinPartitions(*names_, *order)

    def kept(batches):
        held, last = None, 0
        for rows in batches:
            keep = []
            for *burst, s in zip(*(rows[c].tolist() for c in (*names_, "_s")), strict=True):
                keep.append(burst != held or s - last > 60)
                held, last = burst, s if keep[-1] else last
            yield rows[keep].drop(columns=["_burst", "_s"])

    return ordered.select(*requests.columns, "_s", "_burst").mapInPandas(kept, requests.schema)


def sections(summary: DataFrame) -> DataFrame:
    """The report's lines by urgency; empty ones don't come."""
    kinds = ("failed", "fit", "maybe", "changed", "new", "merged", "stale")
    parts = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("section"), F.col(c).cast("long").alias("n")) for k, c in enumerate(kinds) if c in summary.columns))
    return summary.select(F.explode(parts).alias("p")).select("p.*").groupBy("place", "section").agg(F.sum("n").alias("n")).where("n > 0").orderBy("place")


def alert(runs: DataFrame, live: DataFrame, expected: Column) -> DataFrame:
    """``run_id, alert`` of the last of ``runs(run_id, status, planned_at, started_at, late)``: the first that holds of failed or missed, broken,
    running, absent (an expected one never began) and late; one row with ``never`` if there is no run."""
    last = runs.agg(F.max_by(F.struct("run_id", "status", "planned_at", "started_at", "late"), "run_id").alias("r")).select("r.*")
    alive = live.select("run_id").distinct().withColumn("_alive", F.lit(True))
    going = F.col("status").isin("queued", "running")
    state = (
        F.when(F.col("run_id").isNull(), "never")
        .when(F.col("status").isin("failed", "missed"), F.col("status"))
        .when(going & F.col("_alive").isNull(), "broken")
        .when(going, "running")
        .when(F.coalesce("planned_at", "started_at") < expected - F.expr("INTERVAL 1 MINUTE"), "absent")
        .when(F.col("late").isNotNull(), "late")
    )
    return last.join(alive, "run_id", "left").select("run_id", state.alias("alert"))


def next_line(records: DataFrame, runs: DataFrame, vacancies: DataFrame) -> DataFrame:
    """One row ``vacancies, fresh``: what the next run will take: scheduled vacancies, and active records since the last run that ended well."""
    last = runs.where("status = 'done'").agg(F.max_by("started_at", "run_id").alias("t")).scalar()
    fresh = F.col("duplicate_of").isNull() & (last.isNull() | (F.col("imported_at") >= last))
    scheduled = vacancies.agg(F.count_if("schedule_enabled").alias("n")).scalar()
    return records.agg(F.count_if(fresh).alias("fresh")).select(scheduled.alias("vacancies"), "fresh")


def waiting(records: DataFrame, most: int | None = None) -> DataFrame:
    """``id`` of active records that aren't parsed yet, in order; ``most`` is the batch a person asked for."""
    rows = records.where("duplicate_of IS NULL AND status = 'new'").select("id").orderBy("id")
    return rows.limit(most) if most else rows


def scope(records: DataFrame, kind: str, job_ids: DataFrame | None = None, trial: int = 20, limit: int = 0) -> DataFrame:
    """What a parsing job takes: ``retry`` the failed ones of a job, ``trial`` the first few, ``all`` up to the limit (0: no limit)."""
    if kind == "retry":
        return records.where("status = 'failed'").join(job_ids.select("id"), "id", "left_semi").select("id")
    return waiting(records, trial if kind == "trial" else limit or None)


def appended(job_ids: Column, new_ids: Column) -> Column:
    """A live job's ids with new ones after them, without repeats."""
    return F.array_union(job_ids, new_ids)
