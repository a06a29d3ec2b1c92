"""Queries of what happens at the desk: linking files, undoing merges, corrections, schedules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, evaluate, mergelog, metrics, resolve, schedule, search, vacancy
from ..operators.stored import Scratch
from ..streaming import events, repeats
from .evaluation import _CHECKED, _checked
from .retrieval import candidates, table

_LETTERS = "бвгджзклмн"


def _names():
    """A name for each document: surname by number, one of three first names, a patronymic for each second."""
    code = F.initcap(F.translate(F.col("doc_id").cast("string"), "0123456789", _LETTERS))
    first = F.element_at(F.array(*map(F.lit, ("Иван", "Петр", "Анна"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return F.concat(code, F.lit("ов "), first, F.when(F.col("doc_id") % 2 == 0, " Ильич").otherwise(""))


def linked_files(spark, sf_dir):
    """Pages as files of three batches, named by a record's id, its file, its name, or not at all."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("external_id"), F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 2), F.lit(".txt")).alias("source_file"),
        _names().alias("full_name"), (F.col("doc_id") % 3).alias("batch_id"), F.when(F.col("doc_id") % 11 == 0, F.lit(0)).alias("duplicate_of"),
    )
    named = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * 7 % 300).alias("doc_id"), "html").withColumn("full", _names())
    kind = F.col("page_id") % 5
    name = F.when(kind == 0, F.concat(F.col("doc_id"), F.lit("_cv.txt"))).when(kind == 1, F.concat(F.lit("src1-"), F.floor(F.col("doc_id") / 2), F.lit(".txt")))
    name = name.when(kind == 2, F.concat(F.replace("full", F.lit(" "), F.lit("_")), F.lit(".docx"))).otherwise(F.concat(F.lit("scan "), F.col("page_id"), F.lit(".txt")))
    body = F.when(kind == 3, F.concat(F.lit("\n"), F.array_join(F.slice(F.split("full", " "), 1, 2), " "), F.lit("\nmore"))).otherwise(F.lit("no name"))
    files = named.select(F.col("page_id").alias("file_id"), name.alias("name"), body.alias("text"), (F.col("page_id") % 3).alias("batch_id"))
    return resolve.link_files(files, records)


def body_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    owners = docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id") % 40).alias("contact"))
    said = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 3) % 40).alias("contact"))
    seen = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return resolve.body_pairs(owners, said, seen)


def merged_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("key"), F.concat("source", F.lit(":"), "lang").alias("name"))
    heads = docs.groupBy("key").agg(F.min("id").alias("head"))
    rows = docs.join(heads, "key").withColumn("duplicate_of", F.when((F.col("head") < F.col("id")) & (F.col("id") % 5 > 0), F.col("head")))
    sure = F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.7)
    pairs = rows.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 5 > 0, "merged").otherwise("open").alias("status"), sure.alias("confidence"))
    return resolve.merged_list(pairs, rows)


def replayed_merges(spark, sf_dir):
    """Customers after a log that the orders tell: each order merges, edits or undoes within its customer's ten."""
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("city"),
        F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("phones"),
    )
    return mergelog.replayed(people, _log(spark, sf_dir), ["name", "city"], ["phones"])[0].select("id", "name", "city", F.array_join("phones", ",").alias("phones"), "duplicate_of")


def _log(spark, sf_dir):
    key, ten = F.col("o_custkey"), F.floor(F.col("o_custkey") / 10) * 10
    main, old = ten + 1 + F.col("o_orderkey") % 9, ten + 1 + F.floor(F.col("o_orderkey") / 9) % 9
    kind = F.when(F.col("o_orderkey") % 7 == 0, "edit").when(F.col("o_orderkey") % 3 == 0, "unmerge").otherwise("merge")
    return table(spark, sf_dir, "orders").where(main != old).select(
        F.col("o_orderkey").alias("seq"), kind.alias("kind"), main.alias("main"), F.when(kind != "edit", old).alias("old"), F.when(key % 5 == 0, F.array(F.lit("city"))).alias("take"), F.lit("city").alias("field"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("value"),
    )


def corrections(spark, sf_dir):
    """What people noted on each customer and nation; each event is a note."""
    kinds = F.when(F.col("event_type") == "click", "misread").when(F.col("event_type") == "view", "irrelevant").otherwise("other")
    feedback = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 25).cast("long").alias("vacancy_id"), F.col("user_id").alias("candidate_id"), F.when(F.col("event_id") % 400 == 0, "all").otherwise("vacancy").alias("scope"),
        F.when(F.col("event_id") % 100 == 0, kinds).otherwise(F.when(kinds == "irrelevant", "other").otherwise(kinds)).alias("kind"), F.col("event_type").alias("comment"),
    )
    pairs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("vacancy_id"), F.col("c_custkey").alias("candidate_id"))
    found = vacancy.corrections(feedback, pairs)
    return found.select("vacancy_id", "candidate_id", F.size("corrections").cast("long").alias("n"), F.sha1(F.array_join("corrections", "\n")).alias("said"))


_ASKED = (("r1", "must", "Знание учёта", None), ("r2", "nice", "Мужчина до 40 лет", "discriminatory"), ("r3", "avoid", "только продажи", None))
_OFFER = "Нужен мастер. Возраст до 40 лет; опыт от 5 лет.\nМужчина до 40 лет. График сменный!"


def evaluation_prompts(spark, sf_dir):
    """What an evaluator is asked about each document."""
    asked = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(f).cast("string").alias("flag")) for i, k, n, f in _ASKED))
    noted = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("«"), "source", F.lit("» isn't agreed with")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select(
        F.lit(7).alias("vacancy_id"), F.col("doc_id").alias("candidate_id"), F.lit("Мастер").alias("title"), F.lit(_OFFER).alias("description"), asked.alias("requirements"), noted.alias("corrections"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("structure"), F.lit(None).cast("string").alias("name"), "text",
    )
    return vacancy.prompts(rows).select("candidate_id", F.sha1("prompt").alias("prompt"))


def _awake(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))


def _fires(spark, sf_dir):
    """A schedule for each user: on all days or on weekdays, at an hour of their own, over the days of their events."""
    spans = _awake(spark, sf_dir).groupBy("id").agg(F.to_date(F.min("at")).alias("first"), F.to_date(F.max("at")).alias("last"))
    days = F.when(F.col("id") % 2 == 0, F.sequence(F.lit(1), F.lit(7))).otherwise(F.sequence(F.lit(1), F.lit(5)))
    return schedule.expected(spans.select("id", "first", "last", days.alias("days"), (F.col("id") % 24).cast("int").alias("hour"), F.lit(30).alias("minute")))


def missed_fires(spark, sf_dir):
    """What became of each fire: a worker is awake whenever its user does something."""
    found = schedule.outcomes(_fires(spark, sf_dir), _awake(spark, sf_dir))
    return found.select("id", F.unix_timestamp("fire").alias("fire"), "status", F.unix_timestamp("started_at").alias("started_at"))


def fires_around(spark, sf_dir):
    moments = _awake(spark, sf_dir).distinct()
    found = schedule.around(moments, _fires(spark, sf_dir))
    return found.select("id", F.unix_micros("at").alias("at"), F.unix_timestamp("previous").alias("previous"), F.unix_timestamp("next").alias("next"), schedule.is_absent(F.col("previous"), F.col("at")).alias("absent"))


def _runs(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    planned = F.col("o_orderdate").cast("timestamp")
    late = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 20).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", state.alias("status"), planned.alias("planned_at"), (planned + late).alias("started_at"), F.when(F.col("o_orderkey") % 3 == 0, "import").alias("waited_for"))


def run_lateness(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    return rows.select("run_id", vacancy.lateness(F.col("planned_at"), F.col("started_at"), F.col("waited_for")).alias("late"))


def run_alert(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    rows = rows.withColumn("late", vacancy.lateness(F.col("planned_at"), F.col("started_at"), F.col("waited_for")))
    return vacancy.alert(rows, rows.where("run_id % 2 = 0").select("run_id"), F.expr("TIMESTAMP'1990-01-01'"))


def next_run_line(spark, sf_dir):
    records = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 6 == 0, F.lit(1)).alias("duplicate_of"), F.date_add(F.lit("1998-06-01").cast("date"), (F.col("c_custkey") % 100).cast("int")).cast("timestamp").alias("imported_at"))
    offers = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 3 == 0).alias("schedule_enabled"))
    return vacancy.next_line(records, _runs(spark, sf_dir), offers)


def report_sections(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    counts = rows.groupBy("source").agg(*(F.count_if(F.col("category") == c).alias(c) for c in ("fit", "maybe", "failed")), F.count_if(F.col("quality").isNull()).alias("new"), F.lit(0).alias("stale"))
    return vacancy.sections(counts)


def requirement_edits(spark, sf_dir):
    """Each brand's types as requirements, one added, dropped or replaced, with the version and what still counts."""
    types = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    made = F.transform("t", lambda x, k: F.struct(F.concat(F.lit("r"), k + 1).alias("id"), x.alias("name"), F.when(k % 3 == 0, "discriminatory").alias("flag")))
    held = types.select("p_brand", made.alias("requirements"), F.lit(1).alias("version"))
    new = vacancy.next_id(F.transform("requirements", lambda r: r["id"]))
    item = lambda id_: F.struct(id_.alias("id"), F.lit("own").alias("name"), F.lit(None).cast("string").alias("flag"))
    shown = lambda rows, name: rows.select("p_brand", F.lit(name).alias("edit"), "version", F.array_join(F.transform("requirements", lambda r: F.concat_ws("=", r["id"], r["name"])), ",").alias("all"), F.size(vacancy.scored_requirements(F.col("requirements"))).alias("scored"))
    edits = (("add", new), ("drop", F.lit("r2")), ("set", F.lit("r1")), ("set", F.lit("r0")))
    found = [shown(vacancy.edited(held, kind, item(id_)), f"{kind}{k}") for k, (kind, id_) in enumerate(edits)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def saved_scores(spark, sf_dir):
    key = F.col("o_orderkey")
    state, reason = F.when(key % 2 == 0, "ok").otherwise("failed"), F.when(key % 5 == 0, "new").otherwise("retry")
    old, before = F.when(key % 3 > 0, (key % 100).cast("int")), F.when(key % 4 > 0, (key % 50).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluate.saved_score(state, old, before, reason).alias("previous"))


def contact_search(spark, sf_dir):
    """Who has exactly this address, this number, and this surname (a first word)."""
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.element_at(F.array(*map(F.lit, ("Никитин", "Никитина", "никитин"))), (F.col("c_custkey") % 3 + 1).cast("int")), F.when(F.col("c_custkey") % 2 == 0, " Олег").otherwise("")).alias("full_name"),
        F.array(F.concat(F.lower("c_mktsegment"), F.lit("@mail.example"))).alias("emails"), F.array(F.format_string("+7912%07d", F.col("c_custkey") % 50)).alias("phones"),
    )
    asked = (("email", " Building@mail.example "), ("phone", "8 (912) 000-00-07"), ("surname", "Никитин"))
    found = [vacancy.by_contact(people, kind, query).select("c_custkey", F.lit(kind).alias("kind")) for kind, query in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])


def waiting_records(spark, sf_dir):
    """What parsing jobs take: all that wait, a trial of twenty, and a failed job's records again."""
    rows = candidates(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, F.lit(0)).alias("duplicate_of"), F.when(F.col("quality").isNull(), "new").when(F.col("quality") == 0, "failed").otherwise("parsed").alias("status"))
    job = table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    kinds = {"all": vacancy.scope(rows, "all"), "trial": vacancy.scope(rows, "trial"), "retry": vacancy.scope(rows, "retry", job)}
    found = [x.select("id", F.lit(k).alias("job")) for k, x in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def recounted(spark, sf_dir):
    """How many evaluations a note of each kind makes anew."""
    matches = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "invite").alias("decision"))
    return vacancy.recount(matches, "irrelevant").withColumn("kind", F.lit("irrelevant")).unionByName(vacancy.recount(matches, "misread").withColumn("kind", F.lit("misread")))


def first_of_person(spark, sf_dir):
    """A run in which each text counts once, at its best place."""
    run = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), "doc_id", F.sha1("text").alias("person"), "n_chars")
    run = evaluate.placed(run, [F.desc("n_chars"), F.col("doc_id")], ["qid"], "place")
    return metrics.once_a_person(run)


def full_plan(spark, sf_dir):
    """A full run over the first 100 of the pool, and all matches of an old version."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("hash"), "n_chars")
    pool = evaluate.placed(docs, [F.desc("n_chars"), F.col("id")], [], "place").drop("n_chars")
    at = F.lit("2024-01-16").cast("timestamp_ntz")
    matches = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("ok").alias("status"), (F.col("doc_id") % 2).cast("int").alias("version"), F.lit("x").alias("hash"), F.when(F.col("toxic") == 1, "reject").alias("decision"), at.alias("evaluated_at"), F.lit("old reason").alias("change_reason"))
    none = spark.createDataFrame([], "id long, at timestamp_ntz")
    return evaluate.plan(pool, matches, 1, none, limit=100, top_n=40)


def city_page(spark, sf_dir):
    """Active records of one city by their own word or their profile's, freshest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("city"), F.struct(F.col("o_orderstatus").alias("city")).alias("parsed"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(1)).alias("duplicate_of"), F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")).alias("resume_date"))
    found = search.active(rows).where(search.by_city("F") | search.by_city("1-URGENT"))
    return search.page(found, search.freshest_first(), number=1, size=200).select("id")


def cached_answers(spark, sf_dir):
    """Documents summed up by a model whose answers are kept: those of half the documents were asked for before."""
    tables = Scratch(spark, "answers")
    cache = answers.Cache(spark, tables.path("cache"), "summary")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("n_chars") % 7).alias("prompt"))
    cache.answered(rows.where("doc_id % 2 = 0"), "prompt", _summary, tables).agg(F.count_if("asked")).first()
    return cache.answered(rows, "prompt", _summary, tables).select("doc_id", "response", "error", "asked")


def _summary(prompt: str) -> str:
    if prompt.endswith("/6"):
        raise ValueError("no summary")
    return f"{prompt.upper()}: {len(prompt)}"


def streamed_repeats(spark, sf_dir):
    """The events of each user but for repeats, judged by the stream up to its last watermark."""
    tables = Scratch(spark, "repeats")
    stream = repeats.once(events.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", gap=3600)
    found = repeats.run_appended(stream, tables.path("out"), tables.path("checkpoint"))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.floor(F.max("ms") / 1000).alias("last"))


QUERIES = {
    f.__name__: f
    for f in (cached_answers, streamed_repeats, linked_files, body_pairs, merged_list, replayed_merges, corrections, evaluation_prompts, missed_fires, fires_around, run_lateness, run_alert, next_run_line, report_sections, requirement_edits, saved_scores, contact_search, waiting_records, recounted, first_of_person, full_plan, city_page)
}

_SQL_NAMES = f"""upper(translate(doc_id::VARCHAR, '0123456789', '{_LETTERS}')[1]) || translate(doc_id::VARCHAR, '0123456789', '{_LETTERS}')[2:] || 'ов ' || ['Иван', 'Петр', 'Анна'][doc_id % 3 + 1] || CASE WHEN doc_id % 2 = 0 THEN ' Ильич' ELSE '' END"""
_SQL_RUNS = """r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderdate::TIMESTAMP AS planned_at,
  o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 20) AS started_at, CASE WHEN o_orderkey % 20 > 10 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'waited for import' ELSE 'slept' END END AS late FROM orders)"""
_SQL_FIRES = """a AS (SELECT user_id AS id, ts AS awake FROM events),
s AS (SELECT id, min(awake)::DATE AS first, max(awake)::DATE AS last FROM a GROUP BY id),
d AS (SELECT id, unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM s),
f AS (SELECT id, day + to_hours(id % 24) + INTERVAL 30 MINUTE AS fire FROM d WHERE id % 2 = 0 OR isodow(day) <= 5)"""

ORACLES = {
    "cached_answers": """WITH p AS (SELECT doc_id, concat_ws('/', lang, source, n_chars % 7) AS prompt FROM documents)
SELECT doc_id, CASE WHEN NOT ends_with(prompt, '/6') THEN upper(prompt) || ': ' || length(prompt) END AS response, CASE WHEN ends_with(prompt, '/6') THEN 'no summary' END AS error,
ends_with(prompt, '/6') OR prompt NOT IN (SELECT prompt FROM p WHERE doc_id % 2 = 0) AS asked FROM p""",
    "streamed_repeats": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events WHERE epoch_us(ts) // 1000000 < (SELECT (max(epoch_us(ts)) // 1000 - 86400000) // 1000 FROM events)),
r AS (SELECT user_id, min(s) AS s FROM e GROUP BY 1 UNION ALL SELECT r.user_id, min(e.s) FROM r JOIN e ON e.user_id = r.user_id AND e.s > r.s + 3600 GROUP BY r.user_id)
SELECT user_id, count(*) AS n, max(s) AS last FROM r GROUP BY 1""",
    "linked_files": f"""WITH r AS (SELECT doc_id AS id, doc_id::VARCHAR AS external_id, source || '-' || (doc_id // 2) || '.txt' AS source_file, {_SQL_NAMES} AS full_name, doc_id % 3 AS batch FROM documents WHERE doc_id % 11 <> 0),
p AS (SELECT page_id, page_id * 7 % 300 AS doc_id FROM pages),
n AS (SELECT page_id, doc_id, {_SQL_NAMES} AS full_name FROM p),
q AS (SELECT page_id, page_id % 3 AS batch, CASE page_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'src1' WHEN 2 THEN string_split(full_name, ' ')[1] ELSE 'scan' END AS token,
  CASE page_id % 5 WHEN 1 THEN 'src1-' || (doc_id // 2) || '.txt' END AS file, CASE page_id % 5 WHEN 2 THEN full_name END AS titled, CASE page_id % 5 WHEN 3 THEN array_to_string(string_split(full_name, ' ')[1:2], ' ') END AS found FROM n),
m AS (SELECT q.*, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE external_id = token) AS o0, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE source_file = file) AS o1,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE r.batch = q.batch AND full_name = titled) AS o2,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE r.batch = q.batch AND (full_name = array_to_string(string_split(titled, ' ')[1:2], ' ') OR full_name LIKE array_to_string(string_split(titled, ' ')[1:2], ' ') || ' %')) AS o3,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE r.batch = q.batch AND full_name = found) AS o4,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM r WHERE r.batch = q.batch AND (full_name = found OR full_name LIKE found || ' %')) AS o5 FROM q)
SELECT page_id AS file_id, coalesce(o0, o1, o2, o3, o4, o5) AS owner, CASE WHEN o0 IS NOT NULL THEN 'id' WHEN o1 IS NOT NULL THEN 'file' WHEN o2 IS NOT NULL THEN 'titled name' WHEN o3 IS NOT NULL THEN 'titled words' WHEN o4 IS NOT NULL THEN 'found name' WHEN o5 IS NOT NULL THEN 'found words' END AS rule FROM m""",
    "body_pairs": """WITH o AS (SELECT source || '/' || (doc_id % 40) AS contact, max(doc_id) AS owner FROM documents GROUP BY 1),
s AS (SELECT doc_id, source || '/' || (doc_id // 3 % 40) AS contact FROM documents WHERE doc_id % 3 = 0)
SELECT DISTINCT least(doc_id, owner) AS a, greatest(doc_id, owner) AS b, 'open' AS status, 0.5 AS confidence FROM s JOIN o USING (contact)
WHERE doc_id <> owner AND NOT (abs(doc_id - owner) = 1 AND least(doc_id, owner) IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "merged_list": """WITH d AS (SELECT doc_id AS id, source || ':' || lang AS name, min(doc_id) OVER (PARTITION BY sha1(text)) AS head FROM documents)
SELECT x.head AS a, x.id AS b, y.name AS name_a, x.name AS name_b FROM d x JOIN d y ON y.id = x.head WHERE x.head < x.id AND x.id % 5 > 0 AND x.id % 2 = 0""",
    "corrections": """WITH f AS (SELECT event_id AS id, event_id % 25 AS v, user_id AS c, event_id % 400 = 0 AS every, event_type, CASE WHEN event_type = 'click' THEN 'misread' WHEN event_type = 'view' AND event_id % 100 = 0 THEN 'irrelevant' ELSE 'other' END AS kind FROM events),
l AS (SELECT *, '«' || event_type || '» ' || CASE kind WHEN 'misread' THEN 'was understood wrongly' WHEN 'irrelevant' THEN 'doesn''t matter here' ELSE 'isn''t agreed with' END AS line FROM f),
p AS (SELECT c_nationkey::BIGINT AS vacancy_id, c_custkey AS candidate_id FROM customer),
m AS (SELECT vacancy_id, candidate_id, id, line FROM p JOIN l ON c = candidate_id AND (v = vacancy_id OR every)
  UNION SELECT vacancy_id, candidate_id, id, line FROM p JOIN l ON kind = 'irrelevant' AND (v = vacancy_id OR every))
SELECT vacancy_id, candidate_id, count(id) AS n, sha1(coalesce(string_agg(line, chr(10) ORDER BY id), '')) AS said FROM p LEFT JOIN m USING (vacancy_id, candidate_id) GROUP BY ALL""",
    "evaluation_prompts": r"""SELECT doc_id AS candidate_id, sha1(array_to_string(list_filter(['Vacancy 7, candidate ' || doc_id, 'Title: Мастер', 'Description:' || chr(10) || 'Нужен мастер. опыт от 5 лет. График сменный!',
'Requirements:' || chr(10) || '- r1 [must] Знание учёта' || chr(10) || '- r3 [avoid] только продажи', CASE WHEN doc_id % 3 = 0 THEN 'Corrections of earlier evaluations:' || chr(10) || '«' || source || '» isn''t agreed with' END,
'Known: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'not parsed' END,
'Text, lines numbered:' || chr(10) || array_to_string(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda k: k || '| ' || string_split(text, chr(10))[k]), chr(10))], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS prompt FROM documents""",
    "missed_fires": f"""WITH {_SQL_FIRES},
m AS (SELECT f.id, fire, awake FROM f ASOF LEFT JOIN a ON f.id = a.id AND a.awake >= f.fire),
l AS (SELECT *, max(fire) OVER (PARTITION BY id, awake) AS last, epoch(date_trunc('second', awake))::BIGINT - epoch(fire)::BIGINT AS late FROM m)
SELECT id, epoch(fire)::BIGINT AS fire, CASE WHEN awake IS NULL THEN 'waiting' WHEN fire < last THEN 'coalesced' WHEN late > 21600 THEN 'missed' ELSE 'run' END AS status,
CASE WHEN awake IS NOT NULL AND fire = last AND late <= 21600 THEN epoch(date_trunc('second', awake))::BIGINT END AS started_at FROM l""",
    "fires_around": f"""WITH {_SQL_FIRES}, m AS (SELECT DISTINCT id, awake FROM a)
SELECT id, epoch_us(awake) AS "at", epoch((SELECT max(fire) FROM f WHERE f.id = m.id AND fire <= awake))::BIGINT AS previous, epoch((SELECT min(fire) FROM f WHERE f.id = m.id AND fire > awake))::BIGINT AS next, false AS absent FROM m""",
    "run_lateness": f"WITH {_SQL_RUNS} SELECT run_id, late FROM r",
    "run_alert": f"""WITH {_SQL_RUNS}, l AS (SELECT * FROM r ORDER BY run_id DESC LIMIT 1)
SELECT run_id, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'running' AND run_id % 2 = 1 THEN 'broken' WHEN status = 'running' THEN 'running' WHEN planned_at < TIMESTAMP '1990-01-01' - INTERVAL 1 MINUTE THEN 'absent' WHEN late IS NOT NULL THEN 'late' END AS alert FROM l""",
    "next_run_line": f"""WITH {_SQL_RUNS}, t AS (SELECT arg_max(started_at, run_id) AS done FROM r WHERE status = 'done')
SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0) AS vacancies, (SELECT count(*) FROM customer, t WHERE c_custkey % 6 <> 0 AND DATE '1998-06-01' + (c_custkey % 100)::INT >= done) AS fresh""",
    "report_sections": f"""WITH {_CHECKED}, n AS (SELECT unnest([{{'place': 0, 'section': 'failed', 'n': count(*) FILTER (category = 'failed')}}, {{'place': 1, 'section': 'fit', 'n': count(*) FILTER (category = 'fit')}}, {{'place': 2, 'section': 'maybe', 'n': count(*) FILTER (category = 'maybe')}}, {{'place': 4, 'section': 'new', 'n': count(*) FILTER (quality IS NULL)}}]) AS x FROM c)
SELECT x.place AS place, x.section AS section, x.n AS n FROM n WHERE x.n > 0""",
    "requirement_edits": """WITH t AS (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS t FROM part GROUP BY 1),
r AS (SELECT p_brand, len(t) AS n, list_transform(range(1, len(t) + 1), lambda k: 'r' || k || '=' || t[k]) AS rs FROM t)
SELECT p_brand, 'add0' AS edit, 2 AS version, array_to_string(list_append(rs, 'r' || (n + 1) || '=own'), ',') AS "all", (n - (n + 2) // 3 + 1)::INT AS scored FROM r
UNION ALL SELECT p_brand, 'drop1', CASE WHEN n > 1 THEN 2 ELSE 1 END, array_to_string(list_filter(rs, lambda x: NOT starts_with(x, 'r2=')), ','), (n - (n + 2) // 3 - (n > 1)::INT)::INT FROM r
UNION ALL SELECT p_brand, 'set2', 2, array_to_string(list_concat(['r1=own'], rs[2:]), ','), (n - (n + 2) // 3 + 1)::INT FROM r
UNION ALL SELECT p_brand, 'set3', 1, array_to_string(rs, ','), (n - (n + 2) // 3)::INT FROM r""",
    "saved_scores": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN o_orderkey % 100 WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 4 > 0 THEN o_orderkey % 50 END::INT AS previous FROM orders",
    "contact_search": """SELECT c_custkey, 'email' AS kind FROM customer WHERE lower(c_mktsegment) = 'building' UNION ALL SELECT c_custkey, 'phone' FROM customer WHERE c_custkey % 50 = 7
UNION ALL SELECT c_custkey, 'surname' FROM customer WHERE c_custkey % 3 <> 1""",
    "waiting_records": """WITH r AS (SELECT d.doc_id AS id, quality FROM documents d LEFT JOIN labels USING (doc_id))
SELECT id, 'all' AS job FROM r WHERE id % 9 <> 0 AND quality IS NULL UNION ALL (SELECT id, 'trial' FROM r WHERE id % 9 <> 0 AND quality IS NULL ORDER BY id LIMIT 20) UNION ALL SELECT id, 'retry' FROM r WHERE quality = 0 AND id % 2 = 0""",
    "recounted": "SELECT count(*) FILTER (toxic <> 1) AS n, 'irrelevant' AS kind FROM labels UNION ALL SELECT 1, 'misread'",
    "first_of_person": """WITH r AS (SELECT source AS qid, doc_id, sha1(text) AS person, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents),
f AS (SELECT qid, person, arg_min(doc_id, place) AS doc_id, min(place) AS place FROM r GROUP BY 1, 2)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS place FROM f""",
    "full_plan": """WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN id % 2 <> 1 THEN 'vacancy_changed' ELSE 'resume_updated' END AS reason FROM p LEFT JOIN labels l ON l.doc_id = id WHERE (place <= 100 OR id % 2 <> 1 AND l.doc_id IS NOT NULL) AND coalesce(toxic, 0) <> 1""",
    "city_page": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END DESC NULLS LAST, o_orderkey DESC LIMIT 200",
}
