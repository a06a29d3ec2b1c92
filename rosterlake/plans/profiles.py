"""Queries of fields, vacancies, runs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import embed, extract, resolve, schedule, vacancy
from ..sources import documents
from .retrieval import candidates, table


#: Requirements and how they are flagged.
WORDING = {
    "Опыт сварки от 3 лет": None, "Возраст до 45 лет": "discriminatory", "Ответственность": "vague", "Команда 20+ человек": None, "Мужчина 25–35 лет": "discriminatory",
    "Опыт работы": "vague", "Молодой специалист": "discriminatory", "Чтение чертежей": None, "Стаж 10-15 лет": None, "Кандидат 45+": "discriminatory",
}


def resume_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.resume_hash(F.col("text"), F.lit(None).cast("date")).alias("hash"))


def display_fields(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", fields.thousands(n).alias("number"), fields.plural(n, "знак", "знака", "знаков").alias("noun"), fields.duration(n).alias("duration"), fields.cut(F.col("source"), 4).alias("cut"))


def compared_fields(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("bal"))
    x, y = F.col("x"), F.col("y")
    agree = fields.same_fields({"nation": F.lit(True), "segment": x["c_mktsegment"] == y["c_mktsegment"], "balance": F.abs(x["bal"] - y["bal"]) < 500})
    return resolve.all_pairs(people, "c_nationkey", order=("c_mktsegment", "bal")).select("a", "b", agree.alias("agree"))


def line_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", fields.line_spans(F.col("text")).alias("s"))
    return spans.select("doc_id", F.size("s").alias("n"), F.array_max("s.stop").alias("last"), F.col("s")[0]["stop"].alias("first"))


def best_paragraph(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(fields.best_paragraph(F.col("text"), ["the", "und"])).alias("best"))


def head_and_body(spark, sf_dir):
    head, body = fields.head_and_body(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(head).alias("head"), F.length(body).alias("body"))


def event_props(spark, sf_dir):
    parsed = fields.loose_json(F.regexp_replace("props", "0", "None"), "k int")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


def kept_requirements(spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("must"), F.lit("nice"), F.lit("avoid")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    wording = F.element_at(F.array(*map(F.lit, WORDING)), (F.col("l_partkey") % len(WORDING) + 1).cast("int"))
    drafts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vacancy"), "l_partkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    kept = vacancy.kept_requirements(drafts.select("vacancy", F.col("l_partkey").alias("place"), wording.alias("name"), kinds.alias("kind")))
    return kept.select("vacancy", "place", "id", "kind", "weight", "flag")


def query_texts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.struct(F.col("p_type").alias("name"), F.when(F.col("p_type") == "PROMO", "avoid").otherwise("must").alias("kind")))).alias("r"))
    return parts.select("p_brand", vacancy.query_text(F.col("p_brand"), F.col("r"), F.lit("end")).alias("text"))


def latest_feedback(spark, sf_dir):
    """Feedback of the vacancy, and of everybody where it is irrelevant to one."""
    events = table(spark, sf_dir, "events")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    own = events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("own"))
    every = events.where("event_type = 'search' AND value < 1").agg(F.max("ts").alias("t")).scalar()
    return people.join(own, "id", "left").withColumn("every", every).select("id", F.greatest("own", "every").alias("at_"))


def since_last_success(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    runs = table(spark, sf_dir, "orders").where("o_orderkey % 1000 = 1").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), F.col("o_orderdate").alias("started_at"))
    return vacancy.since_last_success(orders, runs, "at").select("o_orderkey")


def repaired_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return vacancy.repaired_runs(runs, runs.where("run_id % 3 = 0")).select("run_id", "status")


def schedule_fires(spark, sf_dir):
    """When a weekly schedule fires on the days of the events."""
    span = table(spark, sf_dir, "events").agg(F.lit(0).alias("id"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    days = span.withColumns({"days": F.array(*map(F.lit, (1, 3, 5))), "hour": F.lit(22), "minute": F.lit(0)})
    return schedule.expected(days).select(F.unix_timestamp("fire").alias("fire"))


def once_a_minute(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return vacancy.once_a_minute(events, ["event_type"], "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


def order_history(spark, sf_dir):
    """Orders of each nation's customers, newest first."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "c_custkey", "n_nationkey")


def sheet_safe(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), F.col("source")).alias("cell"))
    return documents.formula_safe(rows)


def upserted(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("old").alias("state"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("state"))
    return documents.upsert(old, new, ["id"])


def extracted_profiles(spark, sf_dir):
    """Profiles of orders written as texts: a line for each part, with its months."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    month = lambda c: F.date_format(c, "yyyy-MM")
    line = F.concat_ws(" ", month(F.col("l_shipdate")), F.lit("-"), month(F.add_months("l_shipdate", 2)), F.concat_ws(", ", "p_type", F.concat(F.lit("ООО «"), F.col("p_brand"), F.lit("»"))))
    parts = lines.select("l_orderkey", "l_linenumber", line.alias("line")).repartition("l_orderkey")
    texts = parts.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))).alias("x"))
    found = extract.checked(extract.extract(texts.select("doc_id", F.array_join("x.line", "\n").alias("text"))), 2024 * 12)
    return found.select("doc_id", "status", F.size("profile.positions").alias("n_positions"), "years_counted", F.array_join(F.sort_array(F.array_distinct("company_keys")), ",").alias("companies"))


def embedded_cards(spark, sf_dir):
    """Vectors made anew for documents whose vector is missing or of an older text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage"))
    held = embed.embed(docs.where("doc_id % 2 = 0"))
    after = embed.refreshed(docs.withColumn("passage", F.when(F.col("doc_id") % 4 == 0, F.concat("passage", F.lit(" new"))).otherwise(F.col("passage"))), held)
    return after.select("doc_id", "model", "hash", F.size("embedding").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (resume_hashes, display_fields, compared_fields, line_spans, best_paragraph, head_and_body, event_props, kept_requirements, query_texts, latest_feedback, since_last_success, repaired_runs, schedule_fires, once_a_minute, order_history, sheet_safe, upserted, extracted_profiles, embedded_cards)
}

ORACLES = {
    "head_and_body": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda k: len(list_filter(ls[1:k], lambda x: trim(x) <> '')) > 12 OR regexp_matches(ls[k], '(?i)^\s*(?:опыт работы|опыт|трудовая деятельность|experience)([^\p{L}]|$)'))) - 1, len(ls)) AS n FROM l)
SELECT doc_id, length(array_to_string(ls[1:n], chr(10)))::INT AS head, length(array_to_string(ls[n + 1:], chr(10)))::INT AS body FROM n""",
    "resume_hashes": "SELECT doc_id, sha1(text || chr(10) || 'None') AS hash FROM documents",
    "display_fields": """SELECT doc_id, replace(format('{:,}', n_chars), ',', ' ') AS number,
CASE WHEN n_chars % 10 = 1 AND n_chars % 100 <> 11 THEN 'знак' WHEN n_chars % 10 BETWEEN 2 AND 4 AND n_chars % 100 NOT BETWEEN 12 AND 14 THEN 'знака' ELSE 'знаков' END AS noun,
CASE WHEN n_chars < 60 THEN n_chars || ' s' ELSE concat_ws(' ', CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ' h' END, CASE WHEN n_chars % 3600 >= 60 THEN (n_chars % 3600 // 60) || ' min' END) END AS duration,
CASE WHEN length(source) > 4 THEN rtrim(source[1:3]) || '…' ELSE source END AS cut FROM documents""",
    "compared_fields": """SELECT x.c_custkey AS a, y.c_custkey AS b, concat_ws(', ', 'nation', CASE WHEN x.c_mktsegment = y.c_mktsegment THEN 'segment' END, CASE WHEN abs(floor(x.c_acctbal) - floor(y.c_acctbal)) < 500 THEN 'balance' END) AS agree
FROM customer x JOIN customer y USING (c_nationkey) WHERE x.c_custkey < y.c_custkey""",
    "line_spans": "SELECT doc_id, len(string_split(text, chr(10))) AS n, length(text) AS last, length(string_split(text, chr(10))[1]) AS first FROM documents",
    "best_paragraph": r"""WITH p AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 20)) AS p, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: length(x) > 20), 1) AS k FROM documents),
h AS (SELECT *, len(regexp_extract_all(' ' || lower(p), '[^\p{L}](?:the|und)')) AS hits FROM p),
b AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) AS r FROM h)
SELECT d.doc_id, sha1(p) AS best FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""",
    "event_props": "SELECT event_id, CASE WHEN props LIKE '%0%' AND regexp_extract(props, '([0-9]+)', 1) <> '0' THEN NULL ELSE nullif(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 0) END AS k FROM events",
    "kept_requirements": f"""WITH d AS (SELECT l_suppkey AS vacancy, l_partkey AS place, ['must', 'nice', 'avoid'][max(l_linenumber) % 3 + 1] AS kind FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY vacancy, kind ORDER BY place) AS n FROM d)
SELECT vacancy, place, 'r' || row_number() OVER (PARTITION BY vacancy ORDER BY place) AS id, kind, CASE WHEN kind = 'nice' THEN 1 ELSE 2 END AS weight,
[{", ".join(f"'{x}'" if x else "NULL" for x in WORDING.values())}][place % {len(WORDING)} + 1] AS flag FROM k WHERE n <= CASE kind WHEN 'must' THEN 6 WHEN 'nice' THEN 4 ELSE 3 END""",
    "query_texts": "SELECT p_brand, concat_ws(chr(10), p_brand, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) FILTER (p_type <> 'PROMO'), 'end') AS text FROM part GROUP BY p_brand",
    "latest_feedback": """WITH o AS (SELECT user_id AS id, max(ts) AS own FROM events GROUP BY 1), e AS (SELECT max(ts) AS every FROM events WHERE event_type = 'search' AND value < 1)
SELECT c_custkey AS id, greatest(own, every) AS at_ FROM customer LEFT JOIN o ON o.id = c_custkey, e""",
    "since_last_success": "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 1000 = 1 AND o_orderstatus = 'F')",
    "repaired_runs": "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'failed' END AS status FROM orders",
    "schedule_fires": "SELECT epoch(d + INTERVAL 22 HOUR)::BIGINT AS fire FROM (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events) WHERE isodow(d) IN (1, 3, 5)",
    "once_a_minute": """WITH RECURSIVE e AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
r AS (SELECT event_type, min(s) AS s FROM e GROUP BY 1 UNION ALL SELECT r.event_type, min(e.s) FROM r JOIN e ON e.event_type = r.event_type AND e.s > r.s + 60 GROUP BY r.event_type)
SELECT event_type, count(*) AS n FROM r GROUP BY 1""",
    "order_history": "SELECT o_orderkey, c_custkey, n_nationkey FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey",
    "sheet_safe": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '''=' ELSE '' END || source AS cell FROM documents",
    "upserted": "SELECT vec_id AS id, 'old' AS state FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' FROM labels",
    "extracted_profiles": """WITH l AS (SELECT l_orderkey, p_brand, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT l_orderkey, count(DISTINCT x) AS months FROM (SELECT l_orderkey, unnest(range(m, m + 3)) AS x FROM l) GROUP BY 1)
SELECT l_orderkey AS doc_id, 'parsed' AS status, count(*)::INT AS n_positions, round(any_value(months) / 12, 1) AS years_counted, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS companies
FROM l JOIN u USING (l_orderkey) GROUP BY 1""",
    "embedded_cards": "SELECT doc_id, 'hashing' AS model, sha1(CASE WHEN doc_id % 4 = 0 THEN text || ' new' ELSE text END) AS hash, 64 AS size FROM documents",
}
