"""Queries of personal data and judged texts, over the documents with lines about people added."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, text
from ..operators import evaluate, extract, metrics, people, search
from .desk import _LETTERS
from .retrieval import table


def _surname(number):
    return F.concat(F.initcap(F.translate(number.cast("string"), "0123456789", _LETTERS)), F.lit("ов"))


def _pick(number, *values):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def third_persons(spark, sf_dir):
    """Documents that name somebody in the dative: masked if the base (the customers) has the surname."""
    number = F.col("doc_id") * 3
    line = F.concat(F.lit("\nСпросите "), _surname(number), F.lit("у "), _pick(number, "Ивану", "Олегу", "Павлу"), F.lit(" из цеха, тел. И. у них нет."))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", line).alias("text"))
    base = table(spark, sf_dir, "customer").select(F.concat(_surname(F.col("c_custkey")), F.lit(" "), _pick(F.col("c_custkey"), "Иван", "Олег", "Павел"), F.lit(" Ильич")).alias("full_name"))
    return people.mask_people(docs, base).select("doc_id", F.sha1("text").alias("text"))


def own_names(spark, sf_dir):
    """Lines about a record's own person in many forms, with documents, a birth date, an age and contacts."""
    code, number = _surname(F.col("doc_id")), F.lpad(F.col("doc_id").cast("string"), 7, "0")
    lines = F.concat_ws(
        "\n", F.concat(code, F.lit(" Пётр Ильич")), F.concat(F.lit("Писать "), code, F.lit("у Петру Ильичу, не Анне.")), F.concat(F.lit("ИНН 77"), number, F.lit("3, табель "), F.col("doc_id").cast("string")),
        F.concat(F.lit("Родился "), F.format_string("%02d.02.1985", F.col("doc_id") % 28 + 1)), F.concat(F.lit("Возраст: "), (F.col("doc_id") % 40 + 20).cast("string"), F.lit(" лет")),
        F.concat(F.lit("тел. 8 (9"), F.substring(number, 1, 2), F.lit(") "), F.substring(number, 3, 3), F.lit("-11-"), F.substring(number, 6, 2)), F.lit("о Петре и с Петром"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("text"), F.concat(code, F.lit(" Петр Ильич")).alias("name"))
    return rows.select("doc_id", text.anonymize(F.col("text"), F.col("name")).alias("text"))


_ASKED = (("r1", "quality control", "must", 2), ("r2", "budget planning", "nice", 1), ("r3", "только продажи", "avoid", 2))


def _judged(spark, sf_dir):
    asked = [F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(w).alias("weight")) for i, n, k, w in _ASKED]
    k = F.col("doc_id")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("record "), k), F.when(k % 3 == 0, "- Quality control, daily").when(k % 3 == 1, "quality only").otherwise("other work"),
        F.when(k % 2 == 0, "planning of the budget"), F.when(k % 5 == 0, "работал только в продажах").when(k % 5 == 1, "не только продажи, но и цех"),
    )
    return evaluate.evaluated(table(spark, sf_dir, "documents").select("doc_id", lines.alias("text"), F.array(*asked).alias("requirements")))


def evaluated_lines(spark, sf_dir):
    """Texts of a few lines judged by the default evaluator: every verdict, a denied one, quotes and scores."""
    out = _judged(spark, sf_dir)
    said = F.array_join(F.transform("checks", lambda c: F.concat_ws(" ", c["id"], c["verdict"], F.array_join(c["lines"], "-"), c["quote"])), "; ")
    return out.select("doc_id", "status", "score", F.array_join("reasons", ",").alias("reasons"), said.alias("checks"))


def answers_audit(spark, sf_dir):
    """How many verdicts of each document's kind had lines, valid ones, and were kept."""
    return evaluate.audited(_judged(spark, sf_dir).withColumn("kind", F.col("doc_id") % 10), ["kind"])


def lexical_stemmed(spark, sf_dir):
    """BM25 without stop words and endings, for words that the documents have in other cases."""
    said = _pick(F.col("doc_id"), "продажа", "продажи", "станок", "о продажах")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), said, F.when(F.col("doc_id") % 5 == 0, " для цеха").otherwise("")).alias("text"))
    split = search.stemmed_tokens()
    item = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(split(F.lit("Продажами и в цехах для нас"))).alias("term"))
    return search.bm25(docs, item, split)


def places(spark, sf_dir):
    """Cities of records, as they are told in texts and in columns."""
    k = F.col("c_custkey")
    told = _pick(k, "Город: Самара", "проживает в г. Набережные Челны, улица", "место жительства Ростов-на-Дону", "город не указан", "Проживание: Тула и Орёл")
    held = _pick(k, "г. МОСКВА", "город нижний новгород", " Санкт-Петербург ", "", "УФА", "г. Йошкар-Ола", "ростов-на-дону")
    return table(spark, sf_dir, "customer").select("c_custkey", fields.extract_city(F.concat(F.lit("о себе\n"), told)).alias("told"), fields.normalize_city(held).alias("held"))


def profile_edits(spark, sf_dir):
    """A person's edits against what is extracted: bad numbers don't count, the last good edit does."""
    k = F.col("o_orderkey")
    field = _pick(k, "total_years", "skills", "city", "salary_amount")
    raw = F.when(k % 4 == 0, _pick(F.floor(k / 4), "5,5", "много", "-1", " 7 ", "1e400")).when(k % 4 == 1, "учёт, , план ").when(k % 4 == 2, " Тула ").otherwise(_pick(F.floor(k / 4), "120 000", "90000,7", "нет"))
    edits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), field.alias("field"), raw.alias("value"), k.alias("at"))
    values = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.lit("city"), F.lit("total_years"))).alias("field"), F.col("c_mktsegment").alias("value"))
    return extract.edited(values, edits)


def relevance_grades(spark, sf_dir):
    """Grades of parts for each supplier nation's rule by type, brand and size."""
    rules = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("qid"), _pick(F.col("n_nationkey"), "STANDARD", "PROMO", "ECONOMY").alias("profession"), F.array(F.format_string("Brand#%d", 11 + F.col("n_nationkey") % 5)).alias("best"),
        F.array(F.format_string("Brand#%d", 21 + F.col("n_nationkey") % 5)).alias("good"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("1"), F.lit("2"))).alias("needed"), F.when(F.col("n_nationkey") % 4 == 0, 3).otherwise(2).alias("needed_from"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ")[0].alias("profession"), F.col("p_brand").alias("title"), F.col("p_size").cast("string").alias("text"))
    return metrics.graded(parts, rules)


QUERIES = {f.__name__: f for f in (third_persons, own_names, evaluated_lines, answers_audit, lexical_stemmed, places, profile_edits, relevance_grades)}

_CODE = "upper(translate({0}::VARCHAR, '0123456789', '" + _LETTERS + "')[1]) || translate({0}::VARCHAR, '0123456789', '" + _LETTERS + "')[2:] || 'ов'"

ORACLES = {
    "answers_audit": """SELECT doc_id % 10 AS kind, count(*) FILTER (doc_id % 3 < 2) + count(*) FILTER (doc_id % 2 = 0) + count(*) FILTER (doc_id % 5 < 2) AS claimed, claimed AS with_lines, claimed AS valid,
count(*) FILTER (doc_id % 3 < 2) + count(*) FILTER (doc_id % 2 = 0) + count(*) FILTER (doc_id % 5 = 0) AS kept FROM documents GROUP BY 1""",
    "lexical_stemmed": r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) + 1 + (doc_id % 5 = 0)::INT AS dl, (doc_id % 4 <> 2)::INT AS a, (doc_id % 5 = 0)::INT AS b FROM documents),
t AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(a) AS na, sum(b) AS nb FROM d)
SELECT doc_id, round((a * ln(1 + (n - na + 0.5) / (na + 0.5)) + b * ln(1 + (n - nb + 0.5) / (nb + 0.5))) / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM d, t WHERE a + b > 0""",
    "places": """SELECT c_custkey, ['Самара', 'Набережные Челны', 'Ростов-на-Дону', NULL, 'Тула'][c_custkey % 5 + 1] AS told,
['Москва', 'Нижний Новгород', 'Санкт-Петербург', NULL, 'Уфа', 'Йошкар-Ола', 'Ростов-На-Дону'][c_custkey % 7 + 1] AS held FROM customer""",
    "profile_edits": """WITH e AS (SELECT o_custkey AS doc_id, ['total_years', 'skills', 'city', 'salary_amount'][o_orderkey % 4 + 1] AS field, o_orderkey AS k,
  CASE o_orderkey % 4 WHEN 0 THEN ['5.5', NULL, NULL, '7', NULL][o_orderkey // 4 % 5 + 1] WHEN 1 THEN 'учёт, план' WHEN 2 THEN 'Тула' ELSE ['120000', '90000', NULL][o_orderkey // 4 % 3 + 1] END AS v FROM orders),
l AS (SELECT doc_id, field, arg_max(v, k) AS edit, max(k) AS edited_at FROM e WHERE v IS NOT NULL GROUP BY 1, 2),
v AS (SELECT c_custkey AS doc_id, unnest(['city', 'total_years']) AS field, c_mktsegment AS value FROM customer)
SELECT doc_id, field, coalesce(edit, value) AS value, edited_at FROM v FULL JOIN l USING (doc_id, field)""",
    "relevance_grades": """WITH r AS (SELECT n_nationkey AS qid, ['STANDARD', 'PROMO', 'ECONOMY'][n_nationkey % 3 + 1] AS profession, 'Brand#' || (11 + n_nationkey % 5) AS best, 'Brand#' || (21 + n_nationkey % 5) AS good FROM nation),
g AS (SELECT qid, p_partkey AS id, CASE p_brand WHEN best THEN 3 WHEN good THEN 2 ELSE 1 END AS level, contains(p_size::VARCHAR, '1') OR contains(p_size::VARCHAR, '2') AS said FROM part JOIN r ON string_split(p_type, ' ')[1] = profession)
SELECT qid, id, CASE WHEN qid % 2 = 0 AND level >= CASE WHEN qid % 4 = 0 THEN 3 ELSE 2 END AND NOT said THEN 1 ELSE level END AS grade FROM g""",
    "third_persons": f"""SELECT doc_id, sha1(text || chr(10) || 'Спросите ' || CASE WHEN doc_id * 3 IN (SELECT c_custkey FROM customer) THEN '[NAME]'
ELSE {_CODE.format("(doc_id * 3)")} || 'у ' || ['Ивану', 'Олегу', 'Павлу'][doc_id * 3 % 3 + 1] END || ' из цеха, тел. И. у них нет.') AS text FROM documents""",
    "own_names": """SELECT doc_id, '[NAME]' || chr(10) || 'Писать [NAME], не Анне.' || chr(10) || '[DOCUMENT], табель ' || doc_id || chr(10) || 'Родился [BIRTH]' || chr(10) || 'Возраст: [BIRTH]' || chr(10) || 'тел. [PHONE]' || chr(10) || 'о [NAME] и с [NAME]' AS text FROM documents""",
    "evaluated_lines": """WITH d AS (SELECT doc_id, ['met', 'partial', 'no_data'][doc_id % 3 + 1] AS v1, CASE WHEN doc_id % 2 = 0 THEN 'met' ELSE 'no_data' END AS v2, CASE WHEN doc_id % 5 = 0 THEN 'met' ELSE 'no_data' END AS v3, 3 + (doc_id % 2 = 0)::INT AS l3 FROM documents),
p AS (SELECT *, round_even(100 * (2 * CASE v1 WHEN 'met' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.25 END + CASE v2 WHEN 'met' THEN 1.0 ELSE 0.25 END) / 3, 0)::INT AS points FROM d)
SELECT doc_id, 'ok' AS status, CASE WHEN v3 = 'met' THEN least(points, 30) ELSE points END AS score,
CASE WHEN v1 = 'met' AND v2 = 'met' THEN 'r1,r2' WHEN v1 = 'met' THEN 'r1' WHEN v2 = 'met' AND v1 = 'partial' THEN 'r2,r1' WHEN v2 = 'met' THEN 'r2' WHEN v1 = 'partial' THEN 'r1' ELSE '' END AS reasons,
'r1 ' || CASE v1 WHEN 'met' THEN 'met 2-2 Quality control, daily' WHEN 'partial' THEN 'partial 2-2 quality only' ELSE 'no_data' END || '; r2 ' || CASE v2 WHEN 'met' THEN 'met 3-3 planning of the budget' ELSE 'no_data' END
|| '; r3 ' || CASE v3 WHEN 'met' THEN 'met ' || l3 || '-' || l3 || ' работал только в продажах' ELSE 'no_data' END AS checks FROM p""",
}
