"""Queries of values as people write them: phones, names, dates, quotes and headlines, made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, dates, fields, names, text
from .persons import _pick
from .retrieval import table


def _digits(k, n):
    return F.lpad((k % 10**n).cast("string"), n, "0")


def written_phones(spark, sf_dir):
    """A number of each customer in one of seven spellings, alone and in a sentence."""
    k, d = F.col("c_custkey"), _digits(F.col("c_custkey"), 7)
    local = lambda form: F.concat(*(F.lit(x) if isinstance(x, str) else F.substring(d, *x) for x in form))
    raw = _pick_column(k, [local(("8 (912) ", (1, 3), "-", (4, 2), "-", (6, 2))), local(("+7 912 ", (1, 3), " ", (4, 2), " ", (6, 2))), local(("912", (1, 7))), local(("7912", (1, 7), ".0")), local(("8-800-", (1, 3), "-", (4, 2), "-", (6, 2))), local(("+44 20 ", (1, 4), " ", (4, 4))), d])
    said = F.concat(F.lit("Звоните "), raw, F.lit(" или 8 (343) 200-10-10, резюме 2019"))
    return table(spark, sf_dir, "customer").select("c_custkey", contacts.normalize_phone(raw).alias("phone"), F.array_join(contacts.extract_phones(said), ",").alias("said"))


def _pick_column(number, columns):
    return F.element_at(F.array(*columns), (number % len(columns) + 1).cast("int"))


def written_names(spark, sf_dir):
    k = F.col("c_custkey")
    raw = _pick(k, "иванов иван иванович", "Сергей СИДОРОВ", "Анна Петрова", "Иван Иванович Иванов", "анна-мария ким", "  ", "Щукин  Пётр", "Ivanov Ivan")
    body = F.concat(_pick(k, "", "Резюме\n", "резюме\n\n"), raw, F.lit("\nмастер"))
    latin = _pick(k, "Sergey Ilyich", "Yuriy Shchukin", "Natalya", "x", "Андрей")
    return table(spark, sf_dir, "customer").select("c_custkey", names.normalize_name(raw).alias("name"), names.looks_like_name(raw).alias("looks"), names.find_name(body).alias("found"), names.to_cyrillic(latin).alias("cyrillic"))


def written_dates(spark, sf_dir):
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    shown = F.when(key % 3 == 0, F.date_format(day, "dd.MM.yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "d/M/yyyy"))
    broken = F.when(key % 7 == 0, F.concat(F.lit("31.02."), F.year(day).cast("string"))).otherwise(shown)
    age = F.year(day) - 30
    born = F.concat(_pick(key, "Дата рождения: 01.02.", "родилась 3/4/", "", "д.р. "), age.cast("string"), F.when(key % 4 == 2, " г.р.").otherwise(""))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.parse_date(F.concat(F.lit("от "), broken)).cast("string").alias("day"), dates.parse_year(F.when(key % 2 == 0, F.concat(F.lit(" "), F.year(day), F.lit(".0 "))).otherwise(shown)).alias("year"),
        dates.birth_year(born, F.lit("1999-01-01").cast("date")).alias("born"), dates.updated_on(F.concat(F.lit("Резюме обновлено: "), F.date_format(day, "yyyy-MM-dd"))).cast("string").alias("updated"),
    )


def headlines(spark, sf_dir):
    """The line that says what a person is, and the paragraphs worth reading."""
    name = F.concat(F.lit("Иванов "), F.col("source"))
    top = F.concat_ws("\n", name, F.lit("mail@mail.example"), F.lit("Город: Тула\n"), F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("очень "), 20)), F.concat(F.lit("Мастер "), "source"), F.lit("тел 89121234567"))
    body = F.concat(top, F.lit("\n\nПервый абзац о работе в цехе\nи ещё строка\n \n"), _pick(F.col("doc_id"), "коротко", "Второй абзац о планах и учёте"), F.lit("\n\nТретий: и последний абзац"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), body.alias("text"))
    return rows.select("doc_id", fields.headline(F.col("text"), F.col("name")).alias("headline"), F.array_join(text.paragraphs(F.col("text"), F.col("name")), "|").alias("paragraphs"))


def quotes_found(spark, sf_dir):
    """Where a de-identified quote stands in the original, on which line, and what is said of moving and of companies in titles."""
    k = F.col("doc_id")
    before = F.concat(F.lit("запись "), k, F.lit("\n"))
    original = F.concat(before, F.lit("Работал с  Иваном Петровым\nв Цехе №"), k, F.lit("\nконец"))
    quoted = F.when(k % 3 == 2, F.lit("чего здесь нет")).otherwise(F.concat(F.lit("работал с [NAME] в цехе №"), k))
    said = _pick(k, "готова к переезду", "Переезд не рассматриваю, не готов к переезду", "о переезде молчу", "рассматриваю переезд")
    title = F.concat(F.lit("Мастер, ООО Завод"), k % 4)
    rows = table(spark, sf_dir, "documents").select("doc_id", original.alias("original"), text.quote_span(quoted, original).alias("span"), said.alias("said"), title.alias("title"))
    return rows.select(
        "doc_id", "span.start", "span.stop", text.line_of(F.col("original"), F.concat(F.lit("№"), k)).alias("line"), text.line_of(F.col("original"), F.lit("е"), 3).alias("after"),
        text.relocation(F.col("said"), F.lit("unknown")).alias("moving"), fields.without_company(F.col("title"), F.when(k % 2 == 0, F.concat(F.lit("ооо завод"), k % 4)).otherwise(F.lit("Завод"))).alias("title"),
    )


QUERIES = {f.__name__: f for f in (written_phones, written_names, written_dates, headlines, quotes_found)}

ORACLES = {
    "written_phones": """WITH p AS (SELECT c_custkey, c_custkey % 7 AS k, lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS d FROM customer),
n AS (SELECT c_custkey, k, d, CASE WHEN k < 4 THEN '+7912' || d WHEN k = 5 THEN '+4420' || d[1:4] || d[4:7] END AS phone FROM p)
SELECT c_custkey, phone, concat_ws(',', phone, '+73432001010') AS said FROM n""",
    "written_names": """SELECT c_custkey, ['Иванов Иван Иванович', 'Сидоров Сергей', 'Петрова Анна', 'Иванов Иван Иванович', 'Анна-Мария Ким', NULL, 'Щукин Пётр', 'Ivanov Ivan'][c_custkey % 8 + 1] AS name,
[false, true, true, true, false, false, true, false][c_custkey % 8 + 1] AS looks,
[NULL, 'Сидоров Сергей', 'Петрова Анна', 'Иванов Иван Иванович', NULL, NULL, 'Щукин Пётр', 'Ivanov Ivan'][c_custkey % 8 + 1] AS found,
['сергей ильич', 'юрий щукин', 'наталья', 'кс', 'андрей'][c_custkey % 5 + 1] AS cyrillic FROM customer""",
    "written_dates": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN d::VARCHAR END AS day, year(d)::INT AS year, CASE WHEN year(d) - 30 BETWEEN 1930 AND 1985 THEN (year(d) - 30)::INT END AS born, d::VARCHAR AS updated FROM o""",
    "headlines": """SELECT doc_id, 'Мастер ' || source AS headline, CASE WHEN doc_id % 2 = 0 THEN repeat('очень ', 20) || chr(10) || 'Мастер ' || source || '|' ELSE '' END || 'Первый абзац о работе в цехе' || chr(10) || 'и ещё строка' || CASE WHEN doc_id % 2 = 1 THEN '|Второй абзац о планах и учёте' ELSE '' END || '|Третий: и последний абзац' AS paragraphs FROM documents""",
    "quotes_found": """WITH d AS (SELECT doc_id, length('запись ' || doc_id) + 1 AS b, length(doc_id::VARCHAR) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN b END::INT AS start, CASE WHEN doc_id % 3 < 2 THEN b + length('Работал с  Иваном Петровым') + 1 + length('в Цехе №') + n END::INT AS stop, 3 AS line, 3 AS after,
['relocation_possible', 'no_relocation', 'unknown', 'relocation_possible'][doc_id % 4 + 1] AS moving, CASE WHEN doc_id % 2 = 0 THEN 'Мастер' ELSE 'Мастер, ООО Завод' || (doc_id % 4) END AS title FROM d""",
}
