"""Queries on what only larger tables hold: odd borders, long spans, hot keys."""

from itertools import combinations

import duckdb
import pytest

from rosterlake.operators import extract, people, resolve
from rosterlake.plans import desk, evaluation, profiles, resolution

from .helpers import compatible


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes a table's rows where queries read them."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def rows(df):
    return sorted(map(tuple, df.collect()))


def by_sql(sql, at, *names):
    held = duckdb.connect()
    for name in names:
        held.sql(f"CREATE VIEW {name} AS FROM '{at}/{name}.parquet/*.parquet'")
    return sorted(held.sql(sql).fetchall())


def test_numbers_side_by_side_are_masked_as_in_sql(spark, tables):
    texts = [
        "94.182.225.142 +1 (705) 555-1902 Oring", "8 999 123-45-67\n8 999 123-45-68\n+7 999 123-45-69", "_89991234567_ a89991234567 89991234567a", "89991234567\n", "",
        "89991234567,+79991234568,79991234569", "1234567890123456 12345", "a@b.ru, 8(999)1234567 +79991234568", None,
    ]
    at = tables("documents", list(enumerate(texts)), "doc_id long, text string")
    assert rows(evaluation.mask_contacts(spark, at).select("doc_id", "masked").where("masked IS NOT NULL")) == by_sql(f"SELECT doc_id, masked FROM ({evaluation.ORACLES['mask_contacts']}) WHERE masked IS NOT NULL", at, "documents")


def test_throughput_looks_back_an_hour(spark, tables):
    ticks = [(k, "click" if k % 3 else "view", f"2024-01-01 {k // 6:02d}:{k % 6}0:0{k % 7}") for k in range(40)] + [(40, "lone", "2024-01-01 00:00:00"), (41, "lone", "2024-01-01 01:00:00")]
    at = tables("events", ticks, "event_id long, event_type string, ts string")
    held = spark.read.parquet(f"{at}/events.parquet").selectExpr("event_id", "event_type", "timestamp(ts) AS ts")
    held.write.parquet(f"{at}/typed/events.parquet")
    found = rows(evaluation.stage_throughput(spark, f"{at}/typed"))
    assert found[-1] == (41, round(60 / 3600, 6))
    assert found == by_sql(evaluation.ORACLES["stage_throughput"], f"{at}/typed", "events")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_meet_in_bands(spark, tables):
    people = [(k, k % 2, "s", b) for k, b in enumerate([0.0, 4.99, 5.0, 9.98, -0.01, -4.99, 1e300, 1e300, 1e300, float("inf"), float("inf"), float("nan"), 5e8, 5e8 + 4, None, 9.99])]
    at = tables("customer", people, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    found = resolution.possible_pairs(spark, at)
    near = lambda x, y: x is not None and y is not None and abs(x - y) < 5
    assert rows(found) == [(a[0], b[0]) for a, b in combinations(people, 2) if a[1] == b[1] and near(a[3], b[3])]
    assert "_band" in plan(found)


def test_pairs_of_a_group_are_dealt_over_many_keys(spark, tables):
    names = ["Иванов Иван", "Иванов И.", "Ivanov Ivan", "Ivanof Ivan", "Петров Пётр", "Петрова Анна", "Ли Ан", "Ли", "Ab", "Abc", "Petrov", "Petro", "", ".", None, "Иван Иванов"]
    people = [(k, None if k == 7 else k % 2, names[(k // 2) % len(names)], "AB"[k % 3 == 0], 100.0 * (k % 9)) for k in range(70)] + [(None, 0, "Ли", "A", 1.0), (3, 1, "Ли", "A", 1.0)]
    at = tables("customer", people, "c_custkey long, c_nationkey int, c_name string, c_mktsegment string, c_acctbal double")
    fits = compatible(spark, *(n for n in names if n))
    truth = [(a[0], b[0], fits(a[2] or None, b[2] or None)) for a in people for b in people if a[1] is not None and a[1] == b[1] and None not in (a[0], b[0]) and a[0] < b[0]]
    found = resolution.names_compatible(spark, at)
    assert rows(found) == sorted(truth)
    fields = profiles.compared_fields(spark, at)
    assert rows(fields) == by_sql(f"SELECT a, b, agree FROM ({profiles.ORACLES['compared_fields']})", at, "customer")
    assert all("_couple" in plan(df) for df in (found, fields))


def test_pairs_of_parts_and_blocks(spark):
    held = [(k * k % 41 if k % 6 else 7, k % 2, "ab"[k % 3 == 0], k % 5, [k]) for k in range(90)]
    df = spark.createDataFrame(held, "id long, g int, s string, n int, own array<int>")
    truth = sorted((a[0], b[0], a[2], a[4], b[3]) for a in held for b in held if a[1] == b[1] and a[0] < b[0])
    for kw in ({}, {"cells": 3, "most": 4, "block": 2}, {"cells": 1, "block": 1}, {"order": ("s", "n"), "mine": ("own",), "cells": 2, "most": 5, "block": 3}):
        assert rows(resolve.all_pairs(df, "g", **kw).select("a", "b", "x.s", "x.own", "y.n")) == truth


@pytest.mark.parametrize("query", [profiles.compared_fields, resolution.names_compatible])
def test_files_of_pairs_hold_runs(spark, tables, tmp_path, query):
    people = [(k * 7919 % 100_003, 1, f"Customer#{k:09d}", "ABCDE"[k * k % 5], k * 37 % 10_000 - 999.5) for k in range(3000)]
    at = tables("customer", people, "c_custkey long, c_nationkey int, c_name string, c_mktsegment string, c_acctbal double")
    query(spark, at).coalesce(4).write.parquet(f"{tmp_path}/fields")
    assert spark.read.parquet(f"{tmp_path}/fields").count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("fields/*.parquet")) < 0.6 * 3000 * 2999 // 2


def test_forms_of_names_are_not_collected(spark):
    docs = spark.createDataFrame([(1, "Спросите Петрову Анну")], "doc_id long, text string")
    found = people.mask_people(docs, spark.createDataFrame([("Петрова Анна",)], "full_name string"))
    forms = people.mentions(docs, people.dictionary(spark.createDataFrame([("Петрова Анна",)], "full_name string")))
    assert "Broadcast" not in plan(forms) and found.first().text == "Спросите [NAME]"


def test_corrections_of_many_notes(spark, tables):
    kinds = ["click", "view", "search", "view"]
    events = [(100 * k if k < 300 else 30000 + k, k % 7, kinds[k % 4]) for k in range(900)]
    tables("customer", [(k, k % 3) for k in range(9)] + [(3, 1)], "c_custkey long, c_nationkey int")
    at = tables("events", [*events, *events[:5]], "event_id long, user_id long, event_type string")
    found = desk.corrections(spark, at)
    assert rows(found.distinct()) == by_sql(f"SELECT vacancy_id, candidate_id, n, said FROM ({desk.ORACLES['corrections']})", at, "customer", "events")
    assert "array_distinct" not in plan(found)


def test_profiles_cost_what_is_read_of_them(spark, tables):
    tables("part", [(k, f"Brand#{k % 3}", "LARGE" if k % 2 else "SMALL") for k in range(9)], "p_partkey long, p_brand string, p_type string")
    lines = [(k % 40, k * 7 % 11, 1 + k // 40 % 3, f"{1995 + k % 3}-{1 + k * 5 % 12:02d}-28") for k in range(300)]
    raw = tables("raw", lines, "l_orderkey long, l_partkey long, l_linenumber int, day string")
    spark.read.parquet(f"{raw}/raw.parquet").selectExpr("l_orderkey", "l_partkey", "l_linenumber", "to_timestamp_ntz(day) AS l_shipdate").write.parquet(f"{raw}/lineitem.parquet")
    found = profiles.extracted_profiles(spark, raw)
    assert rows(found) == by_sql(profiles.ORACLES["extracted_profiles"], raw, "lineitem", "part")
    said = plan(found)
    assert "MapInArrow" in said and "lines_ok" not in said  # neither pandas objects nor checks that the query doesn't return
    assert said.index("partial_collect_list") < said.index("Exchange")  # equal orders are brought together before they are listed


def test_profiles_of_any_extractor(spark):
    jobs = [{"title": "сварщик, ООО «Альфа»", "company": "ООО «Альфа»", "start": "2019-03", "end": "по настоящее время", "source_lines": range(1, 3), "else": 1}, {"start": "2018", "end": "2018", "source_lines": (2, 9)}]

    def extractor(body):
        return {"bad": lambda: 1 / 0, "none": lambda: None, "bare": lambda: {"positions": None, "skills": ("a",), "total_years": 3}}.get(body, lambda: {"positions": jobs, "total_years": float("nan")})()

    docs = spark.createDataFrame([(None, "bad"), (1, "none"), (2, "bare"), (3, "сварка металла\nтел"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in extract.checked(extract.extract(docs, extractor), 24240).collect()}
    assert {k: r.status for k, r in found.items()} == {None: "failed", 1: "parsed", 2: "parsed", 3: "parsed", 4: "parsed"} and found[None].positions is None and found[1].positions is None
    assert found[2].positions == [] and found[2].profile.skills == ["a"] and found[2].profile.total_years == 3 and found[3].profile.total_years is None
    assert [tuple(p) for p in found[3].positions] == [("сварщик", "ООО «Альфа»", "альфа", "2019-03", None, True, True), (None, None, None, "2018", "2018", False, False)]
    assert found[3].company_keys == ["альфа", None] and found[3].years_counted == 1.9 and [p.lines_ok for p in found[4].positions] == [False, False]
