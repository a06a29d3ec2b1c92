import zipfile

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import evaluate, metrics, resolve, search
from rosterlake.sources import documents, tabular


def checks(*verdicts):
    return [(f"r{k}", kind, w, v) for k, (kind, w, v) in enumerate(verdicts)]


M, N, A = ("must", 2), ("nice", 1), ("avoid", 2)


@pytest.mark.parametrize(
    "given, score, category",
    [
        (checks((*M, "met"), (*N, "met")), 100, "fit"),
        (checks((*M, "met"), (*M, "not_met"), (*N, "met")), 30, "unfit"),
        (checks((*M, "met"), (*A, "met")), 30, "unfit"),
        (checks((*N, "met"), (*N, "no_data")), 62, "maybe"),
        (checks((*N, "met"), (*N, "met"), (*N, "met"), (*N, "no_data")), 81, "fit"),
        (checks((*M, "met"), (*N, "met"), (*N, "no_data")), 81, "maybe"),
        (checks((*M, "partial"), (*M, "no_data"), (*N, "met")), 50, "unfit"),
        (checks((*M, "no_data"), (*M, "no_data"), (*M, "partial")), 33, "unfit"),
        ([], 0, "unfit"),
    ],
)
def test_score_and_category(spark, given, score, category):
    df = spark.createDataFrame([(given,)], f"checks {evaluate.CHECKS}").withColumn("score", evaluate.score(F.col("checks")))
    row = df.select("score", evaluate.category(F.col("checks"), F.col("score"), F.lit(True)).alias("c"), evaluate.category(F.col("checks"), F.col("score"), F.lit(False)).alias("f")).first()
    assert (row.score, row.c, row.f) == (score, category, "failed")


def test_reasons_and_ties(spark):
    given = checks((*N, "met"), (*M, "partial"), (*M, "met"), (*A, "met"), (*N, "partial"))
    df = spark.createDataFrame([(given,)], f"checks {evaluate.CHECKS}")
    assert df.select(evaluate.top_reasons(F.col("checks"))).first()[0] == ["r2", "r0", "r1"]
    rows = spark.createDataFrame([(s,) for s in (80, 77, 60, 58, 40)], "s int")
    assert [r.tied for r in evaluate.tied(rows, [], [F.desc("s")], "s").orderBy(F.desc("s")).collect()] == [True, True, True, True, False]


def test_fusion_keeps_the_vector_list_first(spark):
    lists = [spark.createDataFrame([(d, 0.9, k + 1) for k, d in enumerate(x)], "doc_id long, score double, place int") for x in ([1, 2, 3], [4, 2, 5])]
    fused = [r.doc_id for r in search.fuse(*lists).orderBy(*search.fused_order()).collect()]
    assert fused == [2, 1, 4, 3, 5]


def test_guard_and_parts(spark):
    keys = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "hot", "a"), (5, "hot", "b"), (6, "hot", "c"), (7, "own", "a")], "id long, key string, person string")
    pairs = resolve.key_pairs(resolve.guarded_keys(keys))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)]
    seen = spark.createDataFrame([(3, 1)], "a long, b long")
    assert list(map(tuple, resolve.unseen(pairs, seen).collect())) == [(1, 2)]
    members = spark.createDataFrame([(1, 1, "Иванов Иван", 3), (1, 2, "Иванов И.", 2), (1, 3, "Петров Петр", 1)], "component long, id long, name string, fresh long")
    assert sorted(map(tuple, resolve.split_parts(members).collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60) if k != 30], "a long, b long")
    found = {r.id: r.component for r in resolve.components(edges).collect()}
    assert set(found.values()) == {1, 31} and found[30] == 1 and found[60] == 31


def test_merge_and_unmerge(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], None, "x")], "own array<string>, old array<string>, was string, gave string")
    row = df.select(
        resolve.restored_list(F.array_union("own", "old"), F.col("old"), F.col("own")).alias("list"),
        resolve.restored(F.coalesce("was", "gave"), F.col("gave"), F.col("was")).alias("value"),
        resolve.restored(F.lit("edited"), F.col("gave"), F.col("was")).alias("edited"),
    ).first()
    assert tuple(row) == (["a", "b"], None, "edited")


def test_metrics(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, doc_id long, place int")
    qrels = spark.createDataFrame([("q", 2, 3), ("q", 9, 2)], "qid string, doc_id long, grade int")
    row = metrics.ir_metrics(run, qrels).first()
    assert row.recall == 0.5 and 0 < row.ndcg < 1
    pairs = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "found array<string>, truth array<string>")
    assert tuple(metrics.set_f1(pairs).first()) == (1, 1, 1, 0.5)


def test_tables_and_roles(spark, tmp_path):
    (tmp_path / "base.csv").write_text("﻿Код;ФИО;Мобильный;Почта;Город;Дата рождения;Дата обновления\n1;петров пётр;8 912 345-67-89;p@b.ru;г. пермь;01.02.1980;2023-05-06\n;;;;;;\n", "utf-8")
    df = tabular.read_table(spark, str(tmp_path / "base.csv"))
    roles = tabular.guess_roles(df, F.expr("DATE '2024-01-01'"))
    assert list(roles.values()) == ["external_id", "full_name", "phone", "email", "city", "birth", "resume_date"]
    row = tabular.to_records(df, roles).first()
    assert (row.external_id, row.full_name, row.phones, row.emails, row.birth_year) == ("1", "Петров Пётр", ["+79123456789"], ["p@b.ru"], 1980)


def test_roles_by_content(spark):
    rows = [(f"Иванов Иван{'аеиоу'[k % 5]}", f"8912345{k:04d}", f"u{k}@b.ru", f"0{1 + k % 9}.02.1980", "слово " * 50) for k in range(20)]
    df = spark.createDataFrame(rows, "c1 string, c2 string, c3 string, c4 string, c5 string")
    assert list(tabular.guess_roles(df, F.expr("DATE '2024-01-01'")).values()) == ["full_name", "phone", "email", "birth", "resume_text"]


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Привет".encode("cp1251"))
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("x/b.txt", "one")
        z.writestr("y/b.txt", "two")
        z.writestr(".hidden.txt", "no")
    (tmp_path / "in" / "bad.docx").write_bytes(b"not a zip")
    found = {r.name: (r.text, r.error) for r in documents.read_documents(documents.list_folder(spark, str(tmp_path / "in"))).collect()}
    assert found == {"a.txt": ("Привет", None), "b.txt": ("one", None), "b_1.txt": ("two", None), "bad.docx": (None, "unreadable")}


def test_sinks(spark):
    old, new = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b")], [(2, "=c"), (3, "d")]))
    merged = documents.upsert(old, new, ["id"])
    assert sorted(map(tuple, documents.formula_safe(merged).collect())) == [(1, "a"), (2, "'=c"), (3, "d")]


def test_broken_batches_are_refused(spark, tmp_path):
    import io
    import zipfile

    from rosterlake.sources import documents, xlsx

    def archive(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    good = archive(**{"a.txt": "text of a person"})
    wrong = good.replace(b"text of", b"texx of", 1)
    files = {"good.zip": good, "sum.zip": wrong, "cut.zip": good[:40], "rows.xlsx": xlsx.book_bytes({"a": 5}, [[1]]), "bare.xlsx": xlsx.book_bytes({"a": 5}, []), "text.xlsx": b"a;b", "a.txt": b"x"}
    df = spark.createDataFrame([(f"/in/{k}", bytearray(v)) for k, v in files.items()], "path string, content binary")
    faults = {r.path.rpartition("/")[2]: r.error for r in documents.broken(df).collect()}
    assert faults.keys() == {"sum.zip", "cut.zip", "bare.xlsx", "text.xlsx"} and "checksum" in faults["sum.zip"] and faults["bare.xlsx"] == "no rows"
    with pytest.raises(ValueError, match="bare.xlsx"):
        documents.accepted(df)
    fine = df.where("path IN ('/in/good.zip', '/in/rows.xlsx', '/in/a.txt')")
    assert documents.accepted(fine).count() == 3


def test_wipe_keeps_settings(spark, tmp_path):
    from rosterlake.operators import stored

    base = f"file://{tmp_path}/base"
    for name in ("records", "matches", "settings"):
        spark.range(3).write.parquet(f"{base}/{name}")
    assert stored.wipe(spark, base, ["records", "matches", "settings", "jobs"]) == ["records", "matches"]
    assert spark.read.parquet(f"{base}/settings").count() == 3 and not (tmp_path / "base" / "records").exists()


def test_headers_speak_before_content(spark):
    from rosterlake.sources import tabular

    assert [tabular.confidence(h, r) for h, r in (("Телефон", "phone"), ("Телефон", "email"), ("x", "phone"), ("x", ""))] == ["agreed", "check", "check", "not understood"]
    df = spark.createDataFrame([("Иванов Иван", "г. МОСКВА"), ("", "тула")], "`ФИО` string, `Город` string").repartition(2)
    roles = {"ФИО": "full_name", "Город": "city"}
    assert [(r.full_name, r.city) for r in tabular.to_records(df, roles).collect()] == [("Иванов Иван", "Москва")]
    nameless = tabular.to_records(df.withColumn("Телефон", F.lit("8 912 345 67 89")), roles | {"Телефон": "phone"})
    assert nameless.count() == 2 and tabular.to_records(df.withColumn("Телефон", F.lit("8 912 345 67 89")), roles | {"Телефон": "phone"}, skip_nameless=True).count() == 1
    wide = spark.range(500).select(F.col("id").cast("string").alias("a"))
    assert tabular.sample(wide.repartition(7)).collect() == tabular.sample(wide.repartition(3)).collect()


def test_fair_description_and_corrections_of_everybody(spark):
    from rosterlake.operators import vacancy

    asked = F.array(F.struct(F.lit("r1").alias("id"), F.lit("Знание учёта").alias("name"), F.lit("must").alias("kind"), F.lit("discriminatory").alias("flag")))
    df = spark.createDataFrame([("Нужен мастер; знание УЧЁТА важно. Женщина до 30 лет!\n\nГрафик 2/2. ",), (None,)], "d string")
    rows = df.select(vacancy.fair_description(F.col("d"), asked).alias("x")).collect()
    assert [list(r.x.kept) for r in rows] == [["Нужен мастер;", "График 2/2."], []] and [list(r.x.cut) for r in rows] == [["знание УЧЁТА важно.", "Женщина до 30 лет!"], []]
    notes = [(1, 7, 3, "vacancy", "misread", "a"), (2, 7, 4, "vacancy", "irrelevant", "b"), (3, 8, 3, "all", "other", "c"), (4, 9, 9, "all", "irrelevant", "d"), (5, 8, 3, "vacancy", "misread", "e"), (6, 7, 3, None, None, None)]
    feedback = spark.createDataFrame(notes, "id long, vacancy_id long, candidate_id long, scope string, kind string, comment string")
    pairs = spark.createDataFrame([(7, 3), (7, 5), (8, 3), (1, 1)], "vacancy_id long, candidate_id long")
    found = {(r.vacancy_id, r.candidate_id): "".join(x[1] for x in r.corrections) for r in vacancy.corrections(feedback, pairs).collect()}
    assert found == {(7, 3): "abcd»", (7, 5): "bd", (8, 3): "cde", (1, 1): "d"}
