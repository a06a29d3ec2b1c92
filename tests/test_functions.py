import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import contacts, dates, fields, names, text
from rosterlake.operators import search

from .helpers import compatible


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_phones(spark):
    given_ = ["8 (912) 345-67-89", "+7 495 123 45 67", "9123456789", "79123456789.0", "375291234567", "8-800-555-35-35", "12345", "+442079460958", None, "abc"]
    want = ["+79123456789", "+74951234567", "+79123456789", "+79123456789", "+375291234567", None, None, "+442079460958", None, None]
    assert column(spark, given_, contacts.normalize_phone) == want
    found = column(spark, ["тел. 8 (912) 345-67-89, ещё 8.912.345.67.89 и +375 (29) 123-45-67"], contacts.extract_phones)
    assert found == [["+79123456789", "+375291234567"]]


def test_emails(spark):
    assert column(spark, ["a@B.ru, x.y+z@mail.example.com a@b.RU", "none"], contacts.extract_emails) == [["a@b.ru", "x.y+z@mail.example.com"], []]
    assert column(spark, ["j.doe+x@googlemail.com", "j.doe@gmail.com", "j.doe@mail.ru"], contacts.email_key) == ["jdoe@gmail.com", "jdoe@gmail.com", "j.doe@mail.ru"]


def test_names(spark):
    given_ = ["иванов иван иванович", "Сергей СИДОРОВ", "Анна Петрова", "Иван Иванович Иванов", "анна-мария ким", "Александр Михайлов", "  "]
    want = ["Иванов Иван Иванович", "Сидоров Сергей", "Петрова Анна", "Иванов Иван Иванович", "Анна-Мария Ким", "Александр Михайлов", None]
    assert column(spark, given_, names.normalize_name) == want
    assert column(spark, ["Иванов Иван", "Иванов", "ООО Ромашка плюс 5", None], names.looks_like_name) == [True, False, False, False]


def both_ways(spark, pairs):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return [r.x for r in rows.select("k", names.names_compatible(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("a, b", [("Иванов Иван", "Иван Иванов"), ("Иванов И.П.", "Иванов Иван Петрович"), ("Семёнов Петр", "Семенов Пётр"), ("Sidorov Sergey", "Сидоров Сергей"), ("Кузнецова Катя", "Кузнецова Екатерина"), ("Кузнецов Олег", "Кузнецовв Олег"), (None, "Кто Угодно")])
def test_compatible(spark, a, b):
    assert both_ways(spark, [(a, b), (b, a)]) == [True, True]


@pytest.mark.parametrize("a, b", [("Иванов Иван", "Иванов Петр"), ("Ким Анна", "Цой Анна"), ("Иванов Иван Петрович", "Иванов Иван Сергеевич"), ("И. И.", "Иванов Иван")])
def test_incompatible(spark, a, b):
    assert both_ways(spark, [(a, b), (b, a)]) == [False, False]


def test_compatibility_is_mutual(spark):
    draw = random.Random(4)
    people = ["".join(draw.choice("абв гд.АБ") for _ in range(draw.randint(0, 14))) for _ in range(60)]
    people += ["Иванов Иван", "Ivanov Ivan", "Иванова Анна", "Иванов Ваня", "И. Иванов", "Sidorov S.", "Сидоров Семён Ильич", "Щукин Юрий", "Shchukin Yuriy", "Петров-Водкин К."]
    fits = compatible(spark, *people)
    assert [fits(a, b) for a in people for b in people] == [fits(b, a) for a in people for b in people]
    assert sum(fits(a, b) for a in people for b in people) > len(people)


def test_dates(spark):
    day = datetime.date
    assert column(spark, ["от 05.03.2021", "2020-12-31!", "31.02.2020", "5/6/1999", None], dates.parse_date) == [day(2021, 3, 5), day(2020, 12, 31), None, day(1999, 6, 5), None]
    assert column(spark, ["1980", " 1980.0 ", "x 1980", "01.02.1990"], dates.parse_year) == [1980, 1980, None, 1990]
    as_of = F.expr("DATE '2024-01-01'")
    assert column(spark, ["Дата рождения: 01.02.1985", "1985 г.р.", "родился 2020", ""], lambda c: dates.birth_year(c, as_of)) == [1985, 1985, None, None]
    assert column(spark, ["Резюме обновлено: 2023-05-06"], dates.updated_on) == [day(2023, 5, 6)]
    assert column(spark, [day(2022, 7, 2), day(2022, 7, 1), None], lambda c: dates.is_stale(c, as_of), "date") == [False, True, True]
    assert column(spark, ["2020-03", "2020", "now"], dates.month_index) == [24242, 24240, None]
    assert column(spark, ["2020"], lambda c: dates.month_index(c, True)) == [24251]


def test_union_of_months(spark):
    spans = [[(0, 12), (6, 24), (24, 30), (40, 42)], [], [(5, 5), (7, 3)]]
    assert column(spark, spans, dates.union_months, "array<struct<start:long,stop:long>>") == [32, 0, 0]


def test_evidence(spark):
    body = "[NAME]\nworked at a plant\n[PHONE] [EMAIL]\nfive years"
    df = spark.createDataFrame([(k, v, body) for k, v in enumerate([[2, 2], [2], [3, 3], [1, 4], [4, 5], [4, 2], [2, 3, 4], []])], "k int, v array<int>, t string")
    found = [r.x for r in df.select("k", text.valid_lines(F.col("v"), F.col("t")).alias("x")).orderBy("k").collect()]
    assert found == [[2, 2], [2, 2], None, [1, 4], None, None, [2, 4], None]
    assert df.limit(1).select(text.quote(F.lit("a\n- b c\nd"), F.array(F.lit(2), F.lit(3)))).first()[0] == "b c d"
    assert df.limit(1).select(text.numbered(F.lit("a\nb"))).first()[0] == "1| a\n2| b"


def words_of(draw, letters, n, most):
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_cutting_keeps_length(spark):
    values = words_of(random.Random(1), "Аб в.,;—-•\n1)", 200, 900)
    found = column(spark, values, text.split_long_lines)
    assert all(len(x) == len(v) and x.replace("\n", " ") == v.replace("\n", " ") for x, v in zip(found, values))


def test_cutting(spark):
    pad = "слово " * 40
    given_ = [
        "короткая. Строка; с точкой", f"{pad}делал шкафы. Потом двери; и окна • раз • два", f"{pad}завод — мастер", f"{pad}май — июнь 2020", f"{pad}января — и далее",
        f"{pad}мастер - сварщик", "а, " * 80, None,
    ]
    want = [
        given_[0], f"{pad}делал шкафы.\nПотом двери;\nи окна\n• раз\n• два", f"{pad}завод\n— мастер", given_[3], f"{pad}января — и далее",
        f"{pad}мастер\n- сварщик", ("а,\n" * 79 + "а, "), "",
    ]
    assert column(spark, given_, text.split_long_lines) == want


def test_masks_keep_lines(spark):
    values = words_of(random.Random(2), "Иванов 8912345678@.ruab\n", 200, 120)
    mask = lambda c: text.anonymize(c, F.lit("Иванов Иван"), F.array(F.lit("8912345678")))
    once = column(spark, values, mask)
    assert [x.count("\n") for x in once] == [v.count("\n") for v in values]
    assert column(spark, once, mask) == once


def test_anonymize(spark):
    given_ = [
        "Иванову Ивану\nзвонить 8 (912) 345-67-89 или a@b.ru, www.site.ru/x", "резюме Ivanova Ivan, И.И. Иванов", "паспорт 45 12 345678, ИНН: 7712345678", "Дата рождения: 01.02.1985 г.",
        "1985 г.р., возраст: 35 лет", "t.me/user и @handle, skype: some.one", "опыт 10 лет, стаж 12 лет", "дом 12, кв. 5",
    ]
    want = [
        "[NAME]\nзвонить [PHONE] или [EMAIL], [LINK]", "резюме [NAME]", "[DOCUMENT], [DOCUMENT]", "Дата рождения: [BIRTH]",
        "[BIRTH], возраст: [BIRTH]", "[LINK] и [LINK], [LINK]", "опыт 10 лет, стаж 12 лет", "дом 12, кв. 5",
    ]
    assert column(spark, given_, lambda c: text.anonymize(c, F.lit("Иванов Иван"))) == want
    assert column(spark, ["Kontakt: ivan@x.y1 und mehr"], lambda c: text.anonymize(c, F.lit(None).cast("string"), F.array(F.lit("IVAN@x.y1")))) == ["Kontakt: [EMAIL] und mehr"]


def test_relocation(spark):
    given_ = ["переезд не рассматриваю", "готова к переезду", "не готов к переезду, рассматриваю переезд", "готовил к переезду станки", None]
    assert column(spark, given_, lambda c: text.relocation(c, F.lit("unknown"))) == ["no_relocation", "relocation_possible", "no_relocation", "unknown", "unknown"]


def test_quotes(spark):
    original = F.lit("Работал на\nзаводе  Иван Петров мастером")
    found = column(spark, ["на заводе [NAME] мастером", "НА ЗАВОДЕ", "нет такого", "[NAME]", None], lambda c: text.quote_span(c, original))
    assert [x and (x.start, x.stop) for x in found] == [(8, 39), (8, 17), None, None, None]
    assert column(spark, ["a\nb x\nx"], lambda c: F.concat_ws(",", text.line_of(c, F.lit("x")).cast("string"), text.line_of(c, F.lit("x"), 3).cast("string"), text.line_of(c, F.lit("q")).cast("string"))) == ["2,3"]


def test_paragraphs(spark):
    body = "Город: Пермь\nВозраст: нет\n\nИванов Иван\n+7 912 345 67 89\nРаботал сварщиком на заводе десять лет\n\nкоротко"
    assert column(spark, [body, None], lambda c: text.paragraphs(c, F.lit("Иванов Иван"))) == [["Работал сварщиком на заводе десять лет"], None]


def test_shows(spark):
    body = "опыт в продажах\nне только продажи и кроме продаж\nсварка"
    ask = lambda a, b, name: column(spark, [body], lambda c: text.shows(c, F.array(F.lit(a), F.lit(b)), F.lit(name)))[0]
    assert ask(1, 1, "только с опытом в продажах") and not ask(2, 2, "только в продажах") and not ask(3, 3, "только в продажах") and ask(3, 3, "курение")


def test_fields(spark):
    values = F.array(F.struct(F.lit("a").alias("field"), F.lit("завод").alias("value")), F.struct(F.lit("b").alias("field"), F.lit("водитель").alias("value")), F.struct(F.lit("c").alias("field"), F.lit("").alias("value")))
    assert [tuple(x) for x in column(spark, ["Мой ЗАВОД, водитель"], lambda c: fields.field_spans(c, values))[0]] == [("a", 4, 9), ("b", 11, 19)]
    assert column(spark, ["Иванов Иван\nТел: 1\nСварщик 5 разряда"], lambda c: fields.headline(c, F.lit("Иванов Иван"))) == ["Сварщик 5 разряда"]
    assert column(spark, ["{'a': None}".replace("'", '"'), '{"a": "None", "b": True}', '{"a": "x None \\" None", "b": False}'], lambda c: F.to_json(fields.loose_json(c, "a string, b boolean"))) == ["{}", '{"a":"None","b":true}', '{"a":"x None \\" None","b":false}']
    assert column(spark, ["слесарь завода Альфа, Альфа", "Альфабет"], lambda c: fields.without_company(c, F.lit("Альфа"))) == ["слесарь завода", "Альфабет"]
    assert column(spark, ["one@a.ru\nопыт\none@a.ru two@a.ru"], lambda c: F.to_json(F.array(*fields.head_and_body_contacts(c)))) == ['[["one@a.ru"],["two@a.ru"]]']
    assert column(spark, ["Резюме 2020\nИванов Иван\nx", "x\nJohn Smith", "нет"], names.find_name) == ["Иванов Иван", "John Smith", None]


def test_stems(spark):
    given_ = ["сварщиками", "работающий", "красивейшая", "вежливость", "продажи", "steel", "бегавший"]
    assert column(spark, given_, search.stem) == ["сварщик", "работа", "красив", "вежлив", "продаж", "steel", "бега"]


def test_grounded(spark):
    df = spark.range(1).select(text.grounded(F.lit("Опыт 5 лет. Вёл 12 человек. Знает дело."), F.lit("5 лет, 10 человек")).alias("x"))
    assert df.first()[0] == "Опыт 5 лет. Знает дело."


def test_snippet(spark):
    found = column(spark, ["начало " * 20 + "сварщик пятого разряда"], lambda c: text.snippet(c, F.lit("ищем сварщика")))[0]
    assert "<mark>сварщик</mark>" in found and found.startswith("…")
    assert column(spark, ["ничего\nтут"], lambda c: text.snippet(c, F.lit("ищем"), F.lit("кратко"))) == ["кратко"]


def test_years_of_experience(spark):
    keep = lambda said, years: spark.range(1).select(text.grounded(F.lit(said), F.lit("завод"), F.lit(years)).alias("x")).first()[0]
    assert keep("Стаж 9 лет. Опыт 12 лет. Вёл 9 лет.", 9.6) == "Стаж 9 лет."


@pytest.mark.parametrize(
    "line, cuts",
    [
        ("В г. Самара руководил {pad}; рекомендации даст Иванов И. И., а с 2019 — по настоящее время работаю {pad}.", ["рекомендации", "а с 2019"]),
        ("Работал с 01. 02. 2015 по 31. 12. 2019 мастером участка. Отвечал за {pad} {pad}", ["Отвечал"]),
        ("Обязанности: 1. Руководил участком. 2. Внедрил учёт. 3. Готовил {pad} {pad}", ["2.", "3."]),
        ("январь — декабрь 2019: начальник {pad} {pad} — внедрил учёт {pad}", ["— внедрил"]),
        ("навыки {pad} • учёт {pad} - план {pad}", ["• учёт", "- план"]),
        ("сказал «всё». \"Да\" {pad} {pad} конец? (Нет) {pad}", ["\"Да\"", "(Нет)"]),
        ("декабрь — Январь {pad} {pad} 12 - 15 {pad} {pad}", []),
    ],
)
def test_long_lines_are_cut_between_items(spark, line, cuts):
    line = line.replace("{pad}", "слово " * 18 + "слово")
    found = column(spark, [line], text.split_long_lines)[0]
    assert len(found) == len(line) and found.replace("\n", " ") == line
    begins = [p for p in found.split("\n")[1:]]
    assert len(begins) == len(cuts) and all(p.startswith(c) for p, c in zip(begins, cuts, strict=True)), begins


def test_line_spans_of_many_lines(spark):
    rng = random.Random(3)
    texts = ["", "\n", "a", "a\n", *("\n".join("x" * rng.randint(0, 9) for _ in range(n)) for n in (63, 64, 65, 128, 700))]
    for found, body in zip(column(spark, texts, fields.line_spans), texts, strict=True):
        want, at = [], 0
        for line in body.split("\n"):
            want.append((at, at + len(line)))
            at += len(line) + 1
        assert [tuple(x) for x in found] == want
