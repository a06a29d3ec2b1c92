"""Queries judge whole tables: nothing is cut by id, by a cap or by a remainder."""

import random
from itertools import combinations

import pytest

from rosterlake.operators import resolve
from rosterlake.plans import evaluation, profiles, resolution

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


def test_names_compatible_is_brute_force(spark, tables):
    names = ["Иванов Иван", "Иванов И.", "Ivanov Ivan", "Петров Пётр", "Петрова Анна", None]
    people = [(190 + k, k % 2, names[k % 5 if k < 20 else 5]) for k in range(24)]
    at = tables("customer", people, "c_custkey long, c_nationkey int, c_name string")
    fits = compatible(spark, *(n for n in names if n))
    truth = sorted((a[0], b[0], fits(a[2], b[2])) for a, b in combinations(people, 2) if a[1] == b[1])
    assert rows(resolution.names_compatible(spark, at)) == truth


def test_feedback_and_runs_of_all_ids(spark, tables):
    tables("customer", [(k,) for k in (1, 150, 151, 9000)], "c_custkey long")
    tables("events", [(9000, "2024-01-05", "search", 0.5), (151, "2024-01-09", "click", 2.0)], "user_id long, ts string, event_type string, value double")
    at = tables("orders", [(k, "OF"[k % 2]) for k in (3, 1999, 2002, 6000)], "o_orderkey long, o_orderstatus string")
    every = "2024-01-05"
    assert rows(profiles.latest_feedback(spark, at)) == [(1, every), (150, every), (151, "2024-01-09"), (9000, every)]
    assert rows(profiles.repaired_runs(spark, at)) == [(3, "done"), (1999, "done"), (2002, "failed"), (6000, "running")]


def test_queue_results_and_history_have_no_cap(spark, tables):
    docs = [(k, f"text {k % 60}", "en", f"s{k % 4}", 10 * k) for k in range(240)]
    tables("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    tables("labels", [(k, 1, 0) for k in range(0, 240, 3)], "doc_id long, quality int, toxic int")
    tables("nation", [(0, "x")], "n_nationkey int, n_name string")
    tables("customer", [(1, 0)], "c_custkey long, c_nationkey int")
    at = tables("orders", [(k, 1 + k % 2, f"2024-01-{1 + k % 28:02d}") for k in range(130)], "o_orderkey long, o_custkey long, o_orderdate string")
    pairs = sorted((b % 3 == 0, a, b) for a in range(60) for b in range(a + 60, 240, 60))
    assert [(r.postponed, r.a, r.b) for r in resolution.pair_queue(spark, at).collect()] == pairs
    places = {}
    for r in evaluation.results_order(spark, at).collect():
        places.setdefault(r.category, []).append(r.place)
    assert sum(map(len, places.values())) == 240 and max(map(len, places.values())) > 100
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    newest = sorted(range(130), key=lambda k: (-(k % 28), k))
    assert [(r.o_orderkey, r.c_custkey) for r in profiles.order_history(spark, at).collect()] == [(k, None if k % 2 else 1) for k in newest]


def test_components_take_all_edges_of_documents(spark, tables):
    texts = {3: "same", 7: "same", 8: "same", 9: "write to a@b.ru", 10: "or to A@b.ru, c@d.ru", 11: "c@d.ru", 12: "alone", 13: "x@y.ru", 14: "x@y.ru and", 15: "x@y.ru or"}
    langs = {14: "de", 15: "fr"}
    at = tables("documents", [(k, t, langs.get(k, "en")) for k, t in texts.items()], "doc_id long, text string, lang string")
    assert rows(resolution.components(spark, at)) == [(3, 3), (7, 3), (8, 3), (9, 9), (10, 9), (11, 9)]


def test_counts_and_pairs_of_all_customers(spark, tables):
    tables("nation", [(0,), (1,)], "n_nationkey int")
    people = [(k, k % 2, "s", 100.0 * (k - 9)) for k in range(60)]
    at = tables("customer", people, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    assert rows(evaluation.vacancy_counts(spark, at)) == [(0, 30, 25, 5), (1, 30, 25, 5)]
    agree = lambda a, b: "nation, segment" + ", balance" * (b - a < 5)
    assert rows(profiles.compared_fields(spark, at)) == [(a, b, agree(a, b)) for a, b in combinations(range(60), 2) if (a + b) % 2 == 0]


def _parts(ids, pairs):
    part = {i: i for i in ids}
    for a, b in pairs:
        part = {i: part[a] if p == part[b] else p for i, p in part.items()}
    return {frozenset(i for i in ids if part[i] == p) for p in part.values()}


def test_links_among_copies_of_a_seen_first(spark):
    keys = spark.createDataFrame([(k, "k", "en") for k in (1, 2, 3)], "id long, key string, person string")
    seen = spark.createDataFrame([(1, 2), (3, 1)], "a long, b long")
    assert rows(resolve.unseen_links(keys, seen)) == [(2, 3)]


def test_links_have_the_components_of_all_unseen_pairs(spark):
    draw = random.Random(1)
    held, seen, truth = [], [], []
    for g in range(80):
        ids = range(10 * g, 10 * g + draw.randint(2, 8))
        names = {i: draw.choice(["en", "en", "de", None][: 1 + g % 4]) for i in ids}
        pairs = list(combinations(ids, 2))
        known = draw.sample(pairs, int(len(pairs) * draw.choice([0, 0.3, 0.6, 0.9])))
        held += [(i, f"k{g}", names[i]) for i in ids]
        seen += [p if draw.random() < 0.5 else p[::-1] for p in known]
        truth.append((ids, names, set(pairs) - set(known)))
    alike = compatible(spark, "en", "de")
    found = rows(resolve.unseen_links(spark.createDataFrame(held, "id long, key string, person string"), spark.createDataFrame(seen, "a long, b long")))
    for ids, names, left in truth:
        own = {p for p in found if p[0] in ids}
        assert own <= left and _parts(ids, own) == _parts(ids, left)
        fits = lambda ps: [p for p in ps if alike(names[p[0]], names[p[1]])]
        assert _parts(ids, fits(own)) == _parts(ids, fits(left))


def test_one_person_in_three_spellings_keeps_the_key(spark):
    names = {"one": ["Иванов Иван", "Иванов И.", "Ivanov Ivan"], "hot": ["Иванов Иван", "Петров Пётр", "Сидорова Анна"]}
    held = [(10 * k + i, key, name) for k, key in enumerate(names) for i, name in enumerate(names[key])]
    kept = resolve.guarded_keys(spark.createDataFrame(held, "id long, key string, person string"))
    assert {r.key for r in kept.collect()} == {"one"} and kept.count() == 3


def test_exact_merge_is_brute_force(spark):
    draw = random.Random(7)
    pool = ["Иванов Иван", "Иванов Иван Петрович", "Иванов Иван Сергеевич", "Иванов И.", "Петров Пётр", None]
    people = {i: (draw.choice(pool), draw.randint(0, 9)) for i in range(120)}
    keys = [(i, f"k{draw.randint(0, 60)}") for i in people for _ in range(draw.randint(1, 2))]
    seen = {tuple(sorted(draw.sample(range(120), 2))) for _ in range(60)}
    fits = compatible(spark, *(n for n in pool if n))
    holders = {}
    for i, k in sorted(set(keys)):
        holders.setdefault(k, []).append(i)
    root, apart = {i: i for i in people}, set()
    for k, group in holders.items():
        heads = []
        for i in group:
            if people[i][0] and not any(fits(people[i][0], people[h][0]) for h in heads):
                heads.append(i)
        if len(group) < 2 or len(heads) > 2:
            continue
        for a, b in combinations(group, 2):
            if (a, b) in seen:
                continue
            if fits(people[a][0], people[b][0]):
                root = {i: root[a] if r == root[b] else r for i, r in root.items()}
            else:
                apart.add((k, frozenset((people[a][0], people[b][0]))))
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    merged, beside = set(), set()
    for group in groups.values():
        parts = []
        for i in sorted(group, key=lambda i: (people[i][1], i), reverse=True):
            home = next((p for p in parts if all(fits(people[i][0], people[o][0]) for o in p)), None)
            home.append(i) if home else parts.append([i])
        merged |= {(p[0], i) for p in parts for i in p[1:]}
        beside |= {tuple(sorted((parts[0][0], p[0]))) for p in parts[1:]} - seen
    records = spark.createDataFrame([(i, *x) for i, x in people.items()], "id long, name string, fresh int")
    parts, pairs = resolve.merge_exact(records, spark.createDataFrame(keys, "id long, key string"), spark.createDataFrame(sorted(seen), "a long, b long"))
    found = rows(pairs)
    assert {(a, b) for a, b, state, _ in found if state == "merged"} == merged
    open_ = {(a, b) for a, b, state, c in found if state == "open" and c == 0.5}
    assert beside <= open_ and not open_ & seen
    said = {(k, frozenset((people[a][0], people[b][0]))) for a, b in open_ for k in holders if a in holders[k] and b in holders[k]}
    assert apart <= said
    assert all((a, b) in beside or not fits(people[a][0], people[b][0]) for a, b in open_)


def test_links_of_one_key_are_not_all_pairs(spark):
    held = [(k, "k", "Иванов Иван" if k % 3 else "Иванов И.") for k in range(600)]
    keys = spark.createDataFrame(held, "id long, key string, person string")
    assert resolve.linked(keys, spark.createDataFrame([], "a long, b long")).count() < 4 * len(held)


def test_merge_decide_and_repoint(spark):
    records = spark.createDataFrame([(1, 5, "a", None, ["x"]), (2, 9, None, "p", ["y", "x"]), (3, 1, "c", "q", None)], "id long, fresh int, name string, city string, phones array<string>")
    pairs = spark.createDataFrame([(1, 2, "open", 0.7), (1, 3, "open", 0.5)], "a long, b long, status string, confidence double")
    decided = spark.createDataFrame([(1, 2, ["city"])], "a long, b long, take array<string>")
    after, table = resolve.merge_pairs(records, pairs, decided, ["name", "city"], ["phones"])
    row = after.first()
    assert (row.id, row.absorbed, row.name, row.city, row.phones, row.snapshot.city) == (2, 1, "a", None, ["y", "x"], "p")
    assert rows(table) == [(1, 3, "open", 0.5), (2, 1, "merged", 0.7)]
    assert resolve.auto_merged(table).first().n == 0
    held = table.selectExpr("*", "cast(null as long) AS postponed_at")
    said = spark.createDataFrame([(3, 1, "postpone", 4), (1, 3, "reject", 6), (2, 1, "reject", 7)], "a long, b long, action string, at long")
    assert rows(resolve.decided_pairs(held, said)) == [(1, 3, "different", 0.5, None), (2, 1, "merged", 0.7, None)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "id long, duplicate_of long")
    assert rows(resolve.repointed(chain)) == [(1, 3), (2, 3), (7, 8)]


def test_repeats_within_a_minute(spark):
    import datetime

    from rosterlake.operators import vacancy

    base = datetime.datetime(2024, 1, 1)
    times = [0, 30, 60, 61, 100, 121, 122, 400, 401]
    df = spark.createDataFrame([("k", base + datetime.timedelta(seconds=s)) for s in times], "key string, ts timestamp")
    kept = sorted(int((r.ts - base).total_seconds()) for r in vacancy.once_a_minute(df, ["key"], "ts").collect())
    assert kept == [0, 61, 122, 400]
