"""Two-pass ranks, sums, neighbours and trailing counts against windows; schedules and merge logs against brute force."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlake.operators import mergelog, ranked, schedule, trailing, vacancy
from rosterlake.operators.stored import Scratch


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [(k, draw.choice(["hot"] * 8 + ["a", None, ""]), draw.randint(0, 50), draw.choice([None, draw.randint(0, 9)])) for k in range(3000)]
    return spark.createDataFrame(data, "id long, g string, v long, x long").repartition(7)


def same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_ranks_sums_neighbours_and_last_values(spark, rows):
    tables, order = Scratch(spark, "t"), [F.desc("v"), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order)
    found = ranked.ranked(rows, tables, "a", ["g"], order, "place", {"before": "v"})
    assert same(found.select(*rows.columns, "place", "before"), rows.withColumns({"place": F.row_number().over(w), "before": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}))
    beside = ranked.neighbours(rows, tables, "b", ["g"], order, ["v", "id"]).select(*rows.columns, "_before.id", F.col("_after.v").alias("w"))
    assert same(beside, rows.select(*rows.columns, F.lag("id").over(w), F.lead("v").over(w)))
    last = ranked.carried(rows, tables, "c", ["g"], order, {"last": "x"})
    assert same(last, rows.withColumn("last", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    every = ranked.ranked(rows, tables, "d", [], [F.col("id")], "place")
    assert same(every, rows.withColumn("place", F.row_number().over(Window.orderBy("id"))))
    clash = rows.withColumnsRenamed({"x": "_part", "v": "_part_of"})
    assert ranked.ranked(clash, tables, "e", ["g"], [F.col("id")], "place").columns == [*clash.columns, "place"]
    assert ranked.ranked(rows.limit(0), tables, "f", ["g"], order, "place").count() == 0


def test_trailing_counts(spark, rows):
    found = trailing.counts(rows.select("id", "g", "v"), ["g"], "v", "id", 7)
    w = Window.partitionBy("g").orderBy("v").rangeBetween(-7, 0)
    assert same(found, rows.select("id", "g", "v", F.count("*").over(w), F.min("v").over(w)))


def test_once_a_minute(spark):
    draw = random.Random(9)
    data = [(k, draw.choice("ab"), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=draw.randint(0, 3000))) for k in range(300)]
    df = spark.createDataFrame(data, "id long, g string, at timestamp").repartition(5)
    kept, last = set(), {}
    for k, g, at in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        if g not in last or (at - last[g]).total_seconds() > 60:
            kept.add(k)
            last[g] = at
    assert {r.id for r in vacancy.once_a_minute(df, ["g"], "at", "id").collect()} == kept


def test_outcomes_of_fires(spark):
    draw = random.Random(5)
    hour, day = datetime.timedelta(hours=1), datetime.datetime(2024, 3, 1)
    plan = [(k, day.date(), (day + 20 * 24 * hour).date(), [1, 2, 5] if k else list(range(1, 8)), 22, 15) for k in range(3)]
    awake = [(k, day + draw.random() * 400 * hour) for k in range(2) for _ in range(40)] + [(0, day + 22 * hour + hour / 4)]
    fires = schedule.expected(spark.createDataFrame(plan, "id long, first date, last date, days array<int>, hour int, minute int"))
    found = {(r.id, r.fire): (r.status, r.started_at) for r in schedule.outcomes(fires, spark.createDataFrame(awake, "id long, at timestamp")).collect()}
    want = {}
    for k, first, last, days, h, m in plan:
        planned = [datetime.datetime.combine(first, datetime.time(h, m)) + n * 24 * hour for n in range((last - first).days + 1)]
        planned = [f for f in planned if f.isoweekday() in days]
        met = {f: min((a for i, a in awake if i == k and a >= f), default=None) for f in planned}
        for f, a in met.items():
            if a is None:
                want[k, f] = ("waiting", None)
            elif any(g > f and b == a for g, b in met.items()):
                want[k, f] = ("coalesced", None)
            else:
                want[k, f] = ("missed", None) if a - f > 6 * hour else ("run", a)
    assert found == want and {s for s, _ in want.values()} == {"run", "missed", "coalesced", "waiting"}


def brute_replay(records, log):
    """One world, one event after the other; merges keep whole copies of what was."""
    world = {k: dict(v, gone=None) for k, v in records.items()}
    kept, state = {}, {}
    for _, kind, main, old, take, field, value in sorted(log):
        if kind == "edit" and main in world:
            world[main][field] = value
        if kind == "merge" and main != old and main in world and old in world and world[main]["gone"] is None and world[old]["gone"] is None:
            a, b = world[main], world[old]
            children = {k for k in world if world[k]["gone"] == old}
            kept[main, old] = ({"name": a["name"], "city": a["city"], "phones": list(a["phones"])}, children)
            for f in ("name", "city"):
                if b[f] is not None and (f in (take or []) or a[f] is None):
                    a[f] = b[f]
            a["phones"] += [p for k, p in enumerate(b["phones"]) if p not in a["phones"] and p not in b["phones"][:k]]
            for k in children | {old}:
                world[k]["gone"] = main
            state[main, old] = "merged"
        if kind == "unmerge" and (main, old) in kept:
            before, children = kept.pop((main, old))
            a, b = world[main], world[old]
            for f in ("name", "city"):
                if a[f] == b[f] != before[f]:
                    a[f] = before[f]
            a["phones"] = [p for p in a["phones"] if p not in b["phones"] or p in before["phones"]]
            for k in children:
                if world[k]["gone"] == main:
                    world[k]["gone"] = old
            b["gone"], state[main, old] = None, "open"
    return world, state


def test_merge_logs_are_replayed(spark):
    draw = random.Random(11)
    records = {k: {"name": draw.choice([None, "n1", "n2"]), "city": draw.choice([None, "c1", "c2"]), "phones": [f"p{draw.randint(0, 6)}" for _ in range(draw.randint(0, 3))]} for k in range(120)}
    for r in records.values():
        r["phones"] = list(dict.fromkeys(r["phones"]))
    log = []
    for seq in range(900):
        ten = 10 * draw.randint(0, 10)
        a, b = ten + draw.randint(0, 9), ten + draw.randint(0, 9)
        kind = draw.choice(["merge", "merge", "unmerge", "edit"])
        earlier = [x for x in log if x[1] == "merge" and x[2] // 10 * 10 == ten]
        if kind == "unmerge" and earlier:
            a, b = draw.choice(earlier)[2:4]
        log.append((seq, kind, a, None if kind == "edit" else b, draw.choice([None, ["city"], ["name", "city"]]), draw.choice(["name", "city"]), draw.choice([None, "e1", "e2"])))
    log.append((900, "merge", 5000, 1, None, None, None))
    df = spark.createDataFrame([(k, r["name"], r["city"], r["phones"]) for k, r in records.items()], "id long, name string, city string, phones array<string>")
    base, pairs = mergelog.replayed(df, spark.createDataFrame(log, mergelog.LOG).repartition(6), ["name", "city"], ["phones"])
    world, state = brute_replay({k: {**r, "phones": list(r["phones"])} for k, r in records.items()}, log)
    assert {r.id: (r.name, r.city, list(r.phones), r.duplicate_of) for r in base.collect()} == {k: (w["name"], w["city"], w["phones"], w["gone"]) for k, w in world.items()}
    assert {(r.main, r.old): r.status for r in pairs.collect()} == state
    assert sum(s == "open" for s in state.values()) > 20
