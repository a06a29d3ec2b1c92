"""Entity resolution: keys, guarded links, components, compatible parts, reversible merges.

A key that three or more different people hold links nobody; this guard comes before any join of a key with itself, so a popular
key never makes pairs. Records of one spelling of a name are alike to it, so links are made between spellings and, within them, with one
record each; no step makes all pairs of a key. Components come from label propagation with written rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.bind import bound
from . import ranked
from .stored import Scratch, unused

#: People at which a key is common, and the confidences of pairs.
COMMON, UNSURE, POSSIBLE, SURE = 3, 0.5, 0.7, 1.0


def guarded_keys(keys: DataFrame, most_people: int = COMMON - 1) -> DataFrame:
    """Rows of ``keys(id, key, person)`` whose key has two records or more and few people. Compatible names are one person;
    only keys of more spellings than people allowed need that look.

    Each round takes a key's first spelling as a person and lets go of all that are compatible with it; what is left after as many rounds as
    people are allowed are more people. So a spelling is compared with a few, never with all others of its key."""
    tables = Scratch(keys.sparkSession, "guarded")
    counts = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.count_distinct("person").alias("spellings")).where("n > 1")
    counts = tables.store(counts.select("key", "spellings"), "counts")
    doubtful = counts.where(F.col("spellings") > most_people).select("key")
    if not doubtful.head(1):
        return keys.join(counts.select("key"), "key")
    left = keys.where("person <> ''").groupBy("key", "person").agg(F.min("id").alias("id")).join(doubtful, "key")
    left = left.select("key", "id", "person", names.readings(F.col("person")).alias("r"), names.has_latin(F.col("person")).alias("latin"))
    for k in range(most_people):
        left = tables.store(left, f"left{k}")
        one = left.groupBy("key").agg(F.min_by(F.struct("r", "latin"), F.struct("id", "person")).alias("one"))
        left = left.join(one, "key").where(~names.readings_agree(F.col("r"), F.col("one.r"), F.col("latin") | F.col("one.latin"))).drop("one")
    common = tables.store(left.select("key").distinct(), "common")
    tables.drop(*(f"left{k}" for k in range(most_people)))
    return keys.join(counts.select("key"), "key").join(common, "key", "left_anti")


def key_pairs(keys: DataFrame) -> DataFrame:
    """``a, b`` of records that share a key: each with the key's first record; components are those of all pairs."""
    first = keys.groupBy("key").agg(F.min("id").alias("a"))
    return keys.join(first, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()


def unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs that are in no state yet, in either order."""
    known = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")


def linked(keys: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``key, a, b, compatible``: unseen pairs of records of ``keys(id, key, person)`` that share a key.

    For each couple of a key's spellings, compatible or not, one record of the first, the one with the fewest seen pairs, is paired
    with all of the second; a record seen with that one is paired with every record of the first. That is at most as many pairs more
    as are seen, and within and between spellings the components are those of all unseen pairs."""
    spelling = F.struct(F.coalesce("person", F.lit("")).alias("name"), F.col("person").isNull().alias("none"))
    tables = Scratch(keys.sparkSession, "linked")  # the keys' plan is read several times
    rows = tables.store(keys.select("key", spelling.alias("s"), "id").distinct(), "rows")
    one = rows.groupBy("key", "s").agg(F.min("id").alias("least"))
    met = one.join(one.select("key", F.col("s").alias("t")), "key")
    couples = met.where("s <> t").select("s", "t").distinct()
    read = lambda c: F.when(~F.col(f"{c}.none"), names.readings(F.col(f"{c}.name")))
    latin = names.has_latin(F.col("s.name")) | names.has_latin(F.col("t.name"))
    # names are read and compared once, however many keys they share; a spelling agrees with itself if it has a reading
    spelled = rows.select("s").distinct().select("s", read("s").alias("r"))
    agree = couples.join(spelled.withColumnRenamed("r", "rs"), "s").join(spelled.select(F.col("s").alias("t"), F.col("r").alias("rt")), "t")
    own = spelled.select("s", F.col("s").alias("t"), F.col("r").alias("rs"), F.col("r").alias("rt"))
    agree = agree.select("s", "t", "rs", "rt").unionByName(own).select("s", "t", names.readings_agree(F.col("rs"), F.col("rt"), latin).alias("compatible"))
    group = ["key", "s", "t"]
    if seen is None:
        hubs = met.join(agree, ["s", "t"]).select(*group, "compatible", F.col("least").alias("hub"))
        star = hubs.join(rows.select("key", F.col("s").alias("t"), "id"), ["key", "t"]).where("id <> hub")
        return star.select("key", F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"), "compatible").distinct()
    couples = met.join(agree, ["s", "t"]).select("key", "s", "t", "compatible")
    both = seen.select("a", "b").unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    ends = both.join(rows.withColumnRenamed("id", "a"), "a").join(rows.select("key", F.col("s").alias("t"), F.col("id").alias("b")), ["key", "b"])
    times = ends.groupBy(*group, F.col("a").alias("id")).agg(F.count("*").alias("n"))
    placed = rows.join(couples, ["key", "s"]).join(times, [*group, "id"], "left")
    hubs = placed.groupBy(*group, "compatible").agg(F.min_by("id", F.struct(F.coalesce("n", F.lit(0)), "id")).alias("hub"))
    star = hubs.join(rows.select("key", F.col("s").alias("t"), "id"), ["key", "t"]).where("id <> hub")
    star = star.select("key", "compatible", F.col("hub").alias("a"), F.col("id").alias("b"))
    rest = ends.join(hubs, group).where("a = hub").select("key", "s", "compatible", F.col("b").alias("a"))
    beside = rest.join(rows.select("key", "s", F.col("id").alias("b")), ["key", "s"]).where("a <> b").select("key", "compatible", "a", "b")
    found = star.unionByName(beside).select("key", "compatible", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.join(known, ["a", "b"], "left_anti").select("key", "a", "b", "compatible")


def unseen_links(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """``a, b`` of ``linked``, whatever their names."""
    return linked(keys, seen).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id) of all ends of ``edges(a, b)``.

    Each id first keeps its least neighbour only, to which its other ones move: far fewer edges where keys overlap. Then rounds of taking
    the least label around and of following labels, a written table each, of which the last alone is kept."""
    tables = Scratch(edges.sparkSession, "components")
    once = tables.store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "once")
    least = once.groupBy("b").agg(F.min("a").alias("least"))
    others = once.join(least, "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    fewer = least.select(F.col("least").alias("a"), "b").unionByName(others)
    both = tables.store(fewer.unionByName(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    tables.drop("once")
    labels = tables.store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels0")
    k = 0
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        closer = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), "component")
        target = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        next_ = F.least("to", "beyond")
        after = closer.join(target, "to").select("id", next_.alias("component"), (next_ < F.col("component")).alias("moved"))
        after = tables.store(after, f"labels{k + 1}")
        going = bool(after.where("moved").head(1))
        tables.drop(f"labels{k}")
        labels, k = after.select("id", "component"), k + 1
        if not going:
            tables.drop("edges")
            return labels


def split_parts(members: DataFrame) -> DataFrame:
    """``component, id, part`` of ``members(component, id, name, fresh)``: in order of freshness each joins the first
    part with all of whose names its own is compatible; ``part`` is the part's freshest id.

    Records of one spelling always end in one part, so only a component's spellings meet in a task, each with those it can't be one person with."""
    name = F.coalesce("name", F.lit(""))
    tables = Scratch(members.sparkSession, "parts")
    spelled = members.groupBy("component", name.alias("name")).agg(F.max(F.struct("fresh", "id")).alias("head"))
    readings = F.when(F.col("name") != "", names.readings(F.col("name")))
    spelled = tables.store(spelled.select("component", "name", F.col("head.fresh").alias("fresh"), F.col("head.id").alias("id"), readings.alias("r"), names.has_latin(F.col("name")).alias("latin")), "spelled")
    other = spelled.select("component", F.col("name").alias("other"), F.col("r").alias("r2"), F.col("latin").alias("latin2"))
    apart = spelled.join(other, "component").where((F.col("name") != F.col("other")) & ~names.readings_agree(F.col("r"), F.col("r2"), F.col("latin") | F.col("latin2")))
    apart = apart.groupBy("component", "name").agg(F.collect_set("other").alias("apart"))
    judged = spelled.select("component", "name", "fresh", "id").join(apart, ["component", "name"], "left")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        for row in rows.sort_values(["fresh", "id"], ascending=False).itertuples():
            apart = set(row.apart) if row.apart is not None else set()
            home = next((p for p in parts if apart.isdisjoint(p[1])), None)
            if home is None:
                parts.append((row.id, {row.name}))
            else:
                home[1].add(row.name)
        out = [(rows["component"].iloc[0], name, head) for head, held in parts for name in held]
        return pd.DataFrame(out, columns=["component", "name", "part"])

    kinds = members.schema
    id_, component = kinds["id"].dataType.simpleString(), kinds["component"].dataType.simpleString()
    found = judged.groupBy("component").applyInPandas(fit, f"component {component}, name string, part {id_}")
    return members.withColumn("name", name).join(found, ["component", "name"]).select("component", "id", "part")


def merge_exact(records: DataFrame, keys: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates of ``records(id, name, fresh)`` by ``keys(id, key)``; ``seen(a, b)``: pairs in any state.

    Returns ``id, component, part`` of the linked records (a part's records are one person, its head survives) and new pairs ``a, b, status,
    confidence``: merged ones (head, absorbed) at 1.0; open ones at 0.5 for spellings that share a key but can't be one person, one a key and
    couple of spellings, and between a component's first part and its others. Seen pairs are never proposed again nor linked directly."""
    tables = Scratch(records.sparkSession, "exact")
    held = keys.select("id", "key").distinct().join(records.select("id", F.col("name").alias("person")), "id")
    links = tables.store(linked(guarded_keys(held), seen), "links")
    members = components(links.where("compatible").select("a", "b")).join(records.select("id", "name", "fresh"), "id")
    parts = tables.store(split_parts(members), "parts")
    named = records.select("id", F.coalesce("name", F.lit("")).alias("name"))
    a, b = named.toDF("a", "name_a"), named.toDF("b", "name_b")
    apart = links.where("NOT compatible").join(a, "a").join(b, "b")
    apart = apart.groupBy("key", F.least("name_a", "name_b").alias("x"), F.greatest("name_a", "name_b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p"))
    heads = parts.where("id = part").join(records.select("id", "fresh"), "id")
    first = heads.groupBy("component").agg(F.max(F.struct("fresh", "id")).alias("h"))
    beside = heads.join(first, "component").where("id <> h.id").select(F.least("h.id", "id").alias("a"), F.greatest("h.id", "id").alias("b"))
    open_ = unseen(apart.select("p.a", "p.b").unionByName(beside), seen).withColumns({"status": F.lit("open"), "confidence": F.lit(UNSURE)})
    merged = parts.where("id <> part").select(F.col("part").alias("a"), F.col("id").alias("b"), F.lit("merged").alias("status"), F.lit(SURE).alias("confidence"))
    return parts, tables.store(open_.unionByName(merged), "pairs")


def absorb(main: DataFrame, old: DataFrame, by: list[str], scalars: list[str], lists: list[str], take: str | None = None) -> DataFrame:
    """Rows of ``main`` after each has absorbed the row of ``old`` with the same ``by``: missing scalars come from ``old``, those named in the
    array column ``take`` too; lists are united in order; ``snapshot`` holds what ``main`` had."""
    held = old.select(*by, *(F.col(c).alias(f"_old_{c}") for c in (*scalars, *lists)))
    rows = main.join(held, by, "left").withColumn("snapshot", F.struct(*scalars, *lists))
    wanted = lambda c: F.coalesce(F.array_contains(take, c), F.lit(False)) if take else F.lit(False)
    filled = {c: F.when(wanted(c), F.col(f"_old_{c}")).otherwise(F.coalesce(c, f"_old_{c}")) for c in scalars}
    united = {c: F.array_union(F.coalesce(c, F.array()), F.coalesce(f"_old_{c}", F.array())) for c in lists}
    return rows.withColumns(filled | united).drop(*(f"_old_{c}" for c in (*scalars, *lists)))


def merge_pairs(records: DataFrame, pairs: DataFrame, decided: DataFrame, scalars: list[str], lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``pairs(a, b, status, confidence)`` that a person merges by ``decided(a, b, take)``: of the two records the fresher one stays.

    Returns the surviving records with ``absorbed`` (the other's id) and ``snapshot``, and the pair table, where merged pairs read (main, old)."""
    chosen = pairs.select("a", "b").join(decided, ["a", "b"])
    fresh = records.select("id", "fresh")
    chosen = chosen.join(fresh.toDF("a", "fresh_a"), "a").join(fresh.toDF("b", "fresh_b"), "b")
    first = F.struct("fresh_a", "a") >= F.struct("fresh_b", "b")
    chosen = chosen.select("a", "b", "take", F.when(first, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("absorbed"))
    main = records.join(chosen.select("id", "absorbed", "take"), "id")
    old = chosen.select("id", "absorbed").join(records.withColumnRenamed("id", "absorbed"), "absorbed")
    after = absorb(main, old, ["id", "absorbed"], scalars, lists, "take").drop("take")
    rest = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
    done = chosen.join(pairs.select("a", "b", "confidence"), ["a", "b"])
    return after, rest.unionByName(done.select(F.col("id").alias("a"), F.col("absorbed").alias("b"), F.lit("merged").alias("status"), "confidence"))


def decided_pairs(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``pairs(a, b, status, confidence, postponed_at)`` after ``decisions(a, b, action, at)``, of each pair the last one: rejected pairs are
    ``different``, postponed ones stay open and go to the end of the queue; only open pairs take decisions."""
    last = decisions.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.max_by(F.struct("action", "at"), "at").alias("_d"))
    same = (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b"))
    rows = pairs.join(last, same, "left")
    is_open = F.col("status") == "open"
    return rows.withColumns(
        {
            "postponed_at": F.when(is_open & (F.col("_d.action") == "postpone"), F.col("_d.at")).otherwise(F.col("postponed_at")),
            "status": F.when(is_open & (F.col("_d.action") == "reject"), "different").otherwise(F.col("status")),
        }
    ).drop("_a", "_b", "_d")


def auto_merged(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs were merged without a person's decision."""
    return pairs.agg(F.count_if((F.col("status") == "merged") & (F.col("confidence") >= SURE)).alias("n"))


def repointed(duplicates: DataFrame) -> DataFrame:
    """``id, duplicate_of`` with chains followed to their ends, for ``duplicates(id, duplicate_of)``."""
    ends = components(duplicates.select(F.col("id").alias("a"), F.col("duplicate_of").alias("b")))
    tops = duplicates.select(F.col("duplicate_of").alias("id")).distinct().join(duplicates.select("id"), "id", "left_anti")
    return duplicates.select("id").join(ends, "id").join(ends.join(tops, "id").select("component", F.col("id").alias("duplicate_of")), "component").select("id", "duplicate_of")


def survivor(rows: DataFrame, part: str, order: list[Column], scalars: list[str], lists: list[str]) -> DataFrame:
    """One record for each part: for each scalar the first value in order, for each list the union, and what was absorbed."""
    placed = ranked.ranked(rows, Scratch(rows.sparkSession, "survivors"), "rows", [part], order, "_rank")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank")))
    gathered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_rank", c))), lambda x: x[c])
    return placed.groupBy(part).agg(
        F.min_by("id", "_rank").alias("id"),
        *(first(c).alias(c) for c in scalars),
        *(F.array_distinct(F.flatten(gathered(c))).alias(c) for c in lists),
        F.array_sort(F.collect_list(F.when(F.col("_rank") > 1, F.col("id")))).alias("absorbed"),
    )


def restored(current: Column, old: Column, before: Column) -> Column:
    """A scalar after an undone merge: back to what it was if it still is what the absorbed record gave."""
    return F.when(~current.eqNullSafe(before) & current.eqNullSafe(old), before).otherwise(current)


def restored_list(current: Column, old: Column, before: Column) -> Column:
    """A list without what only the absorbed record brought."""
    return F.array_except(current, F.array_except(old, before))


def employers(positions: Column) -> Column:
    """A map from a company's key to its last listed ``struct(start, stop)`` in years; an open end is 9999, a start of no year is left out."""
    year = lambda c: F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")
    spans = F.transform(positions, lambda p: F.struct(p["company_key"].alias("key"), F.struct(year(p["start"]).alias("start"), F.coalesce(year(p["end"]), F.lit(9999)).alias("stop")).alias("value")))
    good = F.filter(spans, lambda x: (x["key"] != "") & x["value"]["start"].isNotNull())
    last = F.filter(good, lambda x, k: ~F.exists(F.slice(good, k + 2, F.size(good)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def possible(records: DataFrame, seen: DataFrame) -> DataFrame:
    """``a, b, status, confidence`` of ``records(id, name, positions)`` who worked for one company at one time under compatible names.

    Records meet on a word of the name (three letters or more) and a company together, so neither a common name nor a large company alone
    makes pairs."""
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(names.to_cyrillic(F.col("name")), "ё", "е"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    rows = records.select("id", names.readings(F.col("name")).alias("r"), names.has_latin(F.col("name")).alias("latin"), tokens.alias("tokens"), employers(F.col("positions")).alias("jobs"))
    rows = rows.select("id", "r", "latin", "tokens", F.explode("jobs").alias("company", "span")).select("*", F.explode("tokens").alias("token"))
    rows = rows.select("id", "r", "latin", "company", "span", "token")
    overlap = (F.col("x.span.start") <= F.col("y.span.stop")) & (F.col("y.span.start") <= F.col("x.span.stop"))
    fits = names.readings_agree(F.col("x.r"), F.col("y.r"), F.col("x.latin") | F.col("y.latin"))
    return unseen(blocked_pairs(rows, ["token", "company"], overlap & fits), seen).withColumns({"status": F.lit("open"), "confidence": F.lit(POSSIBLE)})


def blocked_pairs(rows: DataFrame, block: list[str], residual: Column, near: tuple[str, float] | None = None) -> DataFrame:
    """``a, b`` of rows that share the blocking key and meet the residual on ``x`` and ``y``.

    near: a number and a width, if the residual only holds for rows whose numbers are less than the width apart; rows then meet in bands of that
    width, each with its own and the two beside it, so a block's work grows with its pairs that are near, not with all of them."""
    x, y, same = rows, rows, list(block)
    if near:
        band, same = unused(rows, "_band"), [*block, unused(rows, "_band")]
        of = F.floor(F.col(near[0]) / (1.001 * near[1])).cast("double")  # a little wider, so rounding parts no neighbours
        x, y = rows.withColumn(band, of), rows.withColumn(band, F.explode(F.array(of - 1, of, of + 1)))
    x, y = x.alias("x"), y.hint("merge").alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in same]
    return x.join(y, [*on, F.col("x.id") < F.col("y.id"), residual]).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def all_pairs(rows: DataFrame, group: str, order: tuple[str, ...] = (), mine: tuple[str, ...] = (), cells: int = 10, most: int = 1 << 15, block: int = 512) -> DataFrame:
    """``a, b`` and the structs ``x, y``: all pairs of ids of ``rows(id, group, ..)`` in a group, once each; ``a`` is the smaller id and ``x`` its row. ``y`` lacks the
    columns ``mine``. Ids are numbers.

    Rows are dealt into cells by ranges of ids and each couple of cells is a key of its own: a group is the work of many tasks and a row is copied ``cells + 1`` times,
    as part of an array of ``most`` rows or so. Pairs come block by block, one record with all of a block, whose rows are in the order of ``order``: what is told
    by these columns seldom changes, so files of the pairs, which grow with the square of a group, hold runs and repeats."""
    own, couple, part, ends, n, xs, ys = (unused(rows, c) for c in ("_cell", "_couple", "_part", "_ends", "_n", "_xs", "_ys"))
    held = rows.where(F.col("id").isNotNull() & F.col(group).isNotNull())
    bounds = held.groupBy(group).agg(F.percentile_approx("id", [k / cells for k in range(1, cells + 1)], 100 * cells).alias(ends), F.count("*").alias(n))
    cell = F.least(F.size(F.filter(ends, lambda end: end < F.col("id"))), F.lit(cells - 1))
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / (cells * most)))
    fields = [*order, *(c for c in rows.columns if c not in (*order, group))]
    dealt = held.join(bounds, group).groupBy(group, cell.alias(own), deal.alias(part)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(xs))
    dealt = Scratch(rows.sparkSession, "dealt").store(dealt, "dealt")
    x = dealt.select(group, F.explode(F.transform(F.sequence(own, F.lit(cells - 1)), lambda other: F.col(own) * cells + other)).alias(couple), xs)
    theirs = F.transform(xs, lambda r: r.dropFields(*mine)) if mine else F.col(xs)
    y = dealt.select(group, F.explode(F.transform(F.sequence(F.lit(0), F.col(own)), lambda other: other * cells + F.col(own))).alias(couple), theirs.alias(ys))
    # within a cell a block is of near ids, so nearly all records come before all of it or after
    diagonal = F.col(couple) % (cells + 1) == 0
    by_id = lambda held: F.transform(F.sort_array(F.transform(held, lambda r: F.struct(r["id"].alias("id"), r.alias("r")))), lambda r: r["r"])
    cut = lambda held: F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / block).cast("int")), lambda k: F.slice(held, k * block + 1, F.lit(block)))
    blocks = F.when(diagonal, F.transform(bound(by_id(F.col(ys)), cut), lambda b: F.sort_array(b))).otherwise(cut(F.col(ys)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many pairs, so parts aren't merged by size
    x, y = (side.repartition(parts, group, couple) for side in (x, y))
    met = x.join(y.hint("merge"), [group, couple]).select(couple, xs, F.explode(blocks).alias(ys))
    # sorted here and not before: as interpreted expressions these hand on one record with one block at a time; compiled loops would first hold all of a block's pairs
    met = met.select(ys, F.explode(F.when(diagonal, by_id(F.col(xs))).otherwise(F.transform(xs, lambda r: r))).alias("x"))
    met = met.select("x", F.explode(ys).alias("y")).where("x.id < y.id")
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x", "y")


def spelled_friends(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``rows(id, group, name, ..)`` with, for the name, ``spelling``, the number of the name in its group (null without a name), and ``friends``, the numbers of those that can be
    one person's; what ``names.names_compatible`` says of two rows is then ``names.befriended``.

    Last names of one person differ by an edit at most, so they share the word or one of it with a letter left out: only such names are compared."""
    tables = Scratch(rows.sparkSession, "spelled")
    spelt = rows.where(F.col(name).isNotNull()).select(group, name).distinct().withColumn("spelling", F.monotonically_increasing_id())
    spelt = spelt.withColumns({"read": names.readings(F.col(name)), "latin": names.has_latin(F.col(name))})
    spelt = tables.store(spelt.where("read IS NOT NULL"), "spelt")
    # of keys only hashes travel, a chance meeting is judged like any other; no spelling travels to meet itself
    near = F.array_distinct(F.transform(F.flatten(F.transform("read", lambda r: names.near_keys(r["last"]))), lambda key: F.xxhash64(key)))
    share = spelt.select(group, "spelling", F.explode(near).alias("key"))
    met = share.alias("x").join(share.hint("merge").alias("y"), [group, "key"]).where("x.spelling < y.spelling").select(group, F.col("x.spelling").alias("k"), F.col("y.spelling").alias("m")).distinct()
    of = lambda k: spelt.select(group, F.col("spelling").alias(k), F.col("read").alias(f"read_{k}"), F.col("latin").alias(f"latin_{k}"))
    held = met.join(of("k").hint("merge"), [group, "k"]).join(of("m").hint("merge"), [group, "m"])
    held = held.where(names.readings_agree(F.col("read_k"), F.col("read_m"), F.col("latin_k") | F.col("latin_m"))).select(group, "k", "m")
    alone = spelt.where(names.readings_agree(F.col("read"), F.col("read"), F.col("latin"))).select(group, F.col("spelling").alias("k"), F.col("spelling").alias("m"))
    held = held.unionByName(alone)
    both = held.select(group, F.explode(F.array(F.struct(F.col("k").alias("k"), F.col("m").alias("m")), F.struct(F.col("m").alias("k"), F.col("k").alias("m")))).alias("_p"))
    friends = both.groupBy(group, F.col("_p.k").alias("spelling")).agg(F.collect_set("_p.m").alias("friends"))
    known = spelt.select(group, name, "spelling").join(friends.hint("merge"), [group, "spelling"], "left")
    return tables.store(rows.join(known.hint("merge"), [group, name], "left").drop(name), "known")


def unique_match(left: DataFrame, right: DataFrame, key: str, out: str) -> DataFrame:
    """``left`` with the one row of ``right(key, id)`` that has its key; none if there are several."""
    alone = right.groupBy(key).agg(F.count("*").alias("_n"), F.min("id").alias(out)).where("_n = 1").drop("_n")
    return left.join(alone, key, "left")


def last_owner(owners: DataFrame) -> DataFrame:
    """``contact, owner``: of several holders the one with the largest id."""
    return owners.groupBy("contact").agg(F.max("id").alias("owner"))


def body_pairs(owners: DataFrame, said: DataFrame, seen: DataFrame) -> DataFrame:
    """``a, b, status, confidence``: open pairs of a record that names a contact in its text (``said(id, contact)``) and the contact's last owner
    (``owners(id, contact)``), unless the pair is in a state already."""
    pairs = said.join(last_owner(owners), "contact").where("owner <> id").select(F.col("owner").alias("a"), F.col("id").alias("b"))
    return unseen(pairs, seen).withColumns({"status": F.lit("open"), "confidence": F.lit(UNSURE)})


def merged_list(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs merged without a person (confidence of 1 at least) whose surviving record is still active, with both names, latest pair first."""
    side = lambda x: records.select(F.col("id").alias(x), F.col("name").alias(f"name_{x}"), F.col("duplicate_of").alias(f"of_{x}"))
    sure = pairs.where((F.col("status") == "merged") & (F.col("confidence") >= SURE))
    return sure.join(side("a"), "a").join(side("b"), "b").where("of_a IS NULL AND of_b = a").select("a", "b", "name_a", "name_b")


def link_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """``file_id, owner, rule`` of ``files(file_id, name, text, batch_id)``: the record that each belongs to, by the first rule that names exactly one.

    Anywhere: the first word of the file's name is the record's external id; the record names the file. In the file's own batch, for the name that
    the file's name is, then for the one its text begins with: the same name, or one with the same first two words. Every rule is an equi-join
    with those values that one active record alone has; ``records(id, external_id, source_file, full_name, batch_id, duplicate_of)``."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    spaced = F.trim(F.regexp_replace(stem, r"[_\s]+", " "))
    two = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 2), " ")
    rows = files.select(
        "file_id", "name", "batch_id", F.nullif(F.get(F.split(stem, r"[\s_\-.]+"), F.lit(0)), F.lit("")).alias("token"),
        F.when(names.looks_like_name(spaced), names.normalize_name(spaced)).alias("titled"), names.find_name(F.col("text")).alias("found"),
    )
    active = records.where("duplicate_of IS NULL")

    def alone(value: Column, batch: bool) -> DataFrame:
        by = ["_value", *(["batch_id"] if batch else [])]
        held = active.select(value.alias("_value"), "id", "batch_id").where("_value IS NOT NULL")
        return held.groupBy(*by).agg(F.count("*").alias("_n"), F.min("id").alias("_owner")).where("_n = 1").drop("_n")

    rules = [("id", F.col("token"), F.col("external_id"), False), ("file", F.col("name"), F.col("source_file"), False)]
    for source in ("titled", "found"):
        rules += [(f"{source} name", F.col(source), F.col("full_name"), True), (f"{source} words", two(F.col(source)), two(F.col("full_name")), True)]
    for k, (_, of, value, batch) in enumerate(rules):
        same = alone(value, batch).withColumnRenamed("_owner", f"_owner{k}")
        rows = rows.withColumn("_value", of).join(same, ["_value", *(["batch_id"] if batch else [])], "left").drop("_value")
    owner = F.coalesce(*(F.col(f"_owner{k}") for k in range(len(rules))))
    rule = F.coalesce(*(F.when(F.col(f"_owner{k}").isNotNull(), name) for k, (name, *_) in enumerate(rules)))
    return rows.select("file_id", owner.alias("owner"), rule.alias("rule"))
