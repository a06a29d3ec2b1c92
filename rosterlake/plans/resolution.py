"""Queries of contacts, keys, pairs, components and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, dates, names
from ..operators import resolve
from ..sources import tabular
from .retrieval import candidates, table


def contact_keys(spark, sf_dir):
    emails = contacts.extract_emails(F.col("text"))
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.explode(emails).alias("email"))
    return keyed.select("doc_id", "email", contacts.email_key(F.col("email")).alias("key"))


def _copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.sha1("text").alias("key"), F.col("lang").alias("person"))


def shared_key_guard(spark, sf_dir):
    return resolve.guarded_keys(_copies(spark, sf_dir)).select("id", "key", "person")


def _star(spark, sf_dir):
    return resolve.key_pairs(resolve.guarded_keys(_copies(spark, sf_dir)))


def exact_pairs(spark, sf_dir):
    """Links of documents with equal texts; the language stands for the name."""
    return resolve.linked(resolve.guarded_keys(_copies(spark, sf_dir))).select("a", "b", "compatible").distinct()


def unseen_pairs(spark, sf_dir):
    keys = resolve.guarded_keys(_copies(spark, sf_dir))
    seen = resolve.key_pairs(keys).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("a")), "a").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return resolve.unseen_links(keys, seen)


def components(spark, sf_dir):
    """Of documents that are exact copies or share a contact."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("person"))
    shared = contact_keys(spark, sf_dir).select(F.col("doc_id").alias("id"), "key").distinct().join(langs, "id")
    return resolve.components(_star(spark, sf_dir).unionByName(resolve.key_pairs(resolve.guarded_keys(shared))))


def survivor_merge(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha1("text").alias("part"), "quality", "toxic", F.array("source").alias("sources"), "n_chars")
    merged = resolve.survivor(rows, "part", [F.desc("n_chars"), F.desc("id")], ["quality", "toxic"], ["sources"])
    return merged.select("id", "quality", "toxic", F.array_join("sources", ",").alias("sources"), F.size("absorbed").alias("n_absorbed"))


def unmerge_diff(spark, sf_dir):
    old, before = F.array("lang", "source"), F.array("source", F.lit("own"))
    current = F.array_union(before, old)
    rows = candidates(spark, sf_dir)
    merged = F.coalesce("quality", F.lit(1))
    return rows.select("doc_id", F.array_join(resolve.restored_list(current, old, before), ",").alias("list"), resolve.restored(merged, F.lit(1), F.col("quality")).alias("quality"))


def _people(spark, sf_dir):
    """Customers with name-like names: four spellings of a surname each, and a job."""
    k, code = F.col("c_custkey"), F.translate(F.floor(F.col("c_custkey") / 4).cast("string"), "0123456789", "bdfgklmnrs")
    last = F.concat(F.initcap(code), F.lit("o"), code, F.lit("a"))
    name = F.when(k % 4 == 0, F.concat(last, F.lit(" Ivan"))).when(k % 4 == 1, F.concat(F.lit("Ivan "), last)).when(k % 4 == 2, F.concat(last, F.lit(" I."))).otherwise(F.concat(last, F.lit(" Petr")))
    start = F.element_at(F.array(*map(F.lit, ("1990", "1994-03", "2000", "1990"))), (k % 4 + 1).cast("int"))
    end = F.element_at(F.array(F.lit("1995"), F.lit(None), F.lit("2003"), F.lit("1995")), (k % 4 + 1).cast("int"))
    job = F.struct(F.concat(F.lit("firm"), F.floor(k / 40)).alias("company_key"), start.alias("start"), end.alias("end"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), F.array(job).alias("positions"))


def possible_people(spark, sf_dir):
    return resolve.possible(_people(spark, sf_dir), spark.createDataFrame([], "a long, b long"))


def merged_people(spark, sf_dir):
    """Decisions on possible pairs: those of odd ids are merged, others rejected or postponed."""
    pairs = possible_people(spark, sf_dir)
    records = _people(spark, sf_dir).select("id", "name", (F.col("id") % 7).alias("fresh"), F.when(F.col("id") % 3 > 0, F.col("name")).alias("city"), F.array(F.col("id").cast("string")).alias("phones"))
    decided = pairs.where("b % 2 = 1").select("a", "b", F.array(F.lit("name")).alias("take"))
    merged, after = resolve.merge_pairs(records, pairs, decided, ["name", "city"], ["phones"])
    return merged.select("id", "absorbed", "name", "city", F.array_join("phones", ",").alias("phones"), F.col("snapshot.name").alias("was"))


def decided_people(spark, sf_dir):
    pairs = possible_people(spark, sf_dir).withColumn("postponed_at", F.lit(None).cast("long"))
    decisions = pairs.select("b", "a", F.when(F.col("b") % 3 == 0, "reject").otherwise("postpone").alias("action"), F.col("a").alias("at"))
    return resolve.decided_pairs(pairs, decisions.select(F.col("b").alias("a"), F.col("a").alias("b"), "action", "at"))


def possible_pairs(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return resolve.blocked_pairs(people, ["c_nationkey", "c_mktsegment"], F.abs(F.col("x.c_acctbal") - F.col("y.c_acctbal")) < 5, near=("c_acctbal", 5))


def interval_overlap(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.to_date("o_orderdate").alias("begin"))
    spans = spans.withColumn("end", F.date_add("begin", 30))
    return resolve.blocked_pairs(spans, ["o_custkey"], (F.col("x.begin") <= F.col("y.end")) & (F.col("y.begin") <= F.col("x.end")))


def interval_union_months(spark, sf_dir):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    spans = table(spark, sf_dir, "orders").select("o_custkey", F.struct(month.cast("long").alias("start"), (month + 2).cast("long").alias("stop")).alias("s"))
    months = dates.union_months(F.col("spans"))
    return spans.groupBy("o_custkey").agg(F.collect_list("s").alias("spans")).select("o_custkey", months.alias("months"), F.round(months / 12, 1).alias("years"))


def pair_queue(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pairs = _star(spark, sf_dir).withColumn("postponed", F.col("b") % 3 == 0)
    a, b = (docs.select(F.col("doc_id").alias(x), F.col("source").alias(f"source_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    return joined.orderBy("postponed", "a", "b").select("a", "b", "postponed", "source_a", "source_b")


def link_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("number"), F.col("doc_id").alias("id"))
    by_size = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("string").alias("number"), F.col("doc_id").alias("id"))
    found = resolve.unique_match(resolve.unique_match(pages, rows, "number", "by_id"), by_size, "number", "by_size")
    return found.select("page_id", F.coalesce("by_id", "by_size").alias("owner"))


def body_owner(spark, sf_dir):
    mail = lambda name: contacts.extract_emails(F.col(name))
    domain = lambda id_: table(spark, sf_dir, "documents").select(F.col("doc_id").alias(id_), F.explode(mail("text")).alias("m")).select(id_, F.split_part("m", F.lit("@"), F.lit(2)).alias("contact")).distinct()
    owners, said = domain("id"), domain("doc_id")
    return said.join(resolve.last_owner(owners), "contact").where("owner <> doc_id").select("doc_id", "contact", "owner")


AS_OF = "DATE '1998-01-01'"


def stale_flag(spark, sf_dir):
    day, as_of = F.to_date("o_orderdate"), F.expr(AS_OF)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.is_stale(F.when(F.col("o_orderkey") % 7 > 0, day), as_of).alias("stale"))


def newly_stale(spark, sf_dir):
    day = F.to_date("o_orderdate")
    flags = table(spark, sf_dir, "orders").select("o_orderpriority", dates.is_stale(day, F.expr("DATE '1997-12-01'")).alias("before"), dates.is_stale(day, F.expr(AS_OF)).alias("after"))
    return flags.groupBy("o_orderpriority").agg(F.count_if(F.col("after") & ~F.col("before")).alias("newly"), F.count_if("after").alias("stale"))


def column_profile(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", F.format_string("8 (912) %03d-%02d-%02d", F.col("c_custkey") % 1000, F.lit(11), F.lit(22)).alias("tel"), F.concat(F.lower(F.col("c_mktsegment")), F.lit("@mail.example")).alias("mail"))
    return tabular.column_profile(people, F.expr(AS_OF)).select("column", "n", "email", "phone", "length")


def role_guess(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id < 0 OR text IS NOT NULL").select("lang", "source", "text")
    return tabular.role_by_content(tabular.column_profile(docs, F.expr(AS_OF)), F.expr(AS_OF)).select("column", "role")


def import_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1("text").alias("key"), (F.col("n_chars") < 100).alias("skip"))
    old = rows.where("source = 'src0'").select("key").distinct().withColumn("known", F.lit(True))
    new = rows.where("source <> 'src0'")
    first = new.groupBy("key").agg(F.min("doc_id").alias("first"))
    seen = new.join(old, "key", "left").join(first, "key")
    return seen.groupBy("source").agg(F.count_if(~F.col("skip")).alias("load"), F.count_if("skip").alias("skip"), F.count_if(F.col("known").isNotNull() | (F.col("first") < F.col("doc_id"))).alias("duplicates"))


def names_compatible(spark, sf_dir):
    """All pairs of a nation's customers; names are compared by spellings that are near, not once a pair."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_name")
    known = resolve.spelled_friends(people.where("id IS NOT NULL"), "c_nationkey", "c_name")
    pairs = resolve.all_pairs(known.select("id", "c_nationkey", "spelling", "friends"), "c_nationkey", mine=("friends",))
    return pairs.select("a", "b", names.befriended(F.col("x"), F.col("y")).alias("compatible"))


def exact_merge(spark, sf_dir):
    """New pairs of the merge of documents with equal texts; the source stands for the name, the length for freshness."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("n_chars").alias("fresh"))
    keys = docs.select(F.col("doc_id").alias("id"), F.sha1("text").alias("key"))
    return resolve.merge_exact(records, keys, spark.createDataFrame([], "a long, b long"))[1]


QUERIES = {
    f.__name__: f
    for f in (contact_keys, shared_key_guard, exact_pairs, unseen_pairs, components, survivor_merge, unmerge_diff, possible_pairs, interval_overlap, interval_union_months, pair_queue, link_documents, body_owner, stale_flag, newly_stale, column_profile, role_guess, import_preview, names_compatible, exact_merge, possible_people, merged_people, decided_people)
}

_MAIL = r"list_distinct(list_transform(regexp_extract_all(text, '(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[a-zа-я]{2,}'), lambda x: lower(x)))"
_KEYS = """keys AS (SELECT doc_id AS id, sha1(text) AS key, lang AS person FROM documents),
good AS (SELECT key FROM keys GROUP BY key HAVING count(*) > 1 AND count(DISTINCT person) <= 2),
guarded AS (SELECT keys.* FROM keys JOIN good USING (key)),
pairs AS (SELECT DISTINCT f.a, g.id AS b FROM guarded g JOIN (SELECT key, min(id) AS a FROM guarded GROUP BY key) f ON f.key = g.key AND f.a < g.id)"""
_CODE = "translate((c_custkey // 4)::VARCHAR, '0123456789', 'bdfgklmnrs')"
_NAMED = f"""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN s || ' Ivan' WHEN 1 THEN 'Ivan ' || s WHEN 2 THEN s || ' I.' ELSE s || ' Petr' END AS name
FROM (SELECT c_custkey, upper({_CODE}[1]) || {_CODE}[2:] || 'o' || {_CODE} || 'a' AS s FROM customer)"""
#: Of four spellings of a surname, the first two and the second and third are one person's and worked at one time.
_POSSIBLE = "SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_custkey // 4 = y.c_custkey // 4 AND (x.c_custkey % 4, y.c_custkey % 4) IN ((0, 1), (1, 2))"

ORACLES = {
    "contact_keys": f"""SELECT doc_id, email, CASE WHEN split_part(email, '@', 2) IN ('gmail.com', 'googlemail.com')
THEN replace(regexp_replace(split_part(email, '@', 1), '\\+.*$', ''), '.', '') || '@gmail.com' ELSE email END AS key FROM (SELECT doc_id, unnest({_MAIL}) AS email FROM documents)""",
    "shared_key_guard": f"WITH {_KEYS} SELECT id, key, person FROM guarded",
    "exact_pairs": f"""WITH {_KEYS}, h AS (SELECT key, person, min(id) AS hub FROM guarded GROUP BY key, person)
SELECT DISTINCT least(hub, id) AS a, greatest(hub, id) AS b, h.person = g.person AS compatible FROM h JOIN guarded g ON g.key = h.key AND hub <> id""",
    "unseen_pairs": f"""WITH {_KEYS}, seen AS (SELECT b AS a, a AS b FROM pairs WHERE a IN (SELECT doc_id FROM labels)),
both_ AS (SELECT a, b FROM seen UNION SELECT b, a FROM seen),
ends AS (SELECT x.key, x.person AS s, y.person AS t, e.a, e.b FROM both_ e JOIN guarded x ON x.id = e.a JOIN guarded y ON y.id = e.b AND y.key = x.key),
times AS (SELECT key, s, t, a, count(*) AS n FROM ends GROUP BY ALL),
placed AS (SELECT g.key, g.person AS s, c.t, g.id, coalesce(n, 0) AS n FROM guarded g JOIN (SELECT DISTINCT key, person AS t FROM guarded) c ON c.key = g.key
  LEFT JOIN times m ON m.key = g.key AND m.s = g.person AND m.t = c.t AND m.a = g.id),
hubs AS (SELECT key, s, t, id AS hub FROM placed QUALIFY row_number() OVER (PARTITION BY key, s, t ORDER BY n, id) = 1),
star AS (SELECT hub AS a, g.id AS b FROM hubs h JOIN guarded g ON g.key = h.key AND g.person = h.t AND g.id <> hub),
beside AS (SELECT e.b AS a, g.id AS b FROM ends e JOIN hubs h ON h.key = e.key AND h.s = e.s AND h.t = e.t AND h.hub = e.a JOIN guarded g ON g.key = e.key AND g.person = e.s AND g.id <> e.b)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (FROM star UNION ALL FROM beside) x WHERE (a, b) NOT IN (SELECT (a, b) FROM both_)""",
    "components": f"""WITH RECURSIVE {_KEYS},
mail AS (SELECT DISTINCT doc_id AS id, lang AS person, CASE WHEN split_part(email, '@', 2) IN ('gmail.com', 'googlemail.com')
  THEN replace(regexp_replace(split_part(email, '@', 1), '\\+.*$', ''), '.', '') || '@gmail.com' ELSE email END AS key FROM (SELECT doc_id, lang, unnest({_MAIL}) AS email FROM documents)),
few AS (SELECT key FROM mail GROUP BY key HAVING count(DISTINCT id) > 1 AND count(DISTINCT person) <= 2),
shared AS (SELECT DISTINCT f.a, m.id AS b FROM mail m JOIN few USING (key) JOIN (SELECT key, min(id) AS a FROM mail GROUP BY key) f ON f.key = m.key AND f.a < m.id),
e AS (SELECT a, b FROM pairs UNION SELECT a, b FROM shared), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS reach FROM both_ UNION SELECT r.id, both_.b FROM r JOIN both_ ON r.reach = both_.a)
SELECT id, min(reach) AS component FROM r GROUP BY id""",
    "possible_people": f"SELECT a, b, 'open' AS status, 0.7::DOUBLE AS confidence FROM ({_POSSIBLE})",
    "merged_people": f"""WITH m AS (SELECT a, b FROM ({_POSSIBLE}) WHERE b % 2 = 1), s AS (SELECT *, (a % 7, a) >= (b % 7, b) AS first FROM m),
p AS (SELECT CASE WHEN first THEN a ELSE b END AS id, CASE WHEN first THEN b ELSE a END AS absorbed FROM s)
SELECT id, absorbed, o.name, coalesce(CASE WHEN id % 3 > 0 THEN n.name END, CASE WHEN absorbed % 3 > 0 THEN o.name END) AS city, id || ',' || absorbed AS phones, n.name AS was
FROM p JOIN ({_NAMED}) n ON n.k = id JOIN ({_NAMED}) o ON o.k = absorbed""",
    "decided_people": f"""SELECT a, b, CASE WHEN b % 3 = 0 THEN 'different' ELSE 'open' END AS status, 0.7::DOUBLE AS confidence, CASE WHEN b % 3 <> 0 THEN a END AS postponed_at FROM ({_POSSIBLE})""",
    "names_compatible": "SELECT x.c_custkey AS a, y.c_custkey AS b, levenshtein(x.c_name, y.c_name) <= 1 AS compatible FROM customer x JOIN customer y USING (c_nationkey) WHERE x.c_custkey < y.c_custkey",
    "survivor_merge": """WITH c AS (SELECT d.doc_id, sha1(text) AS part, quality, toxic, source, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, d.doc_id DESC) AS r FROM documents d LEFT JOIN labels USING (doc_id)),
s AS (SELECT part, source, min(r) AS r FROM c WHERE source IS NOT NULL GROUP BY part, source),
l AS (SELECT part, string_agg(source, ',' ORDER BY r) AS sources FROM s GROUP BY part)
SELECT arg_min(doc_id, r) AS id, arg_min(quality, r) FILTER (quality IS NOT NULL) AS quality, arg_min(toxic, r) FILTER (toxic IS NOT NULL) AS toxic, any_value(sources) AS sources, count(*)::INT - 1 AS n_absorbed
FROM c JOIN l USING (part) GROUP BY part""",
    "unmerge_diff": "SELECT d.doc_id, source || ',own' AS list, quality FROM documents d LEFT JOIN labels USING (doc_id)",
    "possible_pairs": "SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y USING (c_nationkey, c_mktsegment) WHERE x.c_custkey < y.c_custkey AND abs(x.c_acctbal - y.c_acctbal) < 5",
    "interval_overlap": """WITH s AS (SELECT o_orderkey AS id, o_custkey, o_orderdate::DATE AS b, o_orderdate::DATE + 30 AS e FROM orders)
SELECT x.id AS a, y.id AS b FROM s x JOIN s y USING (o_custkey) WHERE x.id < y.id AND x.b <= y.e AND y.b <= x.e""",
    "interval_union_months": """WITH s AS (SELECT DISTINCT o_custkey, unnest([year(o_orderdate) * 12 + month(o_orderdate) - 1, year(o_orderdate) * 12 + month(o_orderdate)]) AS m FROM orders)
SELECT o_custkey, count(*) AS months, round(count(*) / 12, 1) AS years FROM s GROUP BY o_custkey""",
    "pair_queue": f"""WITH {_KEYS} SELECT a, b, b % 3 = 0 AS postponed, x.source AS source_a, y.source AS source_b FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b""",
    "link_documents": r"""WITH p AS (SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS number FROM pages),
a AS (SELECT doc_id::VARCHAR AS number, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) = 1), b AS (SELECT n_chars::VARCHAR AS number, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) = 1)
SELECT page_id, coalesce(a.id, b.id) AS owner FROM p LEFT JOIN a USING (number) LEFT JOIN b USING (number)""",
    "body_owner": f"""WITH o AS (SELECT DISTINCT doc_id, split_part(m, '@', 2) AS contact FROM (SELECT doc_id, unnest({_MAIL}) AS m FROM documents)), l AS (SELECT contact, max(doc_id) AS owner FROM o GROUP BY contact)
SELECT doc_id, contact, owner FROM o JOIN l USING (contact) WHERE owner <> doc_id""",
    "stale_flag": f"SELECT o_orderkey, o_orderkey % 7 = 0 OR {AS_OF} - o_orderdate::DATE > 548 AS stale FROM orders",
    "newly_stale": f"""WITH f AS (SELECT o_orderpriority, DATE '1997-12-01' - o_orderdate::DATE > 548 AS b, {AS_OF} - o_orderdate::DATE > 548 AS a FROM orders)
SELECT o_orderpriority, count(*) FILTER (a AND NOT b) AS newly, count(*) FILTER (a) AS stale FROM f GROUP BY 1""",
    "import_preview": """WITH r AS (SELECT doc_id, source, sha1(text) AS key, n_chars < 100 AS skip FROM documents), o AS (SELECT DISTINCT key FROM r WHERE source = 'src0'),
n AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM r WHERE source <> 'src0')
SELECT source, count(*) FILTER (NOT skip) AS load, count(*) FILTER (skip) AS skip, count(*) FILTER (key IN (SELECT key FROM o) OR first < doc_id) AS duplicates FROM n GROUP BY source""",
    "column_profile": """SELECT "column", count(*) AS n, round(avg(e), 6) AS email, round(avg(p), 6) AS phone, median(length(v)) AS length FROM (
SELECT 'c_name' AS "column", c_name AS v, 0 AS e, 0 AS p FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, 0, 0 FROM customer
UNION ALL SELECT 'tel', '8 (912) 000-11-22', 0, 1 FROM customer UNION ALL SELECT 'mail', c_mktsegment || '@mail.example', 1, 0 FROM customer) GROUP BY 1""",
    "role_guess": """SELECT 'lang' AS "column", '' AS role UNION ALL SELECT 'source', '' UNION ALL SELECT 'text', CASE WHEN (SELECT median(length(text)) FROM documents) > 200 THEN 'resume_text' ELSE '' END""",
}
