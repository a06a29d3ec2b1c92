"""Retrieval: BM25 and vector lists, reciprocal rank fusion, filters, facets and pages.

Rankings end with a unique id; doubles are rounded before they order. The cut of each list comes before hard filters: it is part of
the meaning. BM25 reads the documents once: what a query needs of a document are its length and how often each of the query's terms occurs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.bind import bound
from .stored import Scratch

#: Length of a list, smoothing of ranks, least and close cosine, page, BM25 parameters.
TOP, SMOOTH, LEAST, CLOSE, PAGE, K1, B = 200, 60, 0.25, 0.40, 20, 1.5, 0.75
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: The endings of the Snowball stemmer for Russian; the first of each couple only after a or ya.
_GERUND = ("в|вши|вшись", "ив|ивши|ившись|ыв|ывши|ывшись")
_ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
_PARTICIPLE = ("ем|нн|вш|ющ|щ", "ивш|ывш|ующ")
_VERB = (
    "ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно",
    "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю",
)
_NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stem(word: Column) -> Column:
    """A word without its Russian ending (Snowball); words of other letters stay."""
    word = F.translate(word, "ё", "е")
    head = F.regexp_extract(word, "^[^аеиоуыэюя]*[аеиоуыэюя]", 0)
    rest = F.substring(word, F.length(head) + 1, F.length(word))
    cut = lambda x, one, two: F.regexp_replace(x, f"(?:(?<=[ая])(?:{one})|(?:{two}))$", "")

    def inflected(plain: Column) -> Column:
        noun = F.regexp_replace(plain, f"(?:{_NOUN})$", "")
        verb = bound(cut(plain, *_VERB), lambda x: F.when(x != plain, x).otherwise(noun))
        return bound(F.regexp_replace(plain, f"(?:{_ADJECTIVE})$", ""), lambda x: F.when(x != plain, cut(x, *_PARTICIPLE)).otherwise(verb))

    def derived(x: Column) -> Column:
        # the suffix goes where a consonant after a vowel after a consonant comes before it
        late = F.concat(head, x).rlike("[аеиоуыэюя][^аеиоуыэюя]+[аеиоуыэюя]+[^аеиоуыэюя].*ость?$")
        return F.when(late, F.regexp_replace(x, "ость?$", "")).otherwise(x)

    def tidied(x: Column) -> Column:
        last = F.regexp_replace(x, "(?:ейше?)$", "")
        return bound(last, lambda y: F.when(y.endswith("нн"), F.substring(y, 1, F.length(y) - 1)).when(y != x, y).otherwise(F.regexp_replace(x, "ь$", "")))

    plain = bound(F.regexp_replace(rest, "(?:ся|сь)$", ""), inflected)
    first = bound(cut(rest, *_GERUND), lambda x: F.when(x != rest, x).otherwise(plain))
    fourth = bound(bound(F.regexp_replace(first, "и$", ""), derived), tidied)
    return F.when(head != "", F.concat(head, fourth)).otherwise(word)


#: Russian words that say nothing of what a text is about: pronouns, prepositions, conjunctions, particles and forms of to be.
STOP_WORDS = tuple(
    (
        "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну ли если "
        "уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто "
        "чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее были куда зачем всех можно при об "
        "хоть после над больше тот через эти нас про всего них какая много разве эту моя свою этой перед иногда лучше чуть том нельзя такой им более всегда между"
    ).split()
)


def stemmed_tokens(stop_words: tuple[str, ...] = STOP_WORDS) -> Callable[[Column], Column]:
    """A token function for ``bm25``: without stop words, then stemmed."""
    kept = lambda x: F.filter(tokens(x), lambda t: ~t.isin(*stop_words)) if stop_words else tokens(x)
    return lambda x: F.transform(kept(x), stem)


def bm25(docs: DataFrame, query: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """``doc_id, score`` of all documents with a term of ``query(term)``; Lucene's variant.

    One pass over the documents stores lengths and counts of those with a hit, and observes the totals of all."""
    terms = sorted(r["term"] for r in query.select("term").distinct().collect())  # the query's own terms
    spark = docs.sparkSession
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    seen = Observation()
    place = F.create_map(*(x for k, t in enumerate(terms) for x in (F.lit(t), F.lit(k))))
    sized = docs.select("doc_id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("t"))
    sized = sized.select("doc_id", F.size("t").alias("dl"), F.array_sort(F.transform(F.filter("t", lambda t: t.isin(*terms)), lambda t: place[t])).alias("hits"))
    sized = sized.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).where(F.size("hits") > 0)
    tables = Scratch(spark, "bm25")
    hits = tables.store(sized, "hits")
    n, avgdl = seen.get["n"], seen.get["avgdl"]
    df = {r["term"]: r["df"] for r in hits.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = F.array(*(F.lit(math.log(1 + (n - df.get(k, 0) + 0.5) / (df.get(k, 0) + 0.5))) for k in range(len(terms))))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1)))
    weight = lambda term, f: F.when(f > 0, F.get(idf, term) * f / (f + norm)).otherwise(0.0)
    # hits of one term lie together: one pass counts each and adds its weight when the next begins
    state = lambda term, f, score: F.struct(term.alias("term"), f.alias("f"), score.alias("score"))
    step = lambda s, h: F.when(h == s["term"], state(h, s["f"] + 1, s["score"])).otherwise(state(h, F.lit(1), s["score"] + weight(s["term"], s["f"])))
    score = F.aggregate("hits", state(F.lit(-1), F.lit(0), F.lit(0.0)), step, lambda s: s["score"] + weight(s["term"], s["f"]))
    return hits.select("doc_id", F.round(score, 6).alias("score")).where("score > 0")


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``doc_id, score`` of unit vectors against the one row of ``query(embedding)``."""
    vectors = vectors.withColumn("_wanted", query.select("embedding").scalar())
    product = F.aggregate(F.zip_with("embedding", "_wanted", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(F.col("vec_id").alias("doc_id"), F.round(product, 6).alias("score"))


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """``doc_id, score, place`` of the k best; ties go to the smaller id."""
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """``doc_id, rrf, v_place, l_place, cosine``: ties keep the vector list's order first."""
    v = vector.select("doc_id", F.col("place").alias("v_place"), F.col("score").alias("cosine"))
    rows = v.join(lexical.select("doc_id", F.col("place").alias("l_place")), "doc_id", "full")
    part = lambda c: F.coalesce(1.0 / (SMOOTH + F.col(c)), F.lit(0.0))
    return rows.withColumn("rrf", F.round(part("v_place") + part("l_place"), 9))


def fused_order() -> list[Column]:
    return [F.desc("rrf"), F.col("v_place").asc_nulls_last(), F.col("l_place").asc_nulls_last()]


def gate(fused: DataFrame, least: float = LEAST) -> DataFrame:
    return fused.where(F.col("l_place").isNotNull() | (F.col("cosine") >= least))


def closeness(score: Column) -> Column:
    return F.when(score >= CLOSE, "close").when(score >= LEAST, "near").otherwise("far")


def conditions(filters: dict[str, Column], skip: str | None = None) -> Column:
    """All filters but one; a null condition doesn't hold."""
    kept = [F.coalesce(c, F.lit(False)) for k, c in filters.items() if k != skip]
    return reduce(lambda a, b: a & b, kept, F.lit(True))


def facet_stats(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``facet, without, removed, relax`` for each filter in one pass; ``relax`` marks what to drop when nothing is left."""
    counts = rows.agg(F.count_if(conditions(filters)).alias("total"), *(F.count_if(conditions(filters, k)).alias(k) for k in filters))
    parts = F.array(*(F.struct(F.lit(n).alias("place"), F.lit(k).alias("facet"), F.col(k).alias("without")) for n, k in enumerate(filters)))
    best = F.array_max(F.transform(parts, lambda p: F.struct(p["without"], -p["place"], p["facet"])))["facet"]
    each = counts.select("total", best.alias("best"), F.explode(parts).alias("p"))
    return each.select("p.facet", "p.without", (F.col("p.without") - F.col("total")).alias("removed"), ((F.col("total") == 0) & (F.col("best") == F.col("p.facet"))).alias("relax"))


def by_city(city: str) -> Column:
    """A record's own city, or the one that its profile says."""
    return (F.col("city") == city) | (F.col("parsed.city") == city)


def active(records: DataFrame) -> DataFrame:
    """Records that no merge has absorbed."""
    return records.where(F.col("duplicate_of").isNull())


def number_filter(value: str | None, most: float = 1e9) -> float | None:
    """A number that a person typed, or None for a blank; anything else, infinite or too large raises ``ValueError``."""
    text = (value or "").strip().replace(" ", "").replace(",", ".")
    if not text:
        return None
    number = float(text)
    if not 0 <= number <= most:
        raise ValueError(f"{value!r} is out of range")
    return number


def freshest_first() -> list[Column]:
    """The order of a list by freshness: undated records last, then the larger id."""
    return [F.col("resume_date").desc_nulls_last(), F.desc("id")]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
