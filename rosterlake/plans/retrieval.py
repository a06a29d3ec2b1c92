"""Queries of retrieval, filters and facets over ``documents``, ``labels``, ``embeddings`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, ranked, search
from ..operators.stored import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _lexical(spark, sf_dir) -> DataFrame:
    """The list of the first benchmark item's words."""
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.explode(search.tokens(F.col("text"))).alias("term"))
    return search.top(search.bm25(table(spark, sf_dir, "documents"), item))


def _vectors(spark, sf_dir) -> DataFrame:
    """The list of the first vector's neighbours."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.top(search.cosine(vectors, vectors.orderBy("vec_id").limit(1).select("embedding")))


def _fused(spark, sf_dir) -> DataFrame:
    return search.fuse(_vectors(spark, sf_dir), _lexical(spark, sf_dir))


def lexical_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("closeness", search.closeness(F.col("score")))


def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(*search.fused_order()))).select("doc_id", "rrf", "place")


def hybrid_search(spark, sf_dir):
    fused = search.gate(_fused(spark, sf_dir))
    found = fused.join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    paged = search.page(found, search.fused_order())
    return paged.withColumn("place", F.row_number().over(Window.orderBy(*search.fused_order()))).select("doc_id", "lang", "source", "n_chars", "rrf", "place")


def list_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return search.page(docs.where("lang = 'en'"), [F.desc("n_chars"), F.col("doc_id")], number=2)


def _filters():
    return {"source": F.col("source") == "src1", "lang": F.col("lang") == "en", "quality": F.col("quality") >= 1, "size": F.col("toxic").isNull() | (F.col("toxic") <= 0)}


def filter_null_semantics(spark, sf_dir):
    filters = _filters()
    return candidates(spark, sf_dir).where(search.conditions(filters, skip="source")).select("doc_id", "quality", "toxic")


def facet_stats(spark, sf_dir):
    return search.facet_stats(candidates(spark, sf_dir), _filters())


def facet_relax(spark, sf_dir):
    return search.facet_stats(candidates(spark, sf_dir), _filters() | {"lang": F.col("lang") == "xx", "size": F.col("n_chars") < 0})


def top_cities(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(60)


def not_embedded(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(vectors, "doc_id", "left_anti").select("doc_id")


def not_rejected(spark, sf_dir):
    rejected = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(rejected, "doc_id", "left_anti").where(~F.col("lang").eqNullSafe("fr")).select("doc_id", "lang")


def ir_metrics(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("qid"), "n_chars"), table(spark, sf_dir, "labels")
    run = ranked.ranked(docs, Scratch(spark, "run"), "places", ["qid"], [F.desc("n_chars"), F.col("doc_id")], "place").select("qid", "doc_id", "place")
    qrels = docs.join(labels, "doc_id").select("qid", "doc_id", (2 * F.col("quality") + F.col("toxic")).cast("int").alias("grade"))
    return metrics.ir_metrics(run, qrels)


def set_f1(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").withColumn("t", search.tokens(F.col("text")))
    by = lambda who: said.where(F.col("role") == who).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias(who))
    return metrics.set_f1(by("assistant").join(by("user"), "conv_id").select(F.col("assistant").alias("found"), F.col("user").alias("truth")))


QUERIES = {
    f.__name__: f
    for f in (hybrid_search, lexical_topk, vector_topk, rrf_fuse, list_page, filter_null_semantics, facet_stats, facet_relax, top_cities, not_embedded, not_rejected, ir_metrics, set_f1)
}

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_LISTS = rf"""
q AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
sized AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
hits AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
           FROM hits JOIN df USING (term) JOIN sized USING (doc_id), totals GROUP BY doc_id),
lexical AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0 QUALIFY place <= 200),
v AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
cosines AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], v.e), 6) AS score FROM embeddings, v),
vector AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM cosines QUALIFY place <= 200),
fused AS (SELECT doc_id, round(coalesce(1.0 / (60 + v.place), 0) + coalesce(1.0 / (60 + l.place), 0), 9) AS rrf, v.place AS v_place, l.place AS l_place, v.score AS cosine
          FROM vector v FULL JOIN lexical l USING (doc_id))
"""
_C = "c AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _facets(source: str, lang: str, quality: str, size: str) -> str:
    names = ("source", "lang", "quality", "size")
    holds = dict(zip(names, (f"coalesce({x}, false)" for x in (source, lang, quality, size)), strict=True))
    without = [" AND ".join(v for k, v in holds.items() if k != n) for n in names]
    counts = ", ".join(f"count(*) FILTER ({w}) AS w{k}" for k, w in enumerate(without))
    rows = " UNION ALL ".join(f"SELECT {k} AS p, '{n}' AS facet, w{k} AS without, total FROM s" for k, n in enumerate(names))
    return f"""WITH {_C}, s AS (SELECT count(*) FILTER ({' AND '.join(holds.values())}) AS total, {counts} FROM c), r AS ({rows})
SELECT facet, without, without - total AS removed, total = 0 AND row_number() OVER (ORDER BY without DESC, p) = 1 AS relax FROM r"""


ORACLES = {
    "lexical_topk": f"WITH {_LISTS} SELECT * FROM lexical",
    "vector_topk": f"WITH {_LISTS} SELECT *, CASE WHEN score >= 0.40 THEN 'close' WHEN score >= 0.25 THEN 'near' ELSE 'far' END AS closeness FROM vector",
    "rrf_fuse": f"WITH {_LISTS} SELECT doc_id, rrf, row_number() OVER (ORDER BY rrf DESC, v_place NULLS LAST, l_place NULLS LAST) AS place FROM fused",
    "hybrid_search": f"""WITH {_LISTS} SELECT doc_id, lang, source, n_chars, rrf, row_number() OVER (ORDER BY rrf DESC, v_place NULLS LAST, l_place NULLS LAST) AS place
FROM fused JOIN documents USING (doc_id) WHERE lang = 'en' AND (l_place IS NOT NULL OR cosine >= 0.25) QUALIFY place <= 20""",
    "list_page": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20",
    "filter_null_semantics": f"WITH {_C} SELECT doc_id, quality, toxic FROM c WHERE lang = 'en' AND quality >= 1 AND (toxic IS NULL OR toxic <= 0)",
    "facet_stats": _facets("source = 'src1'", "lang = 'en'", "quality >= 1", "toxic IS NULL OR toxic <= 0"),
    "facet_relax": _facets("source = 'src1'", "lang = 'xx'", "quality >= 1", "n_chars < 0"),
    "top_cities": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 60",
    "not_embedded": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "not_rejected": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang IS DISTINCT FROM 'fr'",
    "ir_metrics": """WITH d AS (SELECT doc_id, source AS qid, n_chars FROM documents),
run AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, doc_id) AS place FROM d),
qrels AS (SELECT qid, doc_id, 2 * quality + toxic AS grade FROM d JOIN labels USING (doc_id)),
judged AS (SELECT qid, place, coalesce(grade, 0) AS grade FROM run LEFT JOIN qrels USING (qid, doc_id)),
got AS (SELECT qid, count(*) FILTER (grade >= 2 AND place <= 40) AS hits, sum(CASE WHEN place <= 10 THEN (pow(2.0, grade) - 1) / log2(place + 1) ELSE 0 END) AS dcg FROM judged GROUP BY qid),
ideal AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS p FROM qrels),
best AS (SELECT qid, count(*) FILTER (grade >= 2) AS rel, sum(CASE WHEN p <= 10 THEN (pow(2.0, grade) - 1) / log2(p + 1) ELSE 0 END) AS idcg FROM ideal GROUP BY qid)
SELECT qid, round(hits / nullif(rel, 0), 6) AS recall, round(dcg / nullif(idcg, 0), 6) AS ndcg FROM best JOIN got USING (qid)""",
    "set_f1": rf"""WITH t AS (SELECT DISTINCT conv_id, role, unnest({_TOKENS}) AS term FROM conversations),
ids AS (SELECT conv_id FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, term FROM t JOIN ids USING (conv_id) WHERE role = 'user'), a AS (SELECT conv_id, term FROM t JOIN ids USING (conv_id) WHERE role = 'assistant'),
s AS (SELECT count(*) FILTER (a.term IS NOT NULL AND u.term IS NOT NULL) AS tp, count(*) FILTER (u.term IS NULL) AS fp, count(*) FILTER (a.term IS NULL) AS fn FROM a FULL JOIN u USING (conv_id, term))
SELECT tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""",
}
