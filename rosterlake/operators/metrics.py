"""Retrieval and extraction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import ranked
from .stored import Scratch


def once_a_person(run: DataFrame, person: str = "person") -> DataFrame:
    """``run(qid, doc_id, place, person)`` with each person's first place only, places counted anew."""
    firsts = run.groupBy("qid", person).agg(F.min_by("doc_id", "place").alias("doc_id"), F.min("place").alias("was"))
    return ranked(firsts, Scratch(run.sparkSession, "persons"), "firsts", ["qid"], [F.col("was")], "place").select("qid", "doc_id", "place")


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 40, relevant: int = 2, gain_at: int = 10) -> DataFrame:
    """``qid, recall, ndcg``: ``run(qid, doc_id, place)`` against ``qrels(qid, doc_id, grade)``; gain ``2**grade - 1``."""
    judged = run.join(qrels, ["qid", "doc_id"], "left").fillna({"grade": 0})
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)
    got = judged.groupBy("qid").agg(
        F.count_if((F.col("grade") >= relevant) & (F.col("place") <= k)).alias("hits"), F.sum(F.when(F.col("place") <= gain_at, gain("place")).otherwise(0.0)).alias("dcg")
    )
    ideal = ranked(qrels, Scratch(run.sparkSession, "qrels"), "ideal", ["qid"], [F.desc("grade"), F.col("doc_id")], "ideal")
    best = ideal.groupBy("qid").agg(F.count_if(F.col("grade") >= relevant).alias("relevant"), F.sum(F.when(F.col("ideal") <= gain_at, gain("ideal")).otherwise(0.0)).alias("idcg"))
    rows = best.join(got, "qid", "left").fillna({"hits": 0, "dcg": 0.0})
    return rows.select("qid", F.round(F.col("hits") / F.when(F.col("relevant") > 0, F.col("relevant")), 6).alias("recall"), F.round(F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg")), 6).alias("ndcg"))


def set_f1(pairs: DataFrame) -> DataFrame:
    """One row ``tp, fp, fn, f1`` over all of ``pairs(found, truth)``, arrays as sets."""
    tp, fp, fn = F.size(F.array_intersect("found", "truth")), F.size(F.array_except("found", "truth")), F.size(F.array_except("truth", "found"))
    sums = pairs.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    return sums.withColumn("f1", F.round(2 * F.col("tp") / F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def graded(people: DataFrame, rules: DataFrame) -> DataFrame:
    """``qid, id, grade`` of ``people(id, profession, title, text)`` by ``rules(qid, profession, best, good, needed, needed_from)``: 0 in another profession, 3 and 2 for
    the titles listed, else 1; a grade of ``needed_from`` or more falls to 1 without one of the words ``needed`` (null: none) in the text."""
    both = people.join(rules, "profession")
    level = F.when(F.array_contains("best", F.col("title")), 3).when(F.array_contains("good", F.col("title")), 2).otherwise(1)
    said = F.exists("needed", lambda w: F.contains(F.lower("text"), w))
    grade = F.when(F.col("needed").isNotNull() & (level >= F.col("needed_from")) & ~F.coalesce(said, F.lit(False)), 1).otherwise(level)
    return both.select("qid", "id", grade.alias("grade"))
