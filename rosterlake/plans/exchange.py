"""Queries that write workbooks from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.stored import Scratch
from ..sources import xlsx
from .evaluation import _CHECKED, _checked
from .retrieval import table


def xlsx_customers(spark, sf_dir):
    """The customers of each nation as a workbook, all of them read as one table by column names."""
    folder = Scratch(spark, "books").path("customers")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    wide = {"c_custkey": 10, "c_name": 24, "c_nationkey": 10, "c_acctbal": 12, "c_mktsegment": 14}
    xlsx.write_books(people, folder, "c_nationkey", [F.col("c_custkey")], wide).agg(F.sum("n_rows")).first()
    xlsx.register(spark)
    read = spark.read.format("xlsx").load(folder)
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    return read.select(number("c_custkey", "long"), number("c_nationkey", "int"), "c_name", number("c_acctbal", "double"), "c_mktsegment")


def shortlist_books(spark, sf_dir):
    """Shortlists: who fits and isn't rejected, a workbook a source with a head and one row a person, stale ones last; read back with their rows' numbers."""
    folder = Scratch(spark, "books").path("shortlists")
    rows = _checked(spark, sf_dir).where("category = 'fit'").select(
        "source", F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise("-"), F.col("doc_id")).alias("name"), "score", "category",
        (F.col("doc_id") % 5 == 0).alias("stale"), F.when(F.col("doc_id") % 7 == 0, "reject").when(F.col("doc_id") % 3 == 0, "invite").alias("decision"),
        F.when(F.col("doc_id") % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))).alias("resume_date"),
    )
    chosen = evaluate.shortlisted(rows, "fit")
    wide = {"id": 10, "name": 24, "score": 8, "resume_date": 12}
    written = xlsx.write_books(chosen, folder, "source", evaluate.in_shortlist_order(), wide, "Shortlist", lambda key: (key or "", "as of 2024-06-01"))
    written.agg(F.sum("n_rows")).first()
    cells = xlsx.read_books(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder))
    # three lines of head, of which one is empty, and the row of names come first
    heads = cells.where("number = 1").select(F.col("source").alias("book"), F.col("cells")[0].alias("source"))
    rows = cells.where("number > 4").select(F.col("source").alias("book"), "number", "cells")
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return rows.join(heads, "book").select(
        "source", (F.col("number") - 4).alias("place"), cell(1).cast("long").alias("id"), cell(2).alias("name"), cell(3).cast("int").alias("score"), F.try_element_at("cells", F.lit(4)).alias("resume_date")
    )


QUERIES = {f.__name__: f for f in (xlsx_customers, shortlist_books)}

ORACLES = {
    "xlsx_customers": "SELECT c_custkey, c_nationkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "shortlist_books": f"""WITH {_CHECKED}
SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id % 5 = 0, score DESC, doc_id) AS place, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '=' ELSE '-' END || doc_id AS name, score,
  CASE WHEN doc_id % 2 = 0 THEN (DATE '2024-01-01' + (doc_id % 500)::INT)::VARCHAR END AS resume_date
FROM c WHERE category = 'fit' AND doc_id % 7 <> 0""",
}
