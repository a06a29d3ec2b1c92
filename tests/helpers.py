"""Couples of names, judged by Spark at once."""

from pyspark.sql import functions as F

from rosterlake.functions import names


def compatible(spark, *people):
    """A function that says whether two of the names are compatible; a missing one is with all."""
    rows = spark.createDataFrame([(n, m) for n in {*people} for m in {*people}], "n string, m string")
    held = {(r.n, r.m): r.fits for r in rows.select("n", "m", names.names_compatible(F.col("n"), F.col("m")).alias("fits")).collect()}
    return lambda a, b: a is None or b is None or held[a, b]
