"""Names of other people in texts, found by the base's own names.

The base gives a dictionary of all forms of its surnames, first names and patronymics; capitalised words of the texts are joined with it by
their lower-case form, so the dictionary is dealt over the cluster like the words and neither is whole anywhere. A word alone may be
an ordinary one: a person is two names side by side, or one beside an initial. What is masked never crosses a line, so lines keep their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, names
from ..functions.bind import bound

PLACEHOLDER = "[NAME]"
_RUNS = r"\p{L}+|[^\p{L}]+"


def dictionary(people: DataFrame, name: str = "full_name") -> DataFrame:
    """``form, kinds``: each form of a name's words of three letters or more, and which parts of a name it can be (surname, first, middle)."""
    words = F.posexplode(F.split(F.regexp_replace(forms.plain(F.col(name)), r"[^\p{L} ]", " "), " +")).alias("at", "word")
    parts = people.select(words).where("length(word) >= 3").distinct()
    middle = F.col("word").rlike("(?:" + "|".join(names.PATRONYMIC_ENDINGS) + ")$")
    kind = F.when(middle | (F.col("at") > 1), "middle").when(F.col("at") == 0, "last").otherwise("first")
    each = parts.select(kind.alias("kind"), "word").distinct().select("kind", F.explode(forms.name_forms(F.col("word"))).alias("form"))
    return each.groupBy("form").agg(F.collect_set("kind").alias("kinds"))


def _runs(line: Column) -> Column:
    """A line as runs of letters and of others, which together are the line."""
    return F.regexp_extract_all(line, F.lit(_RUNS), F.lit(0))


def mentions(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``doc_id, line, run, kinds`` of the words of ``docs(doc_id, text)`` that are forms of a name."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).where(F.col("body").rlike(r"\p{Lu}\p{L}{2}"))
    runs = lines.select("doc_id", "line", F.posexplode(_runs(F.col("body"))).alias("run", "word"))
    capital = runs.where(F.col("word").rlike(r"^\p{Lu}\p{L}{2}")).withColumn("form", forms.plain(F.col("word")))
    return capital.join(held.hint("merge"), "form").select("doc_id", "line", "run", "kinds")


def _masked(runs: Column, found: Column, line: Column) -> Column:
    """The line with its people masked; ``found`` maps ``line << 32 | run`` to kinds."""
    kinds = lambda k: F.try_element_at(found, F.shiftleft(line.cast("long"), 32).bitwiseOR(k.cast("long")))
    initial = lambda k, dot: F.coalesce(F.get(runs, k).rlike(r"^\p{Lu}$") & F.get(runs, dot).startswith("."), F.lit(False))

    def masked(k: Column) -> Column:
        own = kinds(k)
        pair = lambda other, gap: F.coalesce((F.get(runs, gap) == " ") & (F.size(F.array_distinct(F.concat(own, kinds(other)))) > 1), F.lit(False))
        beside = pair(k - 2, k - 1) | pair(k + 2, k + 1)
        lettered = initial(k - 2, k - 1) | (F.coalesce(F.get(runs, k + 1) == " ", F.lit(False)) & initial(k + 2, k + 3))
        return own.isNotNull() & (beside | lettered)

    # [NAME] takes in the words beside each other that are names, and initials before and after them
    joined = F.array_join(F.transform(runs, lambda w, k: F.when(masked(k), PLACEHOLDER).otherwise(w)), "")
    sign = PLACEHOLDER.replace("[", r"\[").replace("]", r"\]")
    for pattern in (rf"{sign}(?: {sign})+", rf"{sign} \p{{Lu}}\.(?: ?\p{{Lu}}\.)?", rf"(?:(?<!\p{{L}})\p{{Lu}}\.[ ]?){{1,2}}{sign}"):
        joined = F.regexp_replace(joined, pattern, sign)
    return joined


def mask_people(docs: DataFrame, people: DataFrame, name: str = "full_name") -> DataFrame:
    """``docs(doc_id, text, ..)``, doc_ids unique, with the names of all people of the base masked in the text."""
    found = mentions(docs, dictionary(people, name))
    key = F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("run").cast("long"))
    marks = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct(key, "kinds"))).alias("_found"))
    line = lambda x, k: bound(_runs(x), lambda runs: _masked(runs, F.col("_found"), k))
    told = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    rows = docs.join(marks, "doc_id", "left").withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(told))
    return rows.select(*docs.columns)
