"""Russian word forms as native column expressions: the cases of a name, and whether two words are forms of one.

A paradigm is how a word ends by itself, how many letters of that go, and the endings that take their place; words of more than one paradigm have the forms of
all. Vowels that come and go in a last syllable (Лев, Льва; Павел, Павла) are a paradigm of their own. Letters are lower case, ё is е.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound

_C = "бвгджзклмнпрстфхцчшщ"
#: Paradigms of names: ending by itself, letters that go, endings.
NAMES = (
    (f"[{_C}]$", 0, "а у ом ем е ым ы ых ыми ам ами ах"),
    ("й$", 1, "я ю ем е и"),
    ("ь$", 1, "я ю ем е и ью"),
    ("а$", 1, "ы и е у ой ою ей"),
    ("я$", 1, "и е ю ей ею"),
    ("(?:ий|ый|ой)$", 2, "ого его ому ему им ым ом ем ие ые их ых ими ыми"),
    ("(?:ая|яя)$", 2, "ой ей ую юю ою ею"),
)
#: A vowel in front of a last consonant that other cases don't have.
FLEETING = f"^(.*[{_C}])[ео]([{_C}])$"
#: Endings of nouns with hard and soft stems, of adjectives and of verbs.
CLASSES = {
    "hard": "|а|ы|и|о|е|у|ой|ою|ом|ем|ей|ов|ам|ами|ах",
    "soft": "ь|й|я|и|е|ю|ей|ею|ем|ев|ям|ями|ях|ью",
    "adjective": "ый|ий|ой|ая|яя|ое|ее|ые|ие|ого|его|ому|ему|ым|им|ом|ем|ую|юю|ою|ей|ых|их|ыми|ими",
    "verb": "ть|л|ла|ло|ли|ет|ут|ют|ешь|ем|ете|у|ю|й|йте|в|вший|вшая|вшие|ющий|ющая|ющие",
}
LEAST_STEM = 3


def plain(word: Column) -> Column:
    return F.translate(F.lower(word), "ё", "е")


def _with(stem: Column, endings: str) -> Column:
    return F.transform(F.array(*map(F.lit, endings.split())), lambda e: F.concat(stem, e))


def name_forms(word: Column) -> Column:
    """All cases of a name's word, itself first; words of other letters have no other forms."""

    def of(w: Column) -> Column:
        none = F.array().cast("array<string>")
        found = [F.when(w.rlike(ends), _with(F.substring(w, F.lit(1), F.length(w) - cut), endings)).otherwise(none) for ends, cut, endings in NAMES]
        bare = F.regexp_replace(w, FLEETING, "$1$2")
        soft = F.regexp_replace(w, FLEETING, "$1ь$2")
        found += [F.when((F.length(w) > 2) & w.rlike(FLEETING), F.concat(_with(s, "а у ом ем е"))).otherwise(none) for s in (bare, soft)]
        return F.array_distinct(F.concat(F.array(w), *found))

    return bound(plain(word), of)


def _stems(word: Column, kind: str) -> Column:
    """The stems that a word can have in a class, marked with it."""
    ends = F.array(*map(F.lit, CLASSES[kind].split("|")))
    fits = F.filter(ends, lambda e: word.endswith(e) & (F.length(word) - F.length(e) >= LEAST_STEM))
    return F.transform(fits, lambda e: F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(e)), F.lit(f"|{kind}")))


def word_keys(word: Column) -> Column:
    """What the forms of one word share: its stem in each class of which it has an ending."""
    return bound(plain(word), lambda w: F.concat(F.array(w), *(_stems(w, kind) for kind in CLASSES)))


def same_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(word_keys(a), word_keys(b))
