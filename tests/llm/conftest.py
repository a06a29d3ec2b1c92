import random

import pytest

WORDS = ["the", "of", "a", "rain", "falls", "on", "plain", "in", "old", "stone", "house", "über", "漢字", "x", "naïve", "river,", "end."]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empties, ties, copies, near copies, shared passages and a very long text."""
    rng = random.Random(5)
    passage, base = sentence(rng, 70), sentence(rng, 200)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "no id here " * 30), (5, "a " * 400), (6, "b a " * 200)]
    rows += [(10 + k, f"{sentence(rng, 20 + k)} {passage} {sentence(rng, 30)}") for k in range(12)]
    rows += [(40 + k, base) for k in range(6)] + [(41, base)]
    near = base.split()
    for k in range(8):
        changed = list(near)
        changed[rng.randrange(200)] = "changed"
        rows.append((60 + k, " ".join(changed)))
    rows += [(80, "long " + sentence(rng, 30000)), (81, "line one here\nline two\nline one here\n" * 20), (82, "### $$$ *** %%% &&& " * 30)]
    rows += [(100 + k, sentence(rng, 150)) for k in range(40)]
    rows += [(200, passage), (201, " ".join(passage.split()[:49])), (202, " ".join(passage.split()[5:55]))]
    return [(i, t, "en", None if i and i % 7 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
