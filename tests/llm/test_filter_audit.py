import re
from itertools import permutations

import pytest

from rosterlake.llm import filter_audit as op


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in range(2))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        judged.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {x[0] for x in judged}:
        for order in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                unique = sum(x[1] == {f} for x in judged if x[0] == part)
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in x[1] for x in gone), unique, sum(x[2] for x in removed), sum(x[3] for x in removed)]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                gone += removed
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.fixture(scope="module")
def labels():
    return [(k, k % 2, k % 3 == 0) for k in range(1, 140, 3)] + [(None, 1, 1), (10, None, None), (10, 0, 1), (11, 1, 0), (11, 1, 1)]


def test_against_brute_force(spark, odd_rows, labels):
    many = " ".join(f"w{k}" for k in range(230))
    more = [(300, f"{many} %"), (301, many.upper()), (302, many), (303, many), (302, many), (304, f" {many}\x0b\x1f\t"), (None, many), (305, "é " * 250)]
    docs = [(i, t, [None, "", "en", "de"][k % 4]) for k, (i, t, *_) in enumerate([*odd_rows, *((i, t) for i, t in more)])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, failed int").repartition(4)
    marks = spark.createDataFrame([(i, q, int(t) if t is not None else None, "y") for i, q, t in labels], "doc_id long, quality int, toxic int, digest string")
    found = op.audit(op.failures(df, marks))
    assert sorted(map(tuple, found.collect())) == brute(docs, labels)
    assert [f.dataType.simpleString() for f in found.schema][:4] == ["string", "string", "int", "bigint"]


def test_no_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.audit(op.failures(odd.limit(0), none)).count() == 0
    assert op.audit(op.failures(odd, none)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0
