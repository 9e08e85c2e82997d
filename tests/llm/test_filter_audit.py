"""The audit of interacting filters against plain loops over documents and orders."""

import random
import re
from itertools import permutations

from locuskit.llm import filter_audit as audit


def plain(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    judged = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and t in first and i > first[t],
        }
        judged.append((part or "", {k for k in fails if fails[k]}, i in good, i in toxic))
    out = set()
    for part in {p for p, *_ in judged}:
        rows, own, shapley = [j for j in judged if j[0] == part], {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [j for j in left if k in j[1]]
                left = [j for j in left if k not in j[1]]
                shapley[k] += len(gone)
                redundant = sum(k in j[1] for j in rows) - len(gone)
                own["".join(order), step] = (len(left), len(gone), redundant, sum(j[1] == {k} for j in rows), sum(j[2] for j in gone), sum(j[3] for j in gone))
        out |= {(part, order, step, *x, shapley[order[step - 1]]) for (order, step), x in own.items()}
    return out


def texts(r):
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    long = lambda pool, n: " ".join(r.choices(pool, k=n))
    return [None, "", " \t\n", "short", long(words, 99), long(words, 100), long(words[:80], 100), long(words[:3], 300), long(words, 150).upper(), long(words, 120) + " 5% off", "É" * 300, "\x0b".join(words[:120]), "a b " * 20_000, "A" + "a" * 9, "A" + "a" * 8]


def test_report(spark):
    r = random.Random(3)
    pool = texts(r)
    docs = [(r.choice([None, *range(90)]), r.choice(pool), r.choice(["en", "de", "", None])) for _ in range(300)] + [(7, pool[3], "en")] * 5
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x", [0], False) for d in docs], "doc_id long, text string, lang string, mask int, part string, words array<int>, first boolean")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, id string")
    got = audit.audit(df, marks).collect()
    assert len(got) == 600 * 3 and {tuple(x) for x in got} == plain(docs, labels)
    assert [f.simpleString() for f in audit.audit(df, marks).schema][2:4] == ["step:int", "kept:bigint"]


def test_odd_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(none, marks).collect() == []
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    got = audit.audit(one, marks).collect()
    assert {tuple(x) for x in got} == plain([(None, None, None)], [])
