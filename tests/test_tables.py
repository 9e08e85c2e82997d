"""Steps over keyed tables against plain loops."""

import random

from pyspark.sql import functions as F

from locuskit.operators import tables
from tests.test_operators import rows


def test_first_and_top(spark):
    r = random.Random(1)
    given = [(r.choice(["a", "b", None]), r.randint(0, 5), i) for i in range(80)]
    df = rows(spark, given, "k string, v int, i int")
    want = {k: min((-v, i) for q, v, i in given if q == k) for k in ("a", "b", None)}
    assert {x.k: (-x.v, x.i) for x in tables.first_of_key(df, ["k"], -F.col("v"), F.col("i")).collect()} == want
    top = tables.top_of_key(df, ["k"], 3, "n", F.desc("v"), F.col("i")).collect()
    assert {(x.k, x.n, x.i) for x in top} == {(k, n, i) for k in want for n, (_, i) in enumerate(sorted((-v, i) for q, v, i in given if q == k)[:3], 1)}


def test_upsert_and_preference(spark):
    old, new = rows(spark, [("a", 1), ("b", 2), (None, 3)], "k string, v int"), rows(spark, [("b", 5), (None, 6), ("c", 7)], "k string, v int")
    assert {tuple(x) for x in tables.upserted(old, new, ["k"]).collect()} == {("a", 1), ("b", 5), (None, 6), ("c", 7)}
    third = rows(spark, [("a", None, 9), ("d", 8, None)], "k string, v int, w int")
    assert {tuple(x) for x in tables.preferred([third, old.filter("k is not null"), new.filter("k is not null")], "k").collect()} == {("a", 1, 9), ("b", 2, None), ("c", 7, None), ("d", 8, None)}


def test_states_and_names(spark):
    df = rows(spark, [("a", "x", 1), ("a", "y", 1), ("b", "z", 2), ("b", "odd", 3), ("c", None, None)], "k string, s string, n int")
    assert {tuple(x) for x in tables.best_state(df, ["k"], "s", ("z", "y", "x"), "s1").collect()} == {("a", "y"), ("b", "z"), ("c", None)}
    assert {tuple(x) for x in tables.differing(df, ["k"], {"d": "n"}).collect()} == {("a", False), ("b", True), ("c", False)}
    assert {tuple(x) for x in tables.agreement(df, ["k"], "s", ["x", "z"], "n").collect()} == {("a", 1, 0, 1), ("b", 0, 1, 2), ("c", 0, 0, 0)}
    assert {(x.k, tuple(x.names), x.retired) for x in tables.name_mapping(df, ["k"], "s", F.coalesce(F.col("n") == 1, F.lit(False))).collect()} == {("a", ("x", "y"), 2), ("b", ("odd", "z"), 0), ("c", (), 0)}
    assert [x.r for x in df.select(tables.rank_in(F.col("s"), ("y", "x")).alias("r"), "k", "s").orderBy("k", "s").collect()] == [2, 1, 3, 3, 3]
    errors = df.select("s", tables.broken_rules((F.col("n") > 1, "big"), (F.col("s") == "z", "zed")).alias("e"))
    assert {x.s: x.e for x in errors.collect()} == {"x": "", "y": "", "z": "big;zed", "odd": "big", None: ""}


def test_parents_and_removed_names(spark):
    children, parents = rows(spark, [(1, "p", 1), (2, "p", 0), (3, "q", 1), (4, None, 1)], "i int, p string, s int"), rows(spark, [("p", 1), ("r", 0)], "p string, s int")
    assert {(x.i, x.status) for x in tables.parent_status(children, parents, "p", F.col("s") != F.col("s_p")).collect()} == {(1, "ok"), (2, "other_strand"), (3, "missing_parent"), (4, "missing_parent")}
    df = rows(spark, [("g", ["a"]), ("g", ["b", "x"]), ("h", ["c"]), ("i", [])], "k string, names array<string>")
    gone = rows(spark, [("x",), ("x",), ("y",)], "name string")
    assert sorted(x.k for x in tables.without_named(df, ["k"], F.col("names"), gone, "name").collect()) == ["h", "i"]
    models = rows(spark, [("g", "t2", 5, 9), ("g", "t1", 5, 12), ("g", "t3", 1, 2)], "gene_id string, tx_id string, start int, `end` int")
    (s,) = tables.spans(models).collect()
    assert (s.start, s.end, s.models, s.ids) == (1, 12, 3, ["t3", "t1", "t2"])
