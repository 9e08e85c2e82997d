"""Hierarchies deeper than any fixed number of levels, with a cycle at the end."""

from locuskit.operators import components


def test_deep_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("n20", "n05"), ("x", "n03"), ("y", "z")], "parent string, child string")
    roots = spark.createDataFrame([("n01",)], "node string")
    got = sorted(r.node for r in components.descendants(edges, roots).collect())
    assert got == [f"n{i:02}" for i in range(1, 21)]
