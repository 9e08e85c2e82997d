"""Expressions over values of any length, against plain loops."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from locuskit.functions import sequence, text

def test_inner_stop_anywhere(spark):
    """Far stops, stops out of frame and at the end, against a plain loop."""
    texts = ["ATG" + "GCA" * n + tail for n in (0, 1, 99, 100, 5000) for tail in ("", "TAA", "TAAGCA", "TAAGC", "CTAAGCAGCA")] + ["", "TA", "TAA", None]
    plain = lambda s: any(s[i : i + 3] in sequence.STOPS for i in range(0, 3 * (len(s) // 3 - 1), 3))
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(sequence.has_inner_stop(F.col("s"))).collect()] == [plain(t or "") for t in texts]


def plain_letters(n):
    out = ""
    while n > 0:
        n, at = divmod(n - 1, 26)
        out = chr(65 + at) + out
    return out or "A"


def test_letters_of_any_length(spark):
    n = [-1, 0, 1, 26, 27, 52, 53, 676, 677, 702, 703, 728, 729, 18278, 18279, 475254, 475255, 2**31, 2**53 + 1, 2**63 - 1]
    got = spark.createDataFrame([(x,) for x in [*n, None]], "n long").select("n", text.letters(F.col("n")).alias("a"), text.letters(F.col("n").try_cast("int")).alias("b")).collect()
    assert [r.a for r in got] == [*map(plain_letters, n), None]
    assert [r.b for r in got] == [plain_letters(x) if x < 2**31 else None for x in n] + [None]


def test_aliases_of_all_parts(spark):
    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in entry.queries()["p19_aliases"](spark, sf).select("p_partkey", "alias", "set_alias").collect()]
    keys = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    assert max(keys) > 702
    assert sorted(got) == sorted((k, plain_letters(k), f"S{k % 100:02}") for k in keys)
