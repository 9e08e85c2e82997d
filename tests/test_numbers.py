"""Rounding against Python's own, which goes by the binary value."""

import random

from pyspark.sql import functions as F

from locuskit.functions import numbers


def test_texts_and_rounded_numbers(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 2.675, 0.5, 1.5, 2.5, 0.125, 0.375, 0.03125, 0.00625, 1 / 3, 99.995, 0.99995, 1e-9, 5e-5, 123456789.123456, -2.675, -0.125, 999999999999.5, 1.0, 2.0**40, None, float("inf"), float("nan")]
    values += [rnd.randrange(1, 4000) / rnd.choice([16, 32, 64, 160, 1000, 3, 7, 20000]) for _ in range(4000)] + [round(rnd.uniform(0, 1000), 3) for _ in range(2000)] + [rnd.uniform(-1, 1) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4, 6):
        got = df.select("x", numbers.fixed_text(F.col("x"), digits).alias("t"), numbers.rounded(F.col("x"), digits).alias("r")).collect()
        for r in got:
            if r.x is None or r.x - r.x != 0:
                assert r.t is None and r.r is None
                continue
            want = f"{r.x:.{digits}f}"
            assert (r.t == want or (r.x == 0 and r.t == want.lstrip("-"))) and r.r == float(want), (r.x, r.t, want)


def test_a_number_is_worked_out_once(spark):
    """Written in place, each step repeats the one before it, which made the text thousands of nodes large."""
    plan = spark.range(3).select((F.col("id") / 3).alias("x")).filter("x > 0").select(numbers.fixed_text(F.col("x"), 4))
    text = plan._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert text.count("LOG2") <= 2 and len(text) < 10000
