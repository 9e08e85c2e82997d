"""Rounding of binary numbers by their exact value, ties to even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is worked out once, however often `f` names it; written in place it would be repeated each time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _units(x: Column, digits: int) -> Column:
    """|x| in units of the last digit, rounded: a decimal without fraction.

    Spark rounds the shortest decimal text of a double, so 2.675 would be a tie; its binary value lies below one. Here |x| is
    written as m / 2**q with whole m, without loss, and the rest of m * 10**digits / 2**q is compared with a half.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    scaled = F.struct(F.abs(x).alias("a"), F.greatest(F.lit(53) - F.floor(F.log2(F.abs(x))), F.lit(0)).cast("int").alias("q"))

    def ratio(s: Column) -> Column:
        m, half = whole((s["a"] * F.pow(F.lit(2.0), s["q"])).cast("long")), F.floor(s["q"] / 2).cast("int")
        return F.struct(whole(m * F.lit(10**digits).cast("decimal(19,0)")).alias("n"), whole(whole(power(half)) * whole(power(s["q"] - half))).alias("d"))

    divided = lambda s: F.struct(s["n"].alias("n"), s["d"].alias("d"), whole(s["n"] % s["d"]).alias("rest"))
    parts = lambda s: F.struct(whole((s["n"] - s["rest"]) / s["d"]).alias("k"), (s["rest"] * 2 - s["d"]).alias("over"))
    nearest = lambda s: whole(F.when((s["over"] > 0) | ((s["over"] == 0) & (s["k"] % 2 == 1)), s["k"] + 1).otherwise(s["k"]))
    return _once(_once(_once(_once(scaled, ratio), divided), parts), nearest)


def fixed_text(x: Column, digits: int) -> Column:
    """A double with so many digits behind the point, rounded by its exact value; null for null and for what isn't finite. For
    numbers below 10**12 and at most six digits, beyond which the comparison wouldn't be exact."""

    def shown(v: Column) -> Column:
        padded = lambda k: F.lpad(k, F.greatest(F.length(k), F.lit(digits + 1)), F.lit("0"))
        pointed = lambda t: F.concat(F.left(t, F.length(t) - digits), F.lit("."), F.right(t, F.lit(digits))) if digits else t
        # A product is off by less than 2**-13 below 2**40: farther from a half it rounds as the exact value does.
        clear = lambda t: (t < 2.0**40) & (F.abs(t - F.floor(t) - 0.5) > 2.0**-12)
        units = _once(F.abs(v) * float(10**digits), lambda t: F.when(clear(t), F.floor(t + 0.5).cast("string")).otherwise(_units(v, digits).cast("string")))
        text = _once(_once(units, padded), pointed)
        return F.when(F.abs(v) < F.lit(float("inf")), F.concat(F.when(v < 0, "-").otherwise(""), text))

    return _once(x.cast("double"), shown)


def rounded(x: Column, digits: int) -> Column:
    """The double nearest to `fixed_text`."""
    return fixed_text(x, digits).cast("double")
