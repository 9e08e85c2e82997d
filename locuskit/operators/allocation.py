"""Allocation of gene identifiers: in gaps between current numbers, in learnt styles, and in a new name space.

Nothing holds the numbers of a name space together. Taken numbers are runs of neighbours; a gap between two current genes gets
the runs near its targets only, and asks for more if it has to look further. Gaps propose numbers side by side; where two meet,
the earlier one (by sequence and place) has its number, and the other proposes anew in the next round. Numbers in a row are
dealt by rank: the k-th free number is k plus the taken ones below it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.operators import islands
from locuskit.operators.range_join import overlap_join
from locuskit.session import removed, written

#: Least share of rising neighbours for numbers to follow places, widest gap of numbers, step without neighbours,
#: what is added to a taken number behind the last gene; least share and number of genes for a style to be used; and the
#: multiples that are preferred, in this order.
RISING, WIDEST, STEP, SKIP, DOMINANT, SEVERAL = 0.98, 1_000_000, 100, 10, 0.80, 10
ROUND = (10, 5, 1)
#: How far around a target a gap knows the taken numbers at first, and by how much that grows when it must look further.
REACH, FURTHER = 64, 8


class Unknown(Exception):
    """A number outside the windows in which taken numbers are known."""


class Taken:
    """Taken numbers, as runs (first, last) of neighbouring multiples of each of ROUND; known in windows (first, last), or
    everywhere. `own` are numbers taken meanwhile. The number next to a run is free, wherever the windows end."""

    def __init__(self, runs: dict[int, list[tuple[int, int]]], windows: list[tuple[int, int]] | None = None):
        self.first = {m: [a for a, _ in runs.get(m, ())] for m in ROUND}
        self.last = {m: [b for _, b in runs.get(m, ())] for m in ROUND}
        self.windows, self.own = windows, set()

    @classmethod
    def of(cls, numbers: set[int]) -> Taken:
        runs: dict[int, list[tuple[int, int]]] = {}
        for m in ROUND:
            for n in sorted(x for x in numbers if x % m == 0):
                own = runs.setdefault(m, [])
                if own and own[-1][1] == n - m:
                    own[-1] = (own[-1][0], n)
                else:
                    own.append((n, n))
        return cls(runs)

    def _known(self, n: int) -> None:
        if self.windows is not None and not any(a <= n <= b for a, b in self.windows):
            raise Unknown

    def run(self, n: int, m: int) -> tuple[int, int] | None:
        i = bisect_right(self.first[m], n) - 1
        return (self.first[m][i], self.last[m][i]) if i >= 0 and self.last[m][i] >= n else None

    def __contains__(self, n: int) -> bool:
        if n in self.own or self.run(n, 1):
            return True
        self._known(n)
        return False

    def free(self, n: int, m: int, up: bool, end: int) -> int | None:
        """The first free multiple of m from n on, up or down, before `end`."""
        beside = False
        while (n < end) if up else (n > end):
            if run := self.run(n, m):
                n, beside = (run[1] + m if up else run[0] - m), True
                continue
            if not beside:
                self._known(n)
            if n not in self.own:
                return n
            n, beside = n + (m if up else -m), False
        return None


def nearest_free(target: float, low: int, high: int, taken: Taken | set[int]) -> int | None:
    """The free number between low and high (both excluded) nearest to a place: a multiple of 10 if any is free, else of 5, else
    any; of two as near the smaller."""
    taken = taken if isinstance(taken, Taken) else Taken.of(taken)
    for m in ROUND:
        down = int(target // m) * m
        free = [n for n in (taken.free(down, m, False, low), taken.free(down + m, m, True, high)) if n is not None]
        if free:
            return min(free, key=lambda n: (abs(n - target), n))
    return None


def gap_numbers(gap: dict, count: int, taken: Taken | set[int]) -> list[int] | None:
    """Numbers for `count` genes between two current ones, before the first or after the last; null where there is no room.

    `gap` has low and high (null beyond the ends), width, and the usual step of its sequence.
    """
    taken = taken if isinstance(taken, Taken) else Taken.of(taken)
    low, high = gap["low"], gap["high"]
    out: list[int] = []
    if high is None:
        at = low
        for _ in range(count):
            at += gap["step"]
            while at < 10 ** gap["width"] and at in taken:
                at += SKIP
            if at >= 10 ** gap["width"]:
                return None
            out.append(at)
        return out
    if low is not None and not low < high <= low + WIDEST:
        return None
    low = low or 0
    for i in range(1, count + 1):
        n = nearest_free(low + (high - low) * i / (count + 1), low, high, taken)
        if n is None:
            return None
        taken.own.add(n)
        out.append(n)
    return out


def parsed(genes: DataFrame) -> DataFrame:
    """Genes (gene_id, ...) with the parts of their identifier; those without a number are left out."""
    return genes.withColumn("__p", text.id_parts(F.col("gene_id"))).filter("__p is not null").select(*genes.columns, "__p.*")


def namespaces(current: DataFrame) -> DataFrame:
    """Per sequence, prefix and suffix of its genes' identifiers: adjacent pairs by place, how many of them rise, and the upper
    median of the steps between neighbouring numbers (STEP if there is none)."""
    keys = ["seqid", "prefix", "suffix"]
    near = islands.lagged(current.select(*keys, "start", "number"), keys, ["start", "number"], "number", "__before")
    near = near.groupBy(*keys).agg(F.count("__before").alias("adjacent"), F.count_if(F.col("number") > F.col("__before")).alias("rising"))
    steps = islands.lagged(current.select(*keys, "number").distinct(), keys, ["number"], "number", "__before").withColumn("d", F.col("number") - F.col("__before"))
    return near.join(islands.upper_median(steps, keys, "d", "step"), keys, "left").withColumn("step", F.coalesce("step", F.lit(STEP)).cast("long"))


def taken_runs(numbers: DataFrame) -> DataFrame:
    """Runs (prefix, suffix, m, start, end) of neighbouring multiples of each of ROUND among numbers (prefix, suffix, number)."""
    at = numbers.select("prefix", "suffix", "number", F.explode(F.array(*map(F.lit, ROUND))).alias("m")).filter("number % m = 0")
    units = at.select("prefix", "suffix", "m", F.expr("number div m").alias("start")).withColumn("end", F.col("start"))
    return islands.merge_intervals(units, ["prefix", "suffix", "m"]).select("prefix", "suffix", "m", (F.col("start") * F.col("m")).alias("start"), (F.col("end") * F.col("m")).alias("end"))


def _windows() -> Column:
    """Where a gap must know what is taken: around its targets, or on the way behind the last gene."""
    low, high, n, reach = F.coalesce("low", F.lit(0)), F.col("high"), F.size("ids"), F.col("reach")
    all_of_it = F.array(F.struct(low.alias("start"), high.alias("end")))
    target = lambda i: F.floor(low + (high - low) * i / (n + 1))
    some = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.greatest(target(i) - reach, low).alias("start"), F.least(target(i) + reach, high).alias("end")))
    behind = F.array(F.struct(low.alias("start"), (low + (n * F.col("step")) + SKIP * reach).alias("end")))
    return F.when(high.isNull(), behind).when(high - low <= 2 * reach * n, all_of_it).otherwise(some)


_GAP = "seqid string, at long, prefix string, suffix string, low long, high long, width int, step long, ids array<string>, reach long"


def _proposed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The numbers of each gap; none where there is no room, and `unknown` where the gap has to see more."""
    whole = lambda x: None if pd.isna(x) else int(x)
    for pdf in frames:
        numbers, unknown = [], []
        for r in pdf.itertuples(index=False):
            runs: dict[int, list[tuple[int, int]]] = {}
            for x in sorted((x["m"], x["start"], x["end"]) for x in (() if r.runs is None else r.runs)):
                runs.setdefault(x[0], []).append(x[1:])
            taken = Taken(runs, [(x["start"], x["end"]) for x in r.windows])
            try:
                numbers.append(gap_numbers({"low": whole(r.low), "high": whole(r.high), "width": int(r.width), "step": int(r.step)}, len(r.ids), taken))
                unknown.append(False)
            except Unknown:
                numbers.append(None)
                unknown.append(True)
        yield pdf.drop(columns=["runs", "windows"]).assign(numbers=numbers, unknown=unknown)


def dealt(gaps: DataFrame, taken: DataFrame) -> DataFrame:
    """`new_id`, `gene_id` for the genes (ids) of gaps, as if the gaps were worked off one by one in order of seqid and place (at);
    a gap without room gives none. `taken` are known numbers (prefix, suffix, number).

    In each round every open gap proposes from what is settled. What it didn't choose doesn't matter to it, so a proposal stands
    unless an earlier open gap can still get one of its numbers: by its own proposal, or, where that one doesn't stand, anywhere
    in its range. The first open gap of a name space always stands or asks for more; most tables need one or two rounds.
    """
    spark, name, order = gaps.sparkSession, ["prefix", "suffix"], F.struct("seqid", "at")
    left, left_path = written(gaps.withColumn("reach", F.lit(REACH).cast("long")), "gaps")
    known, known_path = written(taken.select(*name, "number").distinct(), "numbers")
    done = []
    while True:
        runs, runs_path = written(taken_runs(known), "runs")
        asking = left.withColumn("windows", _windows())
        windows = asking.select(*name, "seqid", "at", F.explode("windows").alias("w")).select(*name, "seqid", "at", "w.*")
        near = overlap_join(windows, runs, name).groupBy("seqid", "at").agg(F.collect_set(F.struct(F.col("m_r").alias("m"), F.col("start_r").alias("start"), F.col("end_r").alias("end"))).alias("runs"))
        proposed, path = written(asking.join(near, ["seqid", "at"], "left").mapInPandas(_proposed, _GAP + ", numbers array<long>, unknown boolean"), "proposed")
        removed(spark, runs_path)
        chosen = proposed.filter("numbers is not null").select(*name, "seqid", "at", order.alias("place"), F.explode("numbers").alias("number"))
        # Of those that want a number the earliest has it; the others, and those that must see more, may still take any number in their range.
        beaten = chosen.join(chosen.groupBy(*name, "number").agg(F.min("place").alias("first")), [*name, "number"]).filter("place > first").select("seqid", "at").distinct()
        moving = proposed.join(beaten, ["seqid", "at"], "left_semi").union(proposed.filter("unknown"))
        ranges = moving.select(*name, order.alias("mover"), F.coalesce("low", F.lit(0)).alias("start"), F.coalesce("high", F.expr("cast(power(10, width) as bigint)")).alias("end"))
        ranges, ranges_path = written(ranges, "ranges")
        if movers := ranges.count():
            points = chosen.select(*name, "seqid", "at", "place", F.col("number").alias("start"), F.col("number").alias("end"))
            unsafe = overlap_join(points, ranges, name).filter("mover_r <= place").select("seqid", "at").union(moving.select("seqid", "at")).distinct()
            stands = proposed.filter("numbers is not null").join(unsafe, ["seqid", "at"], "left_anti")
        else:
            unsafe, stands = None, proposed.filter("numbers is not null")
        settled, _ = written(stands.select(*name, "width", F.explode(F.arrays_zip("ids", "numbers")).alias("x")).select(*name, "width", F.col("x.ids").alias("new_id"), F.col("x.numbers").alias("number")), "settled")
        done.append(settled)
        if not movers:
            break
        again = proposed.join(unsafe, ["seqid", "at"], "left_semi").select(*gaps.columns, F.when(F.col("unknown"), F.col("reach") * FURTHER).otherwise(F.col("reach")).alias("reach"))
        next_left, next_path = written(again, "gaps")
        next_known, next_known_path = written(known.union(settled.select(*name, "number")), "numbers")
        for old in (left_path, known_path, path, ranges_path):
            removed(spark, old)
        left, left_path, known, known_path = next_left, next_path, next_known, next_known_path
    for old in (left_path, known_path, path, ranges_path):
        removed(spark, old)
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    digits = F.col("number").cast("string")
    return every.select("new_id", F.concat("prefix", F.lpad(digits, F.greatest("width", F.length(digits)), F.lit("0")), "suffix").alias("gene_id"))


def positional_ids(new: DataFrame, current: DataFrame, reserved: DataFrame, strict: bool = False) -> DataFrame:
    """`new_id` and `gene_id` in the current style for new genes (new_id, seqid, start, end) that fit between current ones (seqid,
    start, gene_id); `reserved` are all identifiers (gene_id) that exist.

    A gap gives no identifiers where its ends belong to different name spaces, numbers don't rise (unless `strict`, in at least
    RISING of the neighbours on the sequence), or room is short. Neighbours are found by two as-of lookups in bins. A gap is one
    row with its new genes; of taken numbers it gets the runs around its targets.
    """
    c = parsed(current)
    anchor = F.struct("start", "number", "prefix", "gene_id", "width", "suffix")
    at = lambda f: c.groupBy("seqid", "start").agg(f(anchor).alias("a"))
    left = islands.as_of(new, at(F.max), ["seqid"], "start", "a").withColumnRenamed("last_value", "l")
    both = islands.as_of(left, at(F.min), ["seqid"], "start", "a", after=True).withColumnRenamed("next_value", "r").filter("l is not null or r is not null")
    one = both.select("new_id", "seqid", "start", "end", "l", "r", F.coalesce("l.prefix", "r.prefix").alias("prefix"), F.coalesce("l.suffix", "r.suffix").alias("suffix"), F.coalesce("l.width", "r.width").alias("width"))
    one = one.join(namespaces(c), ["seqid", "prefix", "suffix"])
    fits = F.expr("(l is null or (l.prefix = prefix and l.suffix = suffix)) and (r is null or (r.prefix = prefix and r.suffix = suffix))")
    one = one.filter(fits if strict else fits & F.expr(f"adjacent >= 2 and rising >= {RISING} * adjacent"))
    gaps = one.groupBy("seqid", F.coalesce("l.start", F.lit(-1)).cast("long").alias("at")).agg(
        F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"), F.first("l.number").alias("low"), F.first("r.number").alias("high"), F.first("width").cast("int").alias("width"), F.first("step").alias("step"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "new_id"))), lambda x: x["new_id"]).alias("ids"),
    )
    return dealt(gaps, parsed(reserved.select("gene_id")))


def style_counts(current: DataFrame, on: list[str], style: list[str], order: str) -> DataFrame:
    """`on`, `style` (a struct), `n` and `all`: the commonest style of a key, its rows and all rows; of equals the one met first."""
    counts = current.groupBy(*on, *style).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*on).agg(F.min_by(F.struct(*style), F.struct(-F.col("n"), F.col("first"))).alias("style"), F.max("n").alias("n"), F.sum("n").alias("all"))


def free_ranks(rows: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """`rows` (on, k from 0) with `place`, the k-th place from 0 of their key that isn't in `taken` (on, place).

    Places are ranked within bins, so no key has to meet in one task; the k-th free one is k plus the taken ones before it.
    """
    order = [*on, "place"]
    ranked = islands.numbered(taken.select(*order).distinct(), order, "__r", [*on, F.floor(F.col("place") / islands.BIN)])
    least = ranked.groupBy(*on).agg(F.min("__r").alias("__low"))
    before = ranked.join(least, on).select(*on, (F.col("place") - (F.col("__r") - F.col("__low"))).alias("k"), (F.col("__r") - F.col("__low") + 1).alias("skip")).groupBy(*on, "k").agg(F.max("skip").alias("skip"))
    return islands.as_of(rows, before, on, "k", "skip").withColumn("place", F.col("k") + F.coalesce("last_value", F.lit(0))).drop("last_value")


def style_ids(new: DataFrame, current: DataFrame, reserved: DataFrame) -> DataFrame:
    """`new_id`, `gene_id`, `basis` in a style learnt from current genes (seqid, gene_id), for new genes (new_id, seqid, start).

    The commonest style of the sequence is used; else one that contains the sequence's name, if SEVERAL genes have it; else
    the one that DOMINANT of all genes share. Of equally common styles the one met first counts, by `row_idx` where current
    genes have it, else by identifier. Names that a registry hands out (LOC) are never made up. A style goes on above its
    largest current number, in steps that divide all its distances; one that no current gene has starts at the least number of
    its kind. Numbers are dealt by rank in order of sequence and place, and end with the style's width.
    """
    order = "row_idx" if "row_idx" in current.columns else "gene_id"
    c = parsed(current)
    schema = ["prefix", "width", "suffix"]
    local = style_counts(c, ["seqid"], schema, order).select("seqid", F.col("style").alias("local"))
    static = style_counts(c, [], schema, order).filter(F.col("n") >= DOMINANT * F.col("all")).select(F.col("style").alias("static"))
    inside = F.when(F.contains("prefix", "seqid"), F.struct(_replaced(F.col("prefix"), F.col("seqid")).alias("prefix"), "width", F.col("suffix"))).when(
        F.contains("suffix", "seqid"), F.struct(F.col("prefix"), F.col("width"), _replaced(F.col("suffix"), F.col("seqid")).alias("suffix"))
    )
    named = c.filter("seqid <> ''").withColumn("d", inside).filter("d is not null")
    commonest = style_counts(named, [], ["d"], order).filter(F.col("n") >= SEVERAL).select(F.col("style.d").alias("d"))
    own = named.join(F.broadcast(commonest), "d")  # one row at most, as are the two below
    dynamic = own.groupBy("d").agg(F.min("number").alias("from")).join(islands.numeric_steps(own, ["d"], "number", "by"), "d").select(F.struct("d", "from", "by").alias("dynamic"))
    filled = lambda x: F.replace(x, F.lit("{seqid}"), F.col("seqid"))
    chosen = new.join(local, "seqid", "left").join(F.broadcast(static), how="left").join(F.broadcast(dynamic), how="left").select(
        "new_id", "seqid", "start",
        F.coalesce("local", F.when(F.col("dynamic").isNotNull(), F.struct(filled(F.col("dynamic.d.prefix")).alias("prefix"), F.col("dynamic.d.width").alias("width"), filled(F.col("dynamic.d.suffix")).alias("suffix"))), "static").alias("s"),
        F.when(F.col("local").isNotNull(), "inferred_local_source_id_style").when(F.col("dynamic").isNotNull(), "inferred_seqid_source_id_style").otherwise("inferred_dominant_source_id_style").alias("basis"), F.col("dynamic.from").alias("from"), F.col("dynamic.by").alias("by"),
    )
    chosen = chosen.filter("s is not null").select("*", "s.*").drop("s").filter(~F.upper("prefix").endswith("LOC") & ~F.contains(F.upper("prefix"), F.lit("GENE-LOC")))
    chosen, _ = written(chosen, "styles")

    # Where each style that is asked for begins, and by how much it rises.
    asked = chosen.groupBy(*schema).agg(F.first("from", ignorenulls=True).alias("from"), F.first("by", ignorenulls=True).alias("by"))
    used = c.select(*schema, "number").join(asked, schema, "left_semi")
    tops = used.groupBy(*schema).agg(F.max("number").alias("top")).join(islands.numeric_steps(used, schema, "number"), schema)
    begins = asked.join(tops, schema, "left").select(*schema, F.coalesce("step", "by", F.lit(1)).alias("step"), F.coalesce(F.col("top") + F.col("step"), F.col("from"), F.lit(1)).alias("at"))
    begins, _ = written(begins, "begins")
    rows = islands.numbered(chosen, [*schema, "basis", "seqid", "start", "new_id"], "__n", [*schema, "basis", "seqid", F.floor(F.col("start") / islands.BIN)])
    rows = rows.join(rows.groupBy(*schema).agg(F.min("__n").alias("__low")), schema).select(*schema, "new_id", "basis", (F.col("__n") - F.col("__low")).alias("k"))
    exists = parsed(reserved.select("gene_id")).select(*schema, "number").join(begins, schema).filter("number >= at and (number - at) % step = 0").select(*schema, F.expr("(number - at) div step").alias("place"))
    number = F.col("at") + F.col("step") * F.col("place")
    made = free_ranks(rows, exists, schema).join(begins, schema).withColumn("number", number).filter(F.length(F.col("number").cast("string")) <= F.col("width"))
    return made.select("new_id", F.concat("prefix", F.lpad(F.col("number").cast("string"), F.col("width"), F.lit("0")), "suffix").alias("gene_id"), "basis")


def _replaced(text_: Column, name: Column) -> Column:
    """The first occurrence of a name replaced by a mark."""
    at = F.call_function("instr", text_, name)
    return F.concat(F.substr(text_, F.lit(1), at - 1), F.lit("{seqid}"), F.substr(text_, at + F.length(name)))


def gene_mapping(new: DataFrame, anchors: DataFrame, current: DataFrame, reserved: DataFrame, prefix: str = "NewG", first: int = 1, width: int = 8, strategy: str = "sequential", refuse: bool = True) -> DataFrame:
    """Final identifiers of new genes (new_id, seqid, start, end): `gene_id`, `basis`, `status`, `collides`.

    In this order: inherited from `anchors` (new_id, gene_id, basis, status), by place between current genes and by source style
    (strategy "current_style_or_sequential"; "current_style_positional": by place only), else numbered in a new name space,
    where existing identifiers are passed over. `collides` marks an identifier that two genes got, or a new one that exists.

    With `refuse` a collision is an error, as is, under "current_style_positional", a gene that no gap has room for: a release
    is not to be written with it. Without, the former are marked and the latter numbered in the new name space.
    """
    left = new.join(anchors.select("new_id"), "new_id", "left_anti")
    made = anchors.select("new_id", "gene_id", "basis", "status", F.lit(True).alias("reused"))
    every = reserved.select("gene_id").union(current.select("gene_id")).distinct()
    fixed = lambda df, basis, status: df.select("new_id", "gene_id", basis.alias("basis"), F.lit(status).alias("status"), F.lit(False).alias("reused"))
    if strategy in ("current_style_positional", "current_style_or_sequential"):
        placed, _ = written(positional_ids(left, current, every, strict=strategy == "current_style_positional"), "placed")
        made = made.union(fixed(placed, F.lit("current_namespace_genomic_gap"), "deterministic_new_position_id"))
        left = left.join(placed, "new_id", "left_anti")
        if refuse and strategy == "current_style_positional" and (none := [r.new_id for r in left.select("new_id").limit(5).collect()]):
            raise ValueError(f"no number between the current ones for {', '.join(none)} (the first of those without)")
        if strategy == "current_style_or_sequential":
            styled, _ = written(style_ids(left, current, every.union(placed.select("gene_id"))), "styled")
            made = made.union(fixed(styled, F.col("basis"), "deterministic_new_source_style_id"))
            left, every = left.join(styled, "new_id", "left_anti"), every.union(styled.select("gene_id"))
        every = every.union(placed.select("gene_id"))
    digits = F.regexp_extract("gene_id", f"^{re.escape(prefix)}([0-9]{{{width},}})$", 1)
    number = digits.try_cast("long")
    one = F.lit(0).alias("key")
    taken = every.filter((digits != "") & (number >= first) & (text.numbered_id(prefix, number, width) == F.col("gene_id"))).select(one, (number - first).alias("place"))
    order = islands.numbered(left, ["seqid", "start", "end", "new_id"], "__n", ["seqid", F.floor(F.col("start") / islands.BIN)]).select("new_id", one, (F.col("__n") - 1).alias("k"))
    fresh = free_ranks(order, taken, ["key"]).select("new_id", text.numbered_id(prefix, F.col("place") + first, width).alias("gene_id"), F.lit("sequential_new_namespace").alias("basis"), F.lit("deterministic_new_namespace_id").alias("status"), F.lit(False).alias("reused"))
    whole, _ = written(made.union(fresh), "mapping")
    twice = whole.groupBy("gene_id").agg((F.count("*") > 1).alias("twice"))
    known = reserved.select("gene_id").union(current.select("gene_id")).distinct().withColumn("exists", F.lit(True))
    out = whole.join(twice, "gene_id").join(known, "gene_id", "left").select("new_id", "gene_id", "basis", "status", (F.col("twice") | (~F.col("reused") & F.coalesce("exists", F.lit(False)))).alias("collides"))
    if refuse and (bad := [f"{r.new_id}: {r.gene_id}" for r in out.filter("collides").limit(5).collect()]):
        raise ValueError(f"identifiers that exist or were given twice: {', '.join(bad)}")
    return out
