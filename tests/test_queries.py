"""Every registered query against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows_of

SF = "/root/testdata/sf0.001"
CORE = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'; SET memory_limit = '4GB'; SET threads = 4")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(CORE) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    df = CORE[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_assignment_query_is_one_to_one(spark):
    got = CORE["g06_assignment"](spark, SF).collect()
    assert got and len({(r.locus, r.old_id) for r in got}) == len({(r.locus, r.new_id) for r in got}) == len(got)


def test_positional_ids_are_new_and_lie_between_their_neighbours(spark):
    """Each number was free, is given once, and rises with the place between the current genes of its sequence."""
    from locuskit.plans.views import transcripts

    t = {r.tx_id: r for r in transcripts(spark, SF).select("tx_id", "seqid", "source", "start").collect()}
    known = {r.tx_id * 10 for r in t.values() if r.source == "current"}
    got = {int(r.new_id): int(r.gene_id.removeprefix("GeneG")) for r in CORE["g09_positional_ids"](spark, SF).collect()}
    assert len(set(got.values())) == len(got) > 100 and not known & set(got.values())
    for i, n in got.items():
        own = sorted((r.start, r.tx_id * 10) for r in t.values() if r.source == "current" and r.seqid == t[i].seqid)
        before, after = [x for s, x in own if s <= t[i].start], [x for s, x in own if s > t[i].start]
        assert (not before or before[-1] < n) and (not after or n < after[0])
