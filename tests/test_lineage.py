"""Assignment in large loci, where taking the best pair in turn is not the optimum."""

import random
from functools import lru_cache

import pytest

from locuskit.operators import lineage
from tests.test_operators import brute_assignment


def total(scores, pairs):
    return tuple(map(sum, zip(*[scores[p] for p in pairs], strict=True)))


@pytest.mark.parametrize("genes", [13, 14, 19, 20, 25, 40])
def test_large_locus_is_optimal(genes):
    """Blocks of two where the best pair leaves the other two genes without one."""
    scores, want = {}, []
    for k in range(0, genes - 1, 2):
        a, b, x, y = f"o{k:02}", f"o{k + 1:02}", f"n{k:02}", f"n{k + 1:02}"
        scores |= {(a, x): (10, 0, 0, 0, -1), (a, y): (9, 0, 0, 0, 0), (b, x): (9, 0, 0, 0, 0), (b, y): (0, 0, 0, 0, -2)}
        want += [(a, y), (b, x)]
    if genes % 2:
        scores[f"o{genes:02}", f"n{genes:02}"] = (1, 0, 0, 0, 0)
        want.append((f"o{genes:02}", f"n{genes:02}"))
    assert lineage.best_pairs(scores) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_dense_locus_has_the_greatest_total(seed):
    r = random.Random(seed)
    olds, news = [f"o{i:02}" for i in range(r.randint(3, 13))], [f"n{i:02}" for i in range(13)]
    scores = {(o, n): (r.randint(0, 3), r.randint(0, 2), r.randint(0, 9), 1, -r.randint(0, 9)) for o in olds for n in news}

    @lru_cache(maxsize=None)
    def best(i, used):
        if i == len(olds):
            return (0,) * 5
        options = [tuple(a + b for a, b in zip(scores[olds[i], n], best(i + 1, used | 1 << j), strict=True)) for j, n in enumerate(news) if not used >> j & 1]
        return max(options)

    got = lineage.best_pairs(scores)
    assert len({o for o, _ in got}) == len({n for _, n in got}) == len(got)
    assert total(scores, got) == best(0, 0)


@pytest.mark.parametrize("seed", range(200))
def test_ties_and_negative_entries(seed):
    r = random.Random(seed)
    scores = {(f"o{i}", f"n{j}"): tuple(r.randint(-1, 1) for _ in range(5)) for i in range(r.randint(1, 4)) for j in range(r.randint(1, 4))}
    assert lineage.best_pairs(scores) == brute_assignment(scores)
