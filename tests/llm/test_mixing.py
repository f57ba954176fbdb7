"""Entropy balancing: targets by hand, totals near them, caps kept."""

import pytest

from oddsmill.llm import mixing


def mixed(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, copies int")
    return {r.doc_id: r for r in mixing.mix(docs).collect()}


def by_hand(sizes):
    """Water filling by repeated resharing; ``sizes`` in source order."""
    weights = [1 + k % 3 for k in range(len(sizes))]
    total, capped = sum(sizes), {}
    while True:
        left = total - sum(capped.values())
        free = [k for k in range(len(sizes)) if k not in capped]
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return [capped.get(k, share.get(k)) for k in range(len(sizes))]
        capped |= {k: 3.0 * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [300, 5, 10, 200], [1000, 1, 1, 1, 1, 1], [7]])
def test_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes) - 1)] + [None]
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    for name, want in zip(names, by_hand(sizes), strict=True):
        assert got[name] == pytest.approx(want)


def test_totals_come_near_targets(spark):
    rows, k = [], 0
    for source, n in (("a", 120), ("b", 40), ("c", 15), (None, 60)):
        for j in range(n):
            rows.append((k, source, " w" * (1 + (j * 37) % 90)))
            k += 1
    rows += [(k, "a", None), (k + 1, "b", " \n\t "), (k + 2, "zero", "")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        own = [r for r in got.values() if r.source == source]
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - own[0].target) <= 3
    assert all(0 <= r.copies <= 3 for r in got.values())
    assert got[k].size == 0 and got[k].copies == 0 and got[k + 2].source_size == 0
    assert {i: r.copies for i, r in mixed(spark, rows).items()} == {i: r.copies for i, r in got.items()}


def test_repeated_rows_and_no_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a", ""), (1, "a", "")], "doc_id long, source string, text string")).collect()
    assert [r.copies for r in got] == [0, 0]


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_rates_solve_the_dual(spark):
    """Copies against the rates of a plain solver: bisection on each source's multiplier."""
    import math

    rows = [(k, "ab"[k % 2], " w" * (1 + (k * 29) % 60)) for k in range(400)]
    got = mixed(spark, rows)
    for source in "ab":
        own = [r for r in got.values() if r.source == source]
        target, mean = own[0].target, sum(r.size for r in own) / len(own)
        total = lambda lam: sum(r.size * min(3.0, math.exp(min(lam * r.size / mean, 10))) for r in own)  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < target else (low, mid)
        by_size = {}
        for r in own:
            by_size.setdefault(r.size, []).append(r.copies)
        # Whole copies of a size are within one of the size's tilted share, and a carry of less than one more.
        for size, copies in by_size.items():
            share = len(copies) * min(3.0, math.exp(min(low * size / mean, 10)))
            assert abs(sum(copies) - share) <= 1 + 60 / size, (size, copies, share)
