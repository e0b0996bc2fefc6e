"""Mixing: targets by hand, sums near their targets, defined cases."""

import pytest

from docskein.llm import mixing


def fill(sizes, weights, budget, most):
    """Targets by raising all sources until none is above its limit."""
    target, open_ = {}, set(sizes)
    while open_:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not above:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("seed", ["a", "b"])
def test_targets_and_sums(docs_of, seed):
    rows = [(i, "w " * (1 + i * 7 % 40), s) for i in range(240)
            for s in [("a", "b", "ü", None)[(i * i) % 11 % 4]]]
    plan = mixing.mixed(docs_of(rows), [3, 1, 2], 1.5, 2.0, seed).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(s for s in sizes if s) + [None]
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    taken = {}
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(plan) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mixed(docs_of(rows), [3, 1, 2], 1.5, 2.0, seed).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_defined_cases(docs_of, spark):
    d = docs_of([(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "q r", "b"), (4, "k " * 90_000, "b")])
    plan = mixing.mixed(d, [3, 1, 2], 1.5, 2.0).collect()
    assert len(plan) == 6 and sum(r.size for r in plan) == 90_008
    assert mixing.mixed(d.limit(0), [3, 1, 2], 1.5, 2.0).count() == 0
    out = mixing.mixed_documents(d, [3, 1, 2], 1.5, 2.0)
    assert out.columns == d.columns and 0 < out.count() <= 12


def test_heavier_quality_is_taken_more_often(docs_of):
    rows = [(i, "a b c d e f g h" if i % 2 else "a# b# c# d# e# f# g# h#", "s") for i in range(2000)] + [(9999, "z " * 40_000, "t")]
    plan = [r for r in mixing.mixed(docs_of(rows), [1, 3], 0.5, 2.0).collect() if r.source == "s" and r.taken]
    clean = sum(r.doc_id % 2 for r in plan)
    assert clean > 0.6 * len(plan)
