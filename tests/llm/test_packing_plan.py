"""Plans of histograms with few lengths against their optimum."""

import numpy as np
import pytest

from graphspark.llm import packing


@pytest.mark.parametrize(
    "length, count, optimum",
    [((1000, 700, 340), (6000, 6000, 6000), 6000), ((900, 600, 520), (1000, 3000, 5000), 3000), ((1100, 900), (500, 500), 500), ((683, 1365), (900, 900), 900), ((2048,), (7,), 7), ((1025,), (7,), 7)],
)
def test_few_lengths_reach_the_optimum(length, count, optimum):
    plan = packing.solve(np.array(length), np.array(count))
    assert plan.sequences <= optimum + len(length) - 1
    used = np.zeros(plan.sequences, np.int64)
    for one, n in zip(length, count):
        sequence, offset = plan.place(np.full(n, one), np.arange(n))
        np.add.at(used, sequence, one)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n
    assert used.max() <= 2048


def test_the_program_carries_the_plan():
    """Dense histograms: the lower bound within half a percent, and nine in ten sequences from patterns."""
    rng = np.random.default_rng(1)
    for size, high in ((12_000, 2048), (300_000, 2048), (5_000, 700)):
        length, count = np.unique(rng.integers(1, high + 1, size), return_counts=True)
        plan = packing.solve(length, count)
        assert plan.of_program >= 0.9 * plan.sequences
        assert plan.bound <= plan.sequences <= 1.005 * plan.bound + 1


def test_knapsack_finds_the_best_admissible_pattern():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        length = np.sort(rng.choice(np.arange(1, 25), n, replace=False))
        price, most, capacity = rng.random(n) * length, rng.integers(1, 5, n), 30
        sack = packing.Knapsack(length, price, most, capacity)
        for room in (7, capacity):
            best = max(price @ c for c in np.ndindex(*(most + 1)) if length @ c <= room)
            found = sack.pattern(room)
            assert abs(sack.best[room] - best) < 1e-6 and abs(sum(price[k] * m for k, m in found.items()) - best) < 1e-6
            assert all(m <= most[k] for k, m in found.items()) and sum(length[k] * m for k, m in found.items()) <= room


CONSTANT = tuple((rounds, 0.0, slack) for rounds, _, slack in packing.PHASES)


def test_weights_close_the_gap_that_constant_prices_leave():
    """Pieces that don't fill sequences: what they fill is not what they are worth."""
    length, count = np.array([340, 700, 1100]), np.array([900, 700, 500])
    solved, constant = packing.fractional(length, count, 2048), packing.fractional(length, count, 2048, CONSTANT)
    assert solved.bound <= solved.total <= 1.01 * solved.bound
    assert constant.total > 1.1 * constant.bound and constant.total > 1.02 * solved.total
    plan, worse = packing.solve(length, count), packing.solve(length, count, phases=CONSTANT)
    assert plan.sequences < worse.sequences and plan.of_program >= 0.95 * plan.sequences


def test_a_fractional_solution_covers_all_counts():
    rng = np.random.default_rng(3)
    length, count = np.unique(rng.integers(1, 120, 900), return_counts=True)
    found = packing.fractional(length, count, 128)
    covered = np.zeros(len(length))
    for pattern, times in found.taken.items():
        assert times > 0 and sum(length[k] * n for k, n in pattern) <= 128
        for k, n in pattern:
            covered[k] += n * times
    assert (covered >= count - 1e-6).all() and found.bound <= found.total + 1e-6 <= 1.05 * found.bound


def test_a_table_has_the_best_pattern_for_every_room():
    rng = np.random.default_rng(11)
    for _ in range(40):
        length = np.sort(rng.choice(np.arange(2, 15), 3, replace=False))
        price = rng.random(3) * length
        table = packing.Table(length, price, 30)
        for room in range(31):
            best = max(price @ c for c in np.ndindex(16, 16, 16) if length @ c <= room)
            pattern = table.pattern(room)
            assert abs(table.best[room] - best) < 1e-9 and abs(sum(price[k] * n for k, n in pattern.items()) - best) < 1e-9
            assert sum(length[k] * n for k, n in pattern.items()) <= room


def test_best_fit_looks_for_full_sequences():
    runs = packing._best_fit(np.array([3, 5, 6, 7]), np.array([1, 2, 1, 1]), 10)
    assert len(runs) == 3  # 7 + 3, 6, 5 + 5
