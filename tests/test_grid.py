"""Grids, budgets and the catalog."""

import inspect

import pytest

from quantloom.operators import grid
from quantloom.operators.signals import SIGNALS


def test_catalog_matches_the_signals():
    assert len(grid.CATALOG) == 34 and set(grid.CATALOG) == {*SIGNALS, "donchian_atr_trail"}
    for name, make in SIGNALS.items():
        defaults = {k: p.default for k, p in inspect.signature(make).parameters.items()}
        for p, (default, low, high) in grid.CATALOG[name][1].items():
            assert defaults[p] == default and low <= default <= high
        assert all(grid.valid(name, {**defaults, **c}) for c in grid.grid(name))


def test_values_round_half_to_even_and_deduplicate():
    assert grid.values(1, 2, 3, whole=True) == [1, 2]
    assert grid.values(0.0, 1.0, 3, whole=False) == [0.0, 0.5, 1.0]


def test_refine_stays_in_bounds():
    for c in grid.refine("sma", {"fast": 190, "slow": 480}):
        assert 1 <= c["fast"] < c["slow"] <= 500


def test_space_filling_starts_at_the_centre_and_spreads():
    line = [{"x": float(k)} for k in range(11)]
    assert [c["x"] for c in grid.space_filling(line, 3)] == [5.0, 0.0, 10.0]
    assert grid.space_filling(line, 99) == sorted(line, key=grid.canonical)


def test_budget_is_level_filled():
    assert grid.allocate({"a": 9, "b": 3, "c": 1}, 8) == {"a": 4, "b": 3, "c": 1}
    with pytest.raises(ValueError, match="too small"):
        grid.allocate({"a": 9, "b": 9}, 3)


def test_parameter_hash_ignores_order():
    assert grid.parameter_hash({"a": 1, "b": 2}) == grid.parameter_hash({"b": 2, "a": 1})


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "from quantloom import catalog; q, o = catalog.queries(), catalog.oracle_sql(); assert set(o) <= set(q) and len(q) > 170; print('listed')"
    done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, timeout=120)
    assert done.stdout == "listed\n", done.stderr[-500:]
