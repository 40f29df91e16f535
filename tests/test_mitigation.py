"""Constrained training and mitigation runs on tables with a planted effect."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier

from evenhand.operators import mitigation as G


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(9)
    n = 2400
    g = rng.choice(["a", "b"], n, p=[0.6, 0.4])
    x, z = rng.normal(size=n) - 0.8 * (g == "b"), rng.normal(size=n)
    y = (x + 0.3 * z + rng.normal(scale=0.5, size=n) > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "z": z, "y": y})
    return spark.createDataFrame(pdf[:1600]).cache(), spark.createDataFrame(pdf[1600:]).cache()


@pytest.mark.parametrize("learner", [None, lambda **k: DecisionTreeClassifier(maxDepth=4, seed=1, **k)])
def test_constraint_holds_on_train_and_costs_accuracy(split, learner):
    train, _ = split
    game = G.ConstrainedTraining(train, ["x", "z"], "y", "g", learner)
    loose, free = game.solve(0.5)
    tight, bound = game.solve(0.02)
    assert free["gap"] > 0.1 and free["duality_gap"] < 0.01
    assert bound["gap"] <= 0.02 + 1e-9 and bound["duality_gap"] < 0.1 and bound["error"] > free["error"] and bound["solved"] == (bound["duality_gap"] <= 0.005)
    scored = tight.score(train).groupBy("g").agg({"y_prob": "avg"}).toPandas().set_index("g")["avg(y_prob)"]
    whole = tight.score(train).agg({"y_prob": "avg"}).first()[0]
    assert np.isclose(max(abs(scored - whole)), bound["gap"], atol=1e-6)
    assert abs(sum(tight.weights) - 1) < 1e-9 and loose.score(train).count() == 1600


def test_pool_game_matches_a_fine_grid():
    """The game on three hypotheses against all mixtures on a grid."""
    game = object.__new__(G.ConstrainedTraining)
    game.names, game.p = ["a", "b"], np.array([0.5, 0.5])
    game.rates, game.errors = np.array([[0.0, 0.0], [1.0, 1.0], [0.7, 0.3], [0.5, 0.45]]), np.array([0.5, 0.5, 0.1, 0.3])
    for epsilon in (0.01, 0.05, 0.1, 0.3):
        weights = game._within(game._solve(epsilon, 10.0)[0], epsilon)
        best = min(
            w @ game.errors
            for w in (np.array([i, j, k, 100 - i - j - k]) / 100 for i in range(0, 101, 4) for j in range(0, 101 - i, 4) for k in range(0, 101 - i - j))
            if max(abs(w @ game.rates - (w @ game.rates) @ game.p)) <= epsilon
        )
        over = max(abs(weights @ game.rates - (weights @ game.rates) @ game.p))
        assert over <= epsilon + 1e-9 and weights @ game.errors <= best + 0.02


def test_each_level_runs_its_techniques(split):
    train, test = split
    for level, techniques in G.PLAN.items():
        rows = G.run_mitigation(train, test, "id", ["x", "z"], "y", "g", level, rounds=5).collect()
        assert [r.technique for r in rows] == list(techniques) and sum(r.chosen for r in rows) == 1
        assert all(r.original_accuracy > 0.75 and r.gap_before > 0.2 and abs(r.mitigated_accuracy - r.original_accuracy - r.accuracy_change) < 2e-4 for r in rows)
        if level == "HIGH":
            assert all(r.gap_after < r.gap_before / 2 for r in rows)
            assert next(r for r in rows if r.chosen).mitigated_accuracy == max(r.mitigated_accuracy for r in rows)
    with pytest.raises(ValueError):
        G.run_mitigation(train, test, "id", ["x"], "y", "g", "UNKNOWN")


def test_levels_share_a_baseline(split, monkeypatch):
    train, test = split
    fits, fit = [], G.fit_classifier
    monkeypatch.setattr(G, "fit_classifier", lambda *a, **k: fits.append(a) or fit(*a, **k))
    baseline = G.mitigation_baseline(train, test, ["x", "z"], "y")
    shared = [G.run_mitigation(train, test, "id", ["x", "z"], "y", "g", level, baseline=baseline).collect() for level in ("LOW", "MEDIUM")]
    assert len(fits) == 3  # the original, the oversampled and the weighted one
    assert shared == [G.run_mitigation(train, test, "id", ["x", "z"], "y", "g", level).collect() for level in ("LOW", "MEDIUM")]


def test_best_mixture_is_exact():
    """Mixture and prices prove each other: what the mixture costs is what the prices say any mixture costs at least."""
    from evenhand.functions.programme import best_mixture

    rng = np.random.default_rng(4)
    for _ in range(150):
        n, groups = rng.integers(2, 9), rng.integers(1, 5)
        over = rng.normal(scale=0.3, size=(n, groups)).round(2)
        over[0] = 0.0
        errors, epsilon, bound = rng.random(n).round(2), float(rng.choice([0.0, 0.01, 0.1, 0.5])), float(rng.choice([0.5, 10.0]))
        weights, prices = best_mixture(errors, over, epsilon, bound)
        slack = np.hstack([over, -over]) - epsilon
        value = weights @ errors + bound * max(0.0, (weights @ slack).max())
        assert abs(weights.sum() - 1) < 1e-9 and (weights >= 0).all() and (prices >= 0).all() and prices.sum() <= bound + 1e-9
        # strong duality: the prices prove that no mixture is better
        assert abs(value - (errors + slack @ prices).min()) < 1e-9
    assert best_mixture(np.array([0.5]), np.zeros((1, 3)), 0.1, 1.0)[0].tolist() == [1.0]
