"""The linear programme behind constrained training: the best mixture of a pool of hypotheses, solved exactly."""

from __future__ import annotations

import numpy as np


def best_mixture(errors: np.ndarray, over: np.ndarray, epsilon: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of least error plus ``bound`` times the largest violation of \\|weights @ over\\| <= epsilon, and the constraints' prices.

    ``errors``: a number for each hypothesis; ``over``: hypotheses x groups, how far a group's rate lies above the overall rate. The first
    hypothesis has to be a constant (no difference between groups), which is where the simplex method starts. Prices are those of the
    upper constraints, then the lower ones; they are not negative and add up to ``bound`` at most.
    """
    n, rows = len(errors), 2 * over.shape[1]
    # columns: weights, the violation, a slack for each constraint, the right-hand side; the last row keeps the sum of weights at 1
    table = np.zeros((rows + 1, n + 1 + rows + 1))
    table[:rows, :n] = np.hstack([over, -over]).T
    table[:rows, n] = -1.0
    table[:rows, n + 1 : -1] = np.eye(rows)
    table[:rows, -1] = epsilon
    table[rows, :n] = table[rows, -1] = 1.0
    price = np.zeros(table.shape[1])
    price[:n], price[n] = errors, bound
    price -= errors[0] * table[rows]
    basis = [*range(n + 1, n + 1 + rows), 0]
    for step in range(50 * (n + rows)):
        gains = np.flatnonzero(price[:-1] < -1e-12)
        if not len(gains):
            break
        # the steepest column; after a while the first one, which can't go round in a circle
        column = int(gains[0]) if step > 5 * (n + rows) else int(gains[np.argmin(price[gains])])
        up = np.flatnonzero(table[:, column] > 1e-12)
        ratios = table[up, -1] / table[up, column]
        ties = up[ratios <= ratios.min() + 1e-15]
        row = int(min(ties, key=lambda r: basis[r]))
        table[row] /= table[row, column]
        others = np.arange(rows + 1) != row
        table[others] -= np.outer(table[others, column], table[row])
        price -= price[column] * table[row]
        basis[row] = column
    weights = np.zeros(n)
    for row, column in enumerate(basis):
        if column < n:
            weights[column] = max(table[row, -1], 0.0)
    return weights / weights.sum(), np.maximum(price[n + 1 : -1], 0.0)
