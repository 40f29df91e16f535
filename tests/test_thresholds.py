"""Equal-rate thresholds against all pairs of thresholds, with one and with many pieces."""

import random

import numpy as np
import pytest

from evenhand.operators import mitigation as G
from evenhand.plans import hulls, ordered

SCHEMA = "id long, g string, y int, p double, strict double, mix double"


def rows(spark, seed, n, scores):
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        g = rnd.choice(["a", "a", "a", "b", "c", None])
        p = round(rnd.random() * scores) / scores if rnd.random() > 0.03 else None
        y = None if rnd.random() < 0.03 else int(rnd.random() < (p or 0) * {"a": 1.0, "b": 0.6, "c": 0.9}.get(g, 1))
        made.append((i, g, y, p, 0.0, 0.0))
    return made


def best_pairs(made):
    """The best common rate and each group's expected right decisions there, over all pairs of thresholds."""
    points = {}
    for g in sorted({r[1] for r in made if r[1]}):
        own = [(r[3], r[2]) for r in made if r[1] == g and r[2] is not None and r[3] is not None]
        if not own:
            continue
        for t in [None, *sorted({p for p, _ in own})]:
            chosen = [t is None or p > t for p, _ in own]
            points.setdefault(g, []).append((sum(chosen) / len(own), sum(c == (y == 1) for c, (_, y) in zip(chosen, own))))
    rates = sorted({x for p in points.values() for x, _ in p})

    def at(p, r):
        return max(a[1] if a[0] == b[0] else a[1] + (b[1] - a[1]) * (r - a[0]) / (b[0] - a[0]) for a in p for b in p if a[0] <= r <= b[0])

    totals = [round(sum(at(p, r) for p in points.values()), 6) for r in rates]
    return rates[int(np.argmax(totals))], max(totals)


@pytest.mark.parametrize("seed, n, scores, piece_rows", [(1, 400, 20, 5), (2, 400, 20, 10**6), (3, 700, 300, 9), (4, 60, 3, 1)])
def test_best_common_rate(spark, monkeypatch, seed, n, scores, piece_rows):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(hulls, "FAN", 3)
    made = rows(spark, seed, n, scores)
    df = spark.createDataFrame(made, SCHEMA)
    found = G.equal_rate_thresholds(df, "g", "y", "p")
    got = found.collect()
    rate, total = best_pairs(made)
    assert {r.common_rate for r in got} == {rate}
    chances = {r.id: r.y_select for r in G.mixed_selection(df, found, "g", "p").collect()}
    right = 0.0
    for g in {r.grp for r in got}:
        own = [r for r in made if r[1] == g and r[2] is not None and r[3] is not None]
        assert abs(sum(chances[r[0]] for r in own) / len(own) - rate) < 1e-12  # the same rate for every group
        right += sum(chances[r[0]] if r[2] else 1 - chances[r[0]] for r in own)
    assert abs(right - total) < 1e-5
    assert all(chances[r[0]] is None for r in made if r[1] is None or r[3] is None)


def test_decisions_are_drawn_by_key(spark):
    made = rows(spark, 5, 3000, 10)
    df = spark.createDataFrame([(*r[:4], 7, 0.0) for r in made], "id long, g string, y int, p double, y_pred int, mix double")
    found = G.equal_rate_thresholds(df, "g", "y", "p")
    once, again = ({r.id: r.y_pred for r in G.apply_mixed(df, found, "g", "p", "id").collect()} for _ in range(2))
    assert once == again and all(v == 7 for i, v in once.items() if made[i][1] is None or made[i][3] is None)
    rate = found.first().common_rate
    for g in "abc":
        own = [once[r[0]] for r in made if r[1] == g and r[3] is not None]
        assert abs(sum(own) / len(own) - rate) < 0.08


def test_one_score_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 0, 0.5), (3, "b", 1, 0.5), (4, "b", 1, 0.5)], "id long, g string, y int, p double")
    got = {r.grp: r for r in G.equal_rate_thresholds(one, "g", "y", "p").collect()}
    assert {r.common_rate for r in got.values()} == {1.0} and got["b"].strict is None and got["a"].accuracy == 0.5
    assert G.equal_rate_thresholds(one.limit(0), "g", "y", "p").collect() == []


def test_chain():
    rnd = random.Random(3)
    for _ in range(200):
        xs = sorted(rnd.sample(range(40), rnd.randint(1, 12)))
        ys = [rnd.randint(0, 9) for _ in xs]
        corners = hulls.chain(xs, ys)
        above = lambda i, a, b: (ys[i] - ys[a]) * (xs[b] - xs[a]) >= (ys[b] - ys[a]) * (xs[i] - xs[a])
        want = [i for i in range(len(xs)) if not any(not (above(i, a, b) and (ys[i] - ys[a]) * (xs[b] - xs[a]) != (ys[b] - ys[a]) * (xs[i] - xs[a])) for a in range(i) for b in range(i + 1, len(xs)))]
        assert corners == want
