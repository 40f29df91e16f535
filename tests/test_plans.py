"""Shared plan shapes against brute force, with the limits set low so that every path runs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand.functions.pvalues import chi2_tail, t_tail_of_r
from evenhand.plans import neighbours, ordered, quantiles
from evenhand.plans.association import binary_tests, chi_square, with_fisher, with_p
from evenhand.plans.longform import group_rates, to_long


def test_tail_probabilities():
    assert np.allclose(chi2_tail([3.841458820694124, 9.487729036781154, 0.0], [1, 4, 3]), [0.05, 0.05, 1.0], atol=1e-12)
    x = np.array([0.3, 2.0, 40.0, 300.0])
    assert np.allclose(chi2_tail(x, np.full(4, 4)), np.exp(-x / 2) * (1 + x / 2), rtol=1e-10)
    assert chi2_tail([5.0], [0])[0] == 1.0
    # critical values of the correlation at the 5 % level
    assert np.allclose(t_tail_of_r([0.6319, 0.1966], [10, 100]), 0.05, atol=2e-4)
    assert np.allclose(t_tail_of_r([0.0, 1.0], [50, 50]), [1.0, 0.0])


def test_fisher(spark):
    tables = spark.createDataFrame([("a", 8, 0, 3, 5), ("b", 3, 1, 1, 3), ("c", 10, 0, 0, 10)], "k string, a long, b long, c long, d long")
    got = {r["k"]: r["fisher_p"] for r in with_fisher(tables, ["k"]).collect()}
    assert math.isclose(got["a"], 330 / 12870)
    assert math.isclose(got["b"], 34 / 70)
    assert math.isclose(got["c"], 2 / math.comb(20, 10))


def dense_chi(table, yates):
    o = np.array(table, float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    if yates and o.shape == (2, 2):
        d = np.maximum(d - 0.5, 0)
    return (d**2 / e).sum(), e.min()


@pytest.mark.parametrize("table", [[[10, 20], [30, 40]], [[8, 0], [3, 5]], [[5, 1, 7], [2, 9, 4], [0, 3, 8]], [[1, 1], [1, 1]]])
def test_chi_square_matches_dense(spark, table):
    rows = [("k", f"r{i}", f"c{j}", n) for i, row in enumerate(table) for j, n in enumerate(row) if n]
    cells = spark.createDataFrame(rows, "key string, x string, y string, n long")
    for x, y in (("x", "y"), ("y", "x")):
        got = chi_square(cells, ["key"], x, y).first()
        chi, low = dense_chi(table, True)
        assert math.isclose(got["chi_square"], chi, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got["min_expected"], low)
        assert got["min_observed"] == min(min(r) for r in table)
    if len(table) == 2:
        assert [chi_square(cells, ["key"], "x", "y").first()[c] for c in "abcd"] == [n for r in table for n in r]


def test_binary_tests_equal_general_kernel(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.choice(list("abc"), 500), "h": rng.choice(["u", "v"], 500), "y": rng.integers(0, 2, 500)}))
    fast = {r["attribute"]: r for r in binary_tests(group_rates(df, ["g", "h"], "y"), ["attribute"]).collect()}
    cells = to_long(df, ["g", "h"], ["y"]).groupBy("attribute", "grp", "y").agg(F.count("*").alias("n"))
    for r in chi_square(cells, ["attribute"], "grp", "y").collect():
        f = fast[r["attribute"]]
        assert math.isclose(r["chi_square"], f["chi_square"], rel_tol=1e-9)
        assert all(r[c] == f[c] for c in ("n", "r", "k", "dof", "a", "b", "c", "d", "min_observed"))


def test_association_edges(spark):
    one = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1)], "g string, y int")
    got = binary_tests(group_rates(one, ["g"], "y"), ["attribute"]).first()
    assert (got["dof"], got["chi_square"], got["cramers_v"]) == (0, 0.0, 0.0)
    same = spark.createDataFrame([("a", 1), ("b", 1)], "g string, y int")
    got = with_p(binary_tests(group_rates(same, ["g"], "y"), ["attribute"]), ["attribute"], F.col("min_expected") < 5).first()
    assert (got["k"], got["cramers_v"], got["p_value"]) == (1, 0.0, 1.0)
    copy = spark.createDataFrame([("a", 1)] * 50 + [("b", 0)] * 50, "g string, y int")
    cells = to_long(copy, ["g"], [F.col("y").cast("string").alias("y")]).groupBy("attribute", "grp", "y").agg(F.count("*").alias("n"))
    assert math.isclose(chi_square(cells, ["attribute"], "grp", "y", yates=False).first()["cramers_v"], 1.0)
    assert group_rates(one.limit(0), ["g"], "y").count() == 0


@pytest.mark.parametrize("bits", [8, 16])
def test_quantiles_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = np.random.default_rng(2)
    n = 6000
    heavy = np.where(rng.random(n) < 0.4, 7.25, rng.lognormal(1, 2, n))
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": heavy, "c": rng.integers(0, 4, n).astype(float), "d": np.nan, "e": 3.0})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0, 0.05, 0.2, 0.37, 0.5, 0.8, 0.999, 1]
    got = quantiles.exact_quantiles(df, list("abcde"), probs)
    for c in "abce":
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12, atol=0), c
    assert got["d"] is None
    edges = quantiles.bin_edges(df, ["a", "c", "e"])
    assert edges["c"] is None and edges["e"] is None and len(edges["a"]) == 6
    assert quantiles.bin_edges(df, ["c"], keep_discrete=0)["c"] is not None


def test_quantiles_by_digits_alone(spark, monkeypatch):
    """No column is counted outright: ties, signs, the smallest and the largest doubles."""
    monkeypatch.setattr(quantiles, "_FEW", -1)
    rng = np.random.default_rng(7)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53]
    pdf = pd.DataFrame({"a": rng.choice(odd, 3000), "b": rng.normal(0, 1e-3, 3000) ** 3, "c": np.where(rng.random(3000) < 0.34, -2.5, rng.integers(-9, 9, 3000)), "d": 1e15 + rng.integers(0, 3, 3000)})
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(7), list("abcd"), [i / 2999 for i in range(0, 3000, 211)])
    for c in "abcd":
        assert got[c] == pytest.approx(np.sort(pdf[c])[::211], rel=1e-15, abs=0), c


def test_order_keys_are_ieee_bits(spark):
    rng = np.random.default_rng(8)
    powers = np.exp2(np.arange(-1074, 1024))
    values = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), rng.integers(0, 2**63, 5000).view(np.float64), [0.0, np.inf]])
    values = values[~np.isnan(values)]
    values = np.concatenate([values, -values])
    rows = quantiles.with_order_key(spark.createDataFrame(pd.DataFrame({"x": values})), "x", "k").toPandas()
    bits = np.abs(rows["x"].to_numpy()).view(np.int64)
    assert (rows["k"].to_numpy() == np.where(rows["x"] < 0, -bits, bits)).all()
    assert all(quantiles.key_value(k) == x for k, x in zip(rows["k"], rows["x"]))


def test_quantiles_tiny(spark):
    for vals in ([3.0], [1.0, 2.0], [3.0, 1.0, 2.0, 10.0]):
        got = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"], [0, 0.1, 0.4, 0.5, 0.9, 1])
        assert np.allclose(got["x"], np.quantile(vals, [0, 0.1, 0.4, 0.5, 0.9, 1]))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("piece_rows", [20, 10**6])
def test_running_sums(spark, monkeypatch, piece_rows, descending):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece_rows)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 800, p=[0.9, 0.1]), "p": np.round(rng.beta(0.3, 4, 800), 3)}).drop_duplicates()
    pdf["n"] = rng.integers(1, 9, len(pdf))
    df = spark.createDataFrame(pdf)
    got = ordered.running_sums(ordered.add_piece(df, "p", ordered.cut_points(df, "p")), ["k"], "p", ["n"], descending).toPandas()
    want = pdf.sort_values("p", ascending=not descending)
    want = want.assign(run=want.groupby("k")["n"].cumsum(), nxt=want.groupby("k")["p"].shift(-1))
    both = got.merge(want, on=["k", "p"])
    assert len(both) == len(pdf)
    assert (both["run_n"] == both["run"]).all()
    assert ((both["next_value"] == both["nxt"]) | (both["next_value"].isna() & both["nxt"].isna())).all()


def test_first_by_hash(spark):
    import hashlib

    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = ordered.first_by_hash(df, "id", "y", lambda n: F.floor(n * 0.3), "42").toPandas()
    for _, part in got.groupby("y"):
        order = sorted(part["id"], key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
        assert set(part[part["_first"]]["id"]) == set(order[: int(len(order) * 0.3)])
    none = ordered.first_by_hash(df, "id", "y", lambda n: F.lit(0), "42")
    assert none.filter("_first").count() == 0


@pytest.mark.parametrize("cell_rows", [40, 100000])
def test_nearest_is_exact(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "_CELL_ROWS", cell_rows)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(5, 0.1, size=(100, 2)), np.tile([[9.0, 9.0]], (200, 1))])  # a third are copies
    pdf = pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})
    got = neighbours.nearest(spark.createDataFrame(pdf).repartition(6), "id", ["a", "b"], 4).toPandas().sort_values(["id", "rank"])
    diff = x[:, None, :] - x[None, :, :]
    dist = np.sqrt(diff[..., 0] * diff[..., 0] + diff[..., 1] * diff[..., 1])
    np.fill_diagonal(dist, np.inf)
    for i, part in got.groupby("id"):
        want = sorted(range(len(x)), key=lambda j: (dist[i, j], j))[:4]
        assert part["neighbour"].tolist() == want
        assert np.allclose(part["distance"], dist[i, want])


@pytest.mark.parametrize("cell_rows", [12, 2000])
def test_nearest_by_class(spark, monkeypatch, cell_rows):
    """All classes in one search: ties, a discrete axis, a class of one row, rows without a class."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbours, "_BITS", 2)
    rng = np.random.default_rng(6)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), "c": rng.choice(["p", "q", None], n, p=[0.7, 0.2, 0.1]), "a": rng.integers(0, 3, n).astype(float), "b": rng.integers(0, 40, n) / 4})
    pdf.loc[0, "c"] = "alone"
    got = neighbours.nearest(spark.createDataFrame(pdf).repartition(5), "id", ["a", "b"], 3, by="c").toPandas().sort_values(["id", "rank"])
    want = []
    for i, r in pdf.iterrows():
        own = pdf[(pdf.c == r.c) & (pdf.id != i)] if r.c else pdf[:0]
        d = np.sqrt((own.a - r.a) * (own.a - r.a) + (own.b - r.b) * (own.b - r.b))
        want += [(i, j, x, k + 1) for k, (x, j) in enumerate(sorted(zip(d, own.id))[:3])]
    assert [tuple(r) for r in got[["id", "neighbour", "distance", "rank"]].itertuples(index=False)] == want


@pytest.mark.parametrize("cell_rows", [9, 2000])
def test_nearest_in_other_groups(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "_CELL_ROWS", cell_rows)
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["x", "y", "z", None], n, p=[0.6, 0.2, 0.1, 0.1]), "a": np.where(rng.random(n) < 0.3, 1.0, rng.normal(size=n).round(2)), "b": rng.integers(0, 4, n).astype(float)})
    got = neighbours.nearest_in_other_groups(spark.createDataFrame(pdf), "id", "g", ["a", "b"]).toPandas().sort_values("id")
    want = []
    for i, r in pdf[pdf.g.notna()].iterrows():
        own = pdf[pdf.g.notna() & (pdf.g != r.g)]
        d = np.sqrt((own.a - r.a) * (own.a - r.a) + (own.b - r.b) * (own.b - r.b))
        want.append((i, r.g, *min(zip(d, own.id))[::-1]))
    assert [tuple(r) for r in got[["id", "grp", "neighbour", "distance"]].itertuples(index=False)] == want
    assert neighbours.nearest_in_other_groups(spark.createDataFrame(pdf[pdf.g == "x"]), "id", "g", ["a"]).count() == 0


def test_cells_are_bounded(spark, monkeypatch):
    """Skewed and discrete vectors: every cell is cut until it fits, and no vector is lost."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 50)
    rng = np.random.default_rng(5)
    x = np.unique(np.vstack([rng.lognormal(0, 3, (3000, 2)), np.column_stack([np.ones(2000), rng.random(2000)]), rng.integers(0, 30, (2000, 2))]), axis=0)
    df = spark.createDataFrame([("t", str(i), v.tolist()) for i, v in enumerate(x)], "tree string, vid string, x array<double>")
    placed, rounds = neighbours._grown(df)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) <= 50 and len(rounds) > 1


def test_rows_that_do_not_ask_search_nothing(spark, monkeypatch):
    """Some rows ask, in one class: their neighbours are those of the search of all, the other class is not cut into cells at all."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 30)
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": np.arange(600), "c": np.where(np.arange(600) % 3, "p", "q"), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    df, trees, cells = spark.createDataFrame(pdf), [], neighbours._grown
    every = neighbours.nearest(df, "id", ["a", "b"], 3, by="c").filter("id % 30 = 0")
    monkeypatch.setattr(neighbours, "_grown", lambda points: trees.extend(r[0] for r in points.select("tree").distinct().collect()) or cells(points))
    some = neighbours.nearest(df, "id", ["a", "b"], 3, by="c", asking=df.filter("id % 30 = 0"))
    assert sorted(some.collect()) == sorted(every.collect()) and some.count() == 60
    assert trees == ["q"]


def test_groups_far_apart_and_a_question_a_vector(spark, monkeypatch):
    """Cells of one group: their vectors ask the other groups' trees; where cells are mixed a vector asks once, not once a group."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 40)
    asked, met = [], neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda q, *rest: asked.append(q.count()) or met(q, *rest))
    rng = np.random.default_rng(13)
    for shift in (0.0, 100.0):
        g = np.arange(500) % 5
        pdf = pd.DataFrame({"id": np.arange(500), "g": [f"g{i}" for i in g], "a": rng.normal(size=500) + shift * g, "b": rng.normal(size=500)})
        x = pdf[["a", "b"]].to_numpy()
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        dist[g[:, None] == g[None]] = np.inf
        asked.clear()
        got = neighbours.nearest_in_other_groups(spark.createDataFrame(pdf), "id", "g", ["a", "b"]).toPandas().sort_values("id")
        assert got["neighbour"].tolist() == dist.argmin(axis=1).tolist() and np.allclose(got["distance"], dist.min(axis=1))
        assert asked[0] == 500 and (shift or len(asked) == 2)


@pytest.mark.parametrize("want", [1, 6])
def test_blocks_of_a_cell(want):
    """Blocks against brute force: ties, copies of coordinates, one row, labels, limits."""
    rng = np.random.default_rng(14)
    for n, m in ((700, 900), (1, 50), (50, 1)):
        q, p = np.round(rng.normal(size=(n, 3)), 1), np.round(rng.normal(size=(m, 3)), 1)
        ql, pl, limit = rng.integers(0, 3, n), rng.integers(0, 3, m), np.where(rng.random(n) < 0.2, 0.3, np.inf)
        dist = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
        dist[ql[:, None] == pl[None]] = np.inf
        last = np.minimum(np.sort(dist, axis=1)[:, min(want, m) - 1], limit)
        row, col, far = neighbours._pairs(q, limit, p, want, ql, pl)
        wanted = {(i, j) for i, j in zip(*np.nonzero((dist <= last[:, None] + 1e-12) & np.isfinite(dist)))}
        assert wanted <= set(zip(row, col)) and len(set(zip(row, col))) == len(row) and np.allclose(far, dist[row, col])


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, a double")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, "id", ["a"], 5).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}


def test_fisher_of_large_and_odd_tables():
    from math import comb

    from evenhand.functions.pvalues import fisher_two_sided

    def brute(a, b, c, d):
        low, high, t = max(0, a - d), min(a + b, a + c), a + b + c + d
        w = {x: comb(a + b, x) * comb(c + d, a + c - x) for x in range(low, high + 1)}
        return sum(v for v in w.values() if v * 10**7 <= w[a] * (10**7 + 1)) / comb(t, a + c)

    rng = np.random.default_rng(4)
    for cells in [(0, 0, 0, 0), (5, 0, 0, 5), (1, 0, 0, 0), (0, 3, 4, 0), (400, 350, 380, 360), *rng.integers(0, 60, (40, 4)).tolist()]:
        assert np.isclose(fisher_two_sided(*cells), brute(*cells), rtol=1e-9)
    assert 0.9 < fisher_two_sided(2_500_000, 2_500_000, 2_500_000, 2_500_000) <= 1
    assert 0 < fisher_two_sided(25_000_500, 25_000_000, 25_000_000, 25_000_500) < 1 and fisher_two_sided(10**6, 0, 0, 10**6) == 0


def test_row_numbers_over_pieces(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, "hot").alias("k"), F.md5(F.col("id").cast("string")).alias("o"))
    got = ordered.row_numbers(rows, ["k"], ["o"], "i").collect()
    for key in ("hot", None):
        mine = sorted((r.o, r.i) for r in got if r.k == key)
        assert [i for _, i in mine] == list(range(1, len(mine) + 1))


def test_largest_eigenpairs_match_a_dense_solver(spark):
    """Sparse table against numpy: with room, with restarts, repeated eigenvalues, more dimensions than rank, no rows."""
    from evenhand.plans.eigen import largest_eigenpairs

    rng = np.random.default_rng(5)
    first = rng.integers(0, 10, 400)
    second = np.where(rng.random(400) < first / 10, first, rng.integers(0, 10, 400))
    rows = np.stack([first, 10 + second, 20 + (first + rng.integers(0, 4, 400)) % 10], axis=1)
    z = np.zeros((400, 30))
    z[np.arange(400)[:, None], rows] = 1
    z = z[:, z.sum(0) > 0]
    m = z.sum(0) / z.sum()
    dense = (z.T @ z / (400 * 9)) / np.sqrt(np.outer(m, m))
    want = np.linalg.eigvalsh(dense - np.outer(np.sqrt(m), np.sqrt(m)))[::-1]
    at = np.argwhere(dense != 0)
    cells = spark.createDataFrame([(f"{a:03}", f"{b:03}", float(dense[a, b])) for a, b in at], "a string, b string, v double")
    keys = spark.createDataFrame([(f"{a:03}", float(np.sqrt(x))) for a, x in enumerate(m)], "key string, s double")
    for dims, width, tolerance in ((3, 96, 1e-9), (2, 18, 1e-4)):  # the second starts again from its best vectors
        vectors, values, residuals = largest_eigenpairs(cells, keys, dims, width=width, tolerance=tolerance, rounds=12)
        assert np.allclose(values, want[:dims], atol=max(1e-8, tolerance**2)) and (residuals <= tolerance * values[0]).all()
        x = np.array([r.x for r in vectors.orderBy("key").collect()])
        assert np.allclose(x.T @ x, np.eye(dims), atol=1e-8)
        assert np.allclose((dense - np.outer(np.sqrt(m), np.sqrt(m))) @ x, x * values, atol=max(1e-7, tolerance))
    # three equal blocks: every eigenvalue three times, rank 3
    cells = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(4) for j in range(4)], "a string, b string, v double")
    keys = spark.createDataFrame([(f"{g}{i}", 0.0) for g in "abc" for i in range(4)], "key string, s double")
    assert np.allclose(largest_eigenpairs(cells, keys, 5)[1], [4, 4, 4])
    vectors, values, _ = largest_eigenpairs(cells.limit(0), keys.limit(0), 2)
    assert vectors.count() == 0 and len(values) == 0
    assert len(largest_eigenpairs(cells.limit(0), keys, 2)[1]) == 0  # all cells zero
