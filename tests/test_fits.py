"""Batched regressions, permutations that refit, and residuals against NumPy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.operators import fits, models, stats
from prosemill.operators.fits import Fit
from prosemill.operators.residuals import Residualizer, ResidualizerModel


def table(rng, n=400):
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 100] + [0, 3, -1, 1000]
    x[:, 3] += 40 * x[:, 1]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 3) + rng.normal(size=n) > 0).astype(int)
    g = rng.integers(0, 40, n)
    return x, y, g


@pytest.fixture(scope="module")
def data(spark):
    x, y, g = table(np.random.default_rng(3))
    rows = [(i, *map(float, r), 7.0, int(t), int(k), int(k) % 5, int(k) % 3) for i, (r, t, k) in enumerate(zip(x, y, g, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, flat double, y int, grp int, fold int, three int"), x, y, g


def standard(x, train):
    return (x - x[train].mean(axis=0)) / x[train].std(axis=0, ddof=1)


def newton(z, y, c=1.0, steps=40):
    z = np.column_stack([np.ones(len(z)), z])
    b, ridge = np.zeros(z.shape[1]), np.r_[0, np.ones(z.shape[1] - 1)] / c
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
    return b


def test_many_sets_and_folds_equal_numpy(data):
    df, x, y, g = data
    cols = "abcd"
    sets = {"all": "abcd", "few": "ca", "one": "b"}
    made = fits.fit_all(df, [*(Fit(n, tuple(s)) for n, s in sets.items()), Fit("flat", ("a", "flat"))], "fold")
    assert len(made.weights) == 20
    scored = {r["id"]: r for r in made.scored(df).collect()}
    for n, s in sets.items():
        m = x[:, [cols.index(k) for k in s]]
        for k in range(5):
            train = g % 5 != k
            z = standard(m, train)
            b = newton(z[train], y[train])
            want = b[0] + z @ b[1:]
            for i in np.flatnonzero(~train):
                assert math.isclose(scored[i][f"z__{n}"], want[i], rel_tol=1e-6, abs_tol=1e-7)
    assert all(math.isfinite(r["z__flat"]) for r in scored.values())
    p = made.predicted(df, {"all": "p", "one": "q"}).collect()
    assert len(p) == len(y) and all(r["p"] == int(scored[r["id"]]["z__all"] > 0) for r in p)


def test_covariates_are_taken_out_by_the_training_rows(data):
    df, x, y, g = data
    made = fits.fit_all(df, [Fit("r", ("a", "b"), covs=("d", "c"))], "fold")
    scored = {r["id"]: r["z__r"] for r in made.scored(df).collect()}
    one = np.column_stack([np.ones(len(x)), x[:, [3, 2]]])
    for k in range(5):
        train = g % 5 != k
        r = x[:, :2] - one @ np.linalg.lstsq(one[train], x[train][:, :2], rcond=None)[0]
        z = standard(r, train)
        b = newton(z[train], y[train])
        for i in np.flatnonzero(~train):
            assert math.isclose(scored[i], b[0] + z[i] @ b[1:], rel_tol=1e-6, abs_tol=1e-7)


def test_more_classes_meet_the_first_order_conditions(data):
    df, x, _, g = data
    made = fits.fit_all(df, [Fit("m", ("a", "b", "d"), "three", classes=3)], "fold")
    k = 2
    train = g % 5 != k
    w = made.weights["m", k]
    s = w[:, :1].T + x[:, [0, 1, 3]] @ w[:, 1:].T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = (g % 3)[:, None] == np.arange(3)
    z = np.column_stack([np.ones(len(x)), standard(x[:, [0, 1, 3]], train)])
    beta, _ = made.standard["m", k]
    slope = z[train].T @ (hit - p)[train] - np.r_[0, 1, 1, 1][:, None] * beta.T
    assert np.abs(slope).max() < 1e-5
    rows = made.predicted(df, {"m": "p"}).collect()
    assert len(rows) == len(x) and {r["p"] for r in rows} <= {0, 1, 2}


def test_odd_rows_and_missing_classes(spark, data):
    df, *_ = data
    odd = df.withColumn("a", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("a")))
    made = fits.fit_all(odd, [Fit("all", ("a", "b"))], "fold")
    kept = fits.fit_all(odd.where("id % 9 > 1"), [Fit("all", ("a", "b"))], "fold")
    assert all(np.allclose(made.weights[k], kept.weights[k]) for k in kept.weights)
    assert made.predicted(odd, {"all": "p"}).where("a IS NULL").count() == 0
    one = fits.fit_all(df.withColumn("y", F.lit(1)), [Fit("all", ("a",))], "fold")
    assert one.weights == {} and one.predicted(df, {"all": "p"}).count() == 0
    none = fits.fit_all(df.limit(0), [Fit("all", ("a",))])
    assert none.weights == {} and none.scored(df).where("z__all IS NOT NULL").count() == 0
    apart = df.withColumn("a", F.col("y").cast("double"))  # the label itself: the penalty keeps the weights finite
    assert models.oof_accuracy(apart, ["a"]) == 1.0


def labels_of(groups, seed, r):
    import hashlib

    h = sorted((int(hashlib.md5(f"{seed}:{r}:{g}".encode()).hexdigest()[:8], 16), g) for g in groups)
    ones = sum(groups.values())
    return {g: int(i < ones) for i, (_, g) in enumerate(h)}


def test_permutations_refit_like_numpy(spark, data):
    _, x, _, g = data
    y = (g * 7 % 11 < 5).astype(int)
    m = x[:, :2] + 0.6 * y[:, None]
    df = spark.createDataFrame([(float(a), float(b), int(t), str(k), int(k) % 3) for (a, b), t, k in zip(m, y, g, strict=True)], "a double, b double, y int, grp string, fold int")
    reps = 70  # more than a chunk
    got = stats.group_permutation_test(df, ["a", "b"], "grp", "y", replicates=reps).first()
    groups = {str(k): int(t) for k, t in zip(g, y, strict=True)}

    def accuracy(of):
        t = np.array([of[str(k)] for k in g])
        out = []
        for k in range(3):
            train = g % 3 != k
            if len(set(t[train])) < 2:
                return None
            z = standard(m, train)
            b = newton(z[train], t[train])
            hit = (b[0] + z[~train] @ b[1:] > 0).astype(int) == t[~train]
            out.append(np.mean([hit[t[~train] == v].mean() for v in (0, 1) if (t[~train] == v).any()]))
        return np.mean(out)

    real = accuracy(groups)
    draws = [accuracy(labels_of(groups, 0, r)) for r in range(reps)]
    draws = [d for d in draws if d is not None]
    assert math.isclose(got["ba"], real, rel_tol=1e-9) and got["draws"] == len(draws)
    assert math.isclose(got["p_value"], (sum(d >= real - 1e-12 for d in draws) + 1) / (len(draws) + 1), rel_tol=1e-9)


def test_permuted_labels_keep_their_number(spark):
    groups = spark.createDataFrame([(f"g{i}", int(i % 3 == 0)) for i in range(500)], "grp string, y int")
    rows = stats.permuted_labels(groups, "grp", "y", 25, 4).collect()
    n = np.array([r["labels"] for r in rows])
    assert n.shape == (500, 26) and set(n.sum(axis=0)) == {167} and len({tuple(c) for c in n.T}) == 26
    want = labels_of({r["grp"]: r["y"] for r in rows}, 4, 6)
    assert all(r["labels"][7] == want[r["grp"]] for r in rows)
    same = groups.withColumn("y", F.lit(0))
    assert all(sum(r["labels"]) == 0 for r in stats.permuted_labels(same, "grp", "y", 3, 0).collect())


def test_residualizer_is_fitted_saved_and_applied(spark, data, tmp_path):
    df, x, *_ = data
    dev, held = df.where("fold > 0"), df.where("fold = 0")
    model = Residualizer(featureCols=["a", "b"], covariateCols=["d", "c", "flat"], outputCols=["ra", "rb"]).fit(dev)
    model.write().save(str(tmp_path / "m"))
    back = ResidualizerModel.load(str(tmp_path / "m"))
    train = np.array([r["id"] for r in dev.collect()])
    one = np.column_stack([np.ones(len(x)), x[:, [3, 2]]])
    want = x[:, :2] - one @ np.linalg.lstsq(one[train], x[train][:, :2], rcond=None)[0]
    for r in back.transform(held).collect():
        assert np.allclose([r["ra"], r["rb"]], want[r["id"]], atol=1e-7) and r["a"] == x[r["id"], 0]
    gone = back.transform(held.withColumn("d", F.lit(None).cast("double"))).where("ra IS NOT NULL")
    assert gone.count() == 0
    over = Residualizer(featureCols=["a"], covariateCols=[]).fit(dev.limit(0)).transform(held)
    assert [r["a"] for r in over.collect()] == [r["a"] for r in held.collect()]


def test_a_merged_band_is_folded_anew(spark, data):
    df, *_ = data
    d = df.select("id", "a", F.concat(F.lit("s"), F.col("three").cast("string")).alias("grp"), "y", "fold")
    e = models.merged_band(d, F.col("id") % 4 == 0, 1, "grp", "s1", "id")
    rows = e.collect()
    assert len(rows) == d.count() and all(r["y"] == 1 for r in rows if r["band"])
    assert {r["grp"] for r in rows if r["band"]} == {"s0", "s2", *(f"s1_{i}" for i in range(5))}
    folds = {}
    assert all(folds.setdefault(r["perm_group"], r["fold"]) == r["fold"] for r in rows)
    was = {r["id"]: (r["y"], r["fold"]) for r in d.collect()}
    assert any(was[r["id"]][0] != r["y"] for r in rows) and any(was[r["id"]][1] != r["fold"] for r in rows)


def test_importances_of_several_fits_rank_numbers_only(spark, data, monkeypatch):
    df, x, y, g = data
    d = df.withColumns({"y__p": F.when(F.col("three") < 2, F.col("y")), "y__q": F.col("y")})
    ranked, plain = [], models._hash_ranks
    monkeypatch.setattr(models, "_hash_ranks", lambda rows, *a: ranked.append(rows.columns) or plain(rows, *a))
    made = fits.fit_all(d, [Fit(n, tuple("abd"), f"y__{n}") for n in "pq"])
    got = {(r["name"], r["feature"]): r["importance"] for r in models.permutation_importances(made, d, {n: f"y__{n}" for n in "pq"}, list("abd"), "id", 3).collect()}
    assert all(set(c) == {"key", "row", "m", "r"} for c in ranked)
    three = np.array([r["three"] for r in df.orderBy("id").select("three").collect()])
    for n, m in (("p", three < 2), ("q", three < 3)):
        rows = np.flatnonzero(m)
        w = made.weights[n, None][0]
        z = w[0] + x[rows] @ np.array([w[1 + made.cols.index(c)] if c in made.cols else 0 for c in "abcd"])
        ba = lambda s: np.mean([(s[y[rows] == 0] <= 0).mean(), (s[y[rows] == 1] > 0).mean()])  # noqa: E731, B023
        order = lambda s, r: sorted(range(len(rows)), key=lambda i: (int(hashlib.md5(f"{s}:{r}:{rows[i]}".encode()).hexdigest()[:8], 16), rows[i]))  # noqa: E731, B023
        for c in "abd":
            v, losses = x[rows, "abcd".index(c)], []
            for r in range(3):
                s = np.empty(len(rows))
                s[order(0, r)] = v[order(1, r)]
                losses.append(ba(z) - ba(z + w[1 + made.cols.index(c)] * (s - v)))
            assert math.isclose(got[n, c], np.mean(losses), abs_tol=1e-9)


def test_draws_by_pair_equal_those_of_each(spark, data):
    df = data[0].withColumns({"p": F.col("y"), "q": (F.col("a") > 0).cast("int")})
    by = {(r["three"], r["replicate"]): (r["p"], r["q"]) for r in stats.group_bootstrap_by(df, "three", "grp", ["p", "q"], 20, 0).collect()}
    for k in range(3):
        one = stats.group_bootstrap(df.where(F.col("three") == k), "grp", ["p", "q"], 20, 0).collect()
        assert {(k, r["replicate"]): (r["p"], r["q"]) for r in one} == {x: v for x, v in by.items() if x[0] == k}
