import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wordloom.operators import ordering, paths


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(240):
        x = [rng.gauss(0, 1) for _ in range(5)]
        x[4] = 0.7 * x[0] + 0.3 * x[4]
        p = 1 / (1 + math.exp(-(1.5 * x[0] - 1.0 * x[2] - 0.8)))
        out.append((i, [*x, float("nan") if i == 3 else 2.5], int(rng.random() < p), 2 * x[1] - x[3] + rng.gauss(0, 0.3)))
    return spark.createDataFrame(out, "id long, x array<double>, y int, z double").cache()


def numpy_rows(rows):
    r = sorted(rows.collect(), key=lambda r: r.id)
    x = np.nan_to_num(np.array([v.x for v in r]))
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1), np.array([v.y for v in r]), np.array([v.z for v in r]), [v.id for v in r]


def test_places_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(5)
    got = {(r.a, r.b): r.place for r in ordering.places(df, ["a", "b"]).collect()}
    assert [got[a, b] for a, b, _ in sorted(rows)] == list(range(700))
    s = {(r.a, r.b): r.upto for r in ordering.running(df, ["a", "b"], {"upto": "v"}).collect()}
    assert [s[a, b] for a, b, _ in sorted(rows)] == np.cumsum([v for *_, v in sorted(rows)]).tolist()
    assert ordering.places(df.where("false"), ["a"]).count() == 0


def test_coefficients_equal_single_fits(spark, rows):
    x, y, _, ids = numpy_rows(rows)
    fold = [i % 3 for i in ids]
    d = rows.withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("ys", F.array(F.col("y").cast("double")))
    std, _, _ = paths.standardised(d)
    models, weights = [], {}
    for f in (-1, 0, 1, 2):
        part = np.array([k != f for k in fold])
        n, pos = int(part.sum()), int(y[part].sum())
        weights |= {(0, f, 1): n / (2 * pos), (0, f, 0): n / (2 * (n - pos))}
        models += [paths.Model("all", 0, f, 1 / (c * n), k) for k, c in enumerate((0.05, 1.0, 10.0))]
    got = paths.solve(std, "classification", models, {"all": np.ones(7, bool)}, weights, 6)
    for m, b in list(zip(models, got, strict=True))[::2]:
        part = [k for k in range(len(ids)) if fold[k] != m.fold]
        one = spark.createDataFrame([(*map(float, x[k]), int(y[k]), weights[0, m.fold, int(y[k])]) for k in part], [*[f"x{j}" for j in range(6)], "y", "w"])
        v = VectorAssembler(inputCols=[f"x{j}" for j in range(6)], outputCol="v").transform(one)
        fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", elasticNetParam=1.0, regParam=m.penalty, standardization=False, maxIter=500, tol=1e-10).fit(v)
        assert b[:-1] == pytest.approx(fit.coefficients.toArray(), abs=1e-4) and b[-1] == pytest.approx(fit.intercept, abs=1e-4)


def lasso(x, z, penalty):
    b, c = np.zeros(x.shape[1]), z.mean()
    for _ in range(3000):
        for j in range(len(b)):
            r = z - c - x @ b + x[:, j] * b[j]
            rho, d = x[:, j] @ r / len(z), x[:, j] @ x[:, j] / len(z)
            b[j] = np.sign(rho) * max(0, abs(rho) - penalty) / d if d > 1e-12 else 0.0
        c = (z - x @ b).mean()
    return b, c


def test_lasso_path_with_folds_equals_brute_force(rows):
    x, _, z, ids = numpy_rows(rows)
    d = paths.folds_of(rows.withColumn("ys", F.array("z")), 3, time_ordered=True)
    assert [r.fold for r in d.orderBy("id").collect()] == [i // 80 for i in range(240)]
    heads, _, _ = paths.fit_heads(d, "regression", {"all": list(range(6)), "two": [0, 1]}, 3)
    path = np.abs(x.T @ (z - z.mean())).max() / 240 * np.logspace(0, -3, 30)
    losses = []
    for p in path[::6]:
        each = []
        for f in range(3):
            part = np.array([i // 80 != f for i in ids])
            b, c = lasso(x[part], z[part], p)
            each.append(((z[~part] - c - x[~part] @ b) ** 2).mean())
        losses.append(np.mean(each))
    h = heads["all", 0]
    b, c = lasso(x, z, h.strength)
    assert h.coef == pytest.approx(b, abs=1e-4) and h.intercept == pytest.approx(c, abs=1e-4)
    assert min(abs(h.strength / path - 1)) < 1e-6 and h.strength <= path[::6][int(np.argmin(losses))] * (path[0] / path[6])
    assert all(v == 0 for v in heads["two", 0].coef[2:]) and heads["two", 0].coef[1] > 1


def test_shuffled_targets_are_permutations(rows):
    got = paths.shuffled(rows, "z", 2, 0).collect()
    own = sorted(r.z for r in got)
    for k in (1, 2):
        assert sorted(r.ys[k] for r in got) == own and sum(r.ys[k] == r.z for r in got) < 20
    again = {r.id: r.ys for r in paths.shuffled(rows.repartition(3), "z", 2, 0).collect()}
    assert all(again[r.id] == r.ys for r in got)


def test_too_few_failures_abstain(rows):
    d = rows.withColumn("ys", F.array((F.col("id") == 5).cast("double"))).withColumn("fold", (F.col("id") % 3).cast("int"))
    heads, mean, sd = paths.fit_heads(d, "classification", {"all": list(range(6))}, 3, (1.0,))
    assert heads["all", 0].constant == pytest.approx(1 / 240) and heads["all", 0].n_nonzero == 0
    assert {round(r.score, 9) for r in paths.score(rows, [("all", heads["all", 0])], "classification", mean, sd).collect()} == {round(1 / 240, 9)}


def test_readout_refits_on_permuted_targets(rows):
    fit, test = rows.where("id % 2 = 0").withColumn("target", F.col("y")), rows.where("id % 2 = 1").withColumn("loss", F.col("y").cast("double")).withColumn("conf", F.get("x", F.lit(1)))
    heads = {"statistics": [1, 3], "symbolic": [0, 2, 4], "fm_signal+symbolic": [0, 1, 2, 4]}
    summary, report = paths.readout(fit, test, "classification", heads, "conf", 3, 6, strengths=(0.1, 1.0))
    rows_ = {r["name"]: r for r in summary.collect()}
    assert set(rows_) == {*heads, "conf", "random", "rank:conf+statistics", "rank:conf+symbolic"}
    assert rows_["symbolic"].aurc < rows_["random"].aurc and rows_["symbolic"].aurc == report["observed_aurc"]
    assert len(set(report["null_aurc"])) > 1 and report["p_value"] == pytest.approx(1 / 7) and report["head_sparsity"]["statistics"]["n_features"] == 2
    assert {("c", "lowers_risk")} < {(t, d) for t, _, d in paths.top_terms(report["heads"]["symbolic"], list("abcdef"))} <= {("a", "raises_risk"), ("c", "lowers_risk"), ("e", "raises_risk")}


def test_direct_steps_reach_the_least_value_of_descent():
    """Coordinates that hang together: descent alone took thousands of sweeps."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(300, 12)), np.ones(300)])
    x[:, :6] += 3 * x[:, [7]]
    g, h, penalty = x.T @ rng.normal(size=300) / 300, x.T @ x / 300, 0.02
    got, want, r = paths.penalised(g, h, np.zeros(13), penalty), np.zeros(13), g.copy()
    for _ in range(20_000):
        for j in range(13):
            z = want[j] - r[j] / h[j, j]
            new = z if j == 12 else np.sign(z) * max(0.0, abs(z) - penalty / h[j, j])
            r, want[j] = r + h[:, j] * (new - want[j]), new
    assert got == pytest.approx(want, abs=1e-6) and 0 < (got[:12] == 0).sum() < 12


def test_folds_of_each_permutation_have_its_classes_alike(spark, rows):
    """The null's folds were those of the true target, whose classes say nothing of a permutation's."""
    d = paths.folds_of(rows, 4, target="y")
    got = paths.shuffled(d, "y", 3, 0, n_folds=4).collect()
    own = {r.id: r.fold for r in d.collect()}
    assert all(r.fold[0] == own[r.id] and len(r.fold) == len(r.ys) == 4 for r in got)
    for t in range(4):
        for c in (0.0, 1.0):
            n = [sum(r.fold[t] == f and r.ys[t] == c for r in got) for f in range(4)]
            assert max(n) - min(n) <= 1 and sum(n) == sum(r.y == c for r in got)


def test_few_failures_are_dealt_to_fewer_folds(rows):
    d = rows.withColumn("target", (F.col("id") < 3).cast("int"))
    summary, report = paths.readout(d, d.withColumn("loss", F.col("target").cast("double")).withColumn("conf", F.rand(1)), "classification", {"symbolic": [0, 2]}, "conf", 5, 1, strengths=(0.1,))
    assert report["head_sparsity"]["symbolic"]["abstained_constant"] is False and len(summary.first()["curve"]) == 20
    top = report["examples"]
    assert len(top) == 6 and [r.risk for r in top] == sorted((r.risk for r in top), reverse=True)
    h = report["heads"]["symbolic"]
    assert [1 / (1 + math.exp(-h.intercept - sum(r.parts))) for r in top] == pytest.approx([r.risk for r in top], abs=1e-9)
