import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import mining as G
from wordloom.operators import novelty as N
from wordloom.operators import retrieval as T
from wordloom.operators import rules as R
from wordloom.operators import windows as X
from wordloom.sources import formats as S


def test_split_of_one_value(spark):
    d = spark.createDataFrame([(0, 3.0, 0, 2), (0, 3.0, 1, 1)], "feature int, value double, label int, n long")
    r = G.best_splits(d).first()
    assert (r.ig, r.threshold, r.gap) == (0.0, 3.0, 0.0)


def test_perfect_split(spark):
    d = spark.createDataFrame([(0, 1.0, 0, 1), (0, 2.0, 0, 1), (0, 8.0, 1, 1), (0, 10.0, 1, 1)], "feature int, value double, label int, n long")
    r = G.best_splits(d).first()
    assert r.ig == pytest.approx(1) and r.threshold == 5.0 and r.gap == 7.5


def test_numerosity_reduction(spark):
    d = spark.createDataFrame([(0, t, c) for t, c in enumerate((1, 1, 2, 2, 1))], "series long, t long, code long")
    assert [r.code for r in G.reduced(d).orderBy("t").collect()] == [1, 2, 1]


def test_min_distance_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 20))
    p = spark.createDataFrame([(i, t, float(v), 0) for i, r in enumerate(x) for t, v in enumerate(r)], "series long, t long, value double, label int")
    z = G.z_windows(p, 5)
    q = z.where("series = 0 and t = 3").selectExpr("1 as query", *[f"z{i} as q{i}" for i in range(5)])
    got = {r.series: (r.distance, r.location) for r in G.min_distances(z, q, 5).collect()}
    norm = lambda w: (w - w.mean()) / w.std()
    ref = norm(x[0, 3:8])
    for i in range(3):
        d = [np.sqrt(((norm(x[i, t : t + 5]) - ref) ** 2).mean()) for t in range(16)]
        assert got[i][0] == pytest.approx(min(d), abs=1e-9) and got[i][1] == int(np.argmin(d))


def test_flat_query_has_no_distance(spark):
    p = spark.createDataFrame([(0, t, float(np.sin(t / 3))) for t in range(60)] + [(1, t, 3.0) for t in range(20)], "series long, t long, value double")
    w = X.sax_words(p, 12, 4, 4, flat_std=1e-3)
    vocab = N.vocabulary(w.where("series = 0"), 4)
    flat = N.window_novelty(w.where("series = 1"), vocab, 4).first()
    assert flat.word == "<flat>" and flat.cnt == 0 and flat.distance == 0
    seen = N.window_novelty(w.where("series = 0"), vocab, 4).agg({"novelty": "max"}).first()[0]
    assert flat.novelty > seen - 1e-9


def test_rule_that_separates(spark):
    e = spark.createDataFrame([(i, "a") for i in range(6)] + [(i, "b") for i in range(4, 12)], "sample long, token string")
    y = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "sample long, y int")
    r = {x.token: x for x in R.contrast_rules(e, y).collect()}
    assert set(r) == {"a"} and r["a"].support == 6 and r["a"].confidence == 1
    assert {x.sample for x in R.rule_scores(y, e, R.contrast_rules(e, y)).where("score > 0").collect()} == set(range(6))


def test_alpha_is_safe(spark):
    c = spark.createDataFrame([(0.0, 0.0, 1.1), (0.0, 2.0, 1.1)], "y double, base double, memory double")
    assert T.choose_alpha(c).first().alpha == 0


def test_ridge_recovers(spark):
    x = [(1.0, 2.0), (0.0, 1.0), (3.0, -1.0), (2.0, 2.0)]
    d = spark.createDataFrame([("c", a, b, 2 * a - b, -a + 0.5 * b) for a, b in x], "channel string, x0 double, x1 double, y0 double, y1 double")
    got = {(r.target, r.term): r.coef for r in T.ridge(d, ["x0", "x1"], ["y0", "y1"], 0.0).collect()}
    assert got["y0", "x0"] == pytest.approx(2) and got["y0", "x1"] == pytest.approx(-1) and got["y1", "x1"] == pytest.approx(0.5) and got["y0", "intercept"] == pytest.approx(0, abs=1e-9)


def test_interpolation_edges(spark):
    d = spark.createDataFrame([(0, 0, None), (0, 1, 2.0), (0, 2, None), (0, 3, 6.0), (0, 4, None), (1, 0, None)], "series long, t long, value double")
    assert [r.value for r in S.interpolate(d).orderBy("series", "t").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0, 0.0]


def test_readers(spark, tmp_path):
    (tmp_path / "001_UCR_Anomaly_x_3_5_6.txt").write_text("1\n2\n3\n4\n5\n6\n7\n")
    r = S.read_ucr(spark, str(tmp_path / "*.txt")).orderBy("t").collect()
    assert [x.label for x in r] == [0, 0, 0, 0, 1, 1, 0] and [x.split for x in r].count("train") == 3
    (tmp_path / "d.ts").write_text("# c\n@data\n1,?,3:a\n4,5,6:b\n")
    assert [x.value for x in S.read_ts(spark, str(tmp_path / "d.ts")).orderBy("series", "t").collect()] == [1, 2, 3, 4, 5, 6]
    (tmp_path / "f.csv").write_text("date,a,b\n2020-01-01,1,2\n2020-01-02,3,4\n")
    assert S.read_forecast_csv(spark, str(tmp_path / "f.csv")).count() == 4


def test_contract():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_are_hashed_and_never_sorted(spark):
    """Rows of window x word are reduced by hash aggregates; a minimum of structs would sort all of them."""
    rng = np.random.default_rng(11)
    rows = [(s, t, float(x), s % 2) for s in range(6) for t, x in enumerate(rng.normal(size=20))]
    rows += [(6, t, 1.0, 0) for t in range(20)] + [(7, t, float(t % 4), 1) for t in range(20)]  # flat; every fourth window the same
    rows += [(8, t, float("nan") if t == 0 else float(t % 4), 1) for t in range(20)]
    p = spark.createDataFrame(rows, "series long, t long, value double, label int")
    z = G.z_windows(p, 4)
    q = z.where("series = 7 and t = 5").select(F.lit(1).alias("query"), *[F.col(f"z{i}").alias(f"q{i}") for i in range(4)])
    d = G.min_distances(z, q, 4)
    c = X.fourier_windows(p.where("series < 8"), 4, 4, carry=("label",))
    w, zero = X.fitted_sfa_words(c, carry=("label",))
    m = G.boss_match(w, w.where("series = 7 and t = 5").select("code", *[F.col(f"s{i}").alias(f"r{i}") for i in range(4)]), 4)
    for df in (d, m):
        assert "SortAggregate" not in _plan(df) and "HashAggregate" in _plan(df)
    got = {r.series: r for r in d.collect()}
    assert (got[7].location, got[7].distance) == (1, pytest.approx(0, abs=1e-9)) and got[8].location == 1
    assert (got[6].location, got[6].spread) == (0, 0.0) and got[6].distance == pytest.approx(1)
    zs = {(r.series, r.t): np.array([r.z0, r.z1, r.z2, r.z3]) for r in z.collect()}
    for s in range(6):
        each = [np.sqrt(((zs[s, t] - zs[7, 5]) ** 2).mean()) for t in range(17)]
        assert got[s].location == int(np.argmin(np.round(each, 9))) and got[s].distance == pytest.approx(min(each)) and got[s].spread == pytest.approx(max(each) - min(each))
    ws = {(r.series, r.t): (np.array([r.s0, r.s1, r.s2, r.s3]), r.code, r.flat) for r in w.collect()}
    ref, code, _ = ws[7, 5]
    for r in m.collect():
        each = [np.abs(ws[r.series, t][0] - ref).sum() / 12 for t in range(17)]
        assert (r.location, r.distance) == (int(np.argmin(each)), pytest.approx(min(each)))
        assert r.presence == int(any(ws[r.series, t][1] == code for t in range(17))) and r.informative == (r.series != 6 and max(each) > min(each))
    flat = [v[1] for k, v in ws.items() if v[2]]
    assert flat and set(flat) == {zero}
