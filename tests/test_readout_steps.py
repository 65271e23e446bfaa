import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import extractor as E
from wordloom.operators import paths as S
from wordloom.operators import windows as X
from wordloom.plans import readout_queries as R

DIR = "/root/testdata/sf0.001"


def test_statistics_of_packed_channels_are_those_of_points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 3, 16))
    x[1, 2, 3] = np.nan
    long = spark.createDataFrame([(i, c, t, float(x[i, c, t])) for i in range(5) for c in range(3) for t in range(16)], "series long, channel long, t long, value double")
    want = X.summary_statistics(long, 16, ("series", "channel")).orderBy("series", "channel").select(*X.STATISTICS).collect()
    assert X.statistics_of(x).reshape(15, 8) == pytest.approx(np.array(want), abs=1e-9)


def test_centroids_leave_the_row_and_the_judged_rows_out(spark):
    """Centroids were made of the other folds whether these were to fit on or to judge on."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 4)), [i % 3 for i in range(30)]
    fit = spark.createDataFrame([(i, y[i], x[i].tolist()) for i in range(30)], "series long, label int, values array<double>")
    folds, centres = R.held_out_centroids(fit)
    fold = {r.series: r.fold for r in folds.collect()}
    got = {r.fold: {c.k: c.c for c in r.classes} for r in centres.collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4] and sorted(fold) == list(range(30))
    for f, classes in got.items():
        for k, c in classes.items():
            assert c == pytest.approx(x[[i for i in range(30) if y[i] == k and fold[i] != f]].mean(0))


def test_readout_fits_on_its_own_rows_with_the_whole_method(spark, monkeypatch):
    """Words and scales came from the judged rows too, and strengths, folds and permutations were cut."""
    seen, fit, readout = {}, E.fit, S.readout

    def fitting(points, *a, **k):
        seen["ids"] = {r.series for r in points.select("series").distinct().collect()}
        return fit(points, *a, **k)

    def reading(fit_rows, test_rows, kind, heads, base, **k):
        seen.update(k, heads=heads, fit={r.id for r in fit_rows.select("id").collect()}, test={r.id for r in test_rows.select("id").collect()}, width=test_rows.select(F.size("x")).first()[0])
        return readout(fit_rows, test_rows, kind, {"symbolic": heads["symbolic"], "statistics": heads["statistics"]}, base, n_folds=2, n_permutations=1, strengths=(0.03,))

    monkeypatch.setattr(E, "fit", fitting)
    monkeypatch.setattr(S, "readout", reading)
    rows = {r["name"]: r for r in R.reliability_readout(spark, DIR).collect()}
    assert seen["ids"] == seen["fit"] and not seen["fit"] & seen["test"]
    assert not {"n_folds", "n_permutations", "strengths"} & set(seen)
    assert set(seen["heads"]) == {"statistics", "symbolic", "fm_signal+statistics", "fm_signal+symbolic", "embedding", "embedding+symbolic"}
    assert len(seen["heads"]["statistics"]) == 24 and max(map(max, seen["heads"].values())) == seen["width"] - 1
    s = rows["symbolic"]
    assert len(s.examples) == 6 and len(s.curve) == 20 and s.p_value in (0.5, 1.0) and s.n_features == len(seen["heads"]["symbolic"])
    assert all(e.id in seen["test"] and len(e.input) == 64 for e in s.examples)
    assert all(t.contribution > 0 and (t.start is None or t.end == t.start + 8) for e in s.examples for t in e.evidence)
    assert all((t.coefficient > 0) == (t.direction == "raises_risk") for t in rows["statistics"].terms)
