import pytest

from wordloom.operators import metrics as M
from wordloom.operators import novelty as N
from wordloom.operators import reports as P


def scored(spark, scores, labels, pred=None):
    rows = [(0, t, float(s), y, p) for t, (s, y, p) in enumerate(zip(scores, labels, pred or labels, strict=True))]
    return spark.createDataFrame(rows, "series long, t long, score double, label int, pred int")


def test_point_adjust(spark):
    d = scored(spark, [0] * 8, [0, 1, 1, 1, 0, 1, 1, 0], [0, 0, 1, 0, 0, 0, 0, 0])
    assert [r.adjusted for r in M.point_adjust(d).orderBy("t").collect()] == [0, 1, 1, 1, 0, 0, 0, 0]


def test_false_alarms(spark):
    assert M.false_alarm_rate(scored(spark, [0] * 4, [0, 0, 1, 1], [1, 0, 1, 0])).first().fpr == 0.5


def test_best_f1(spark):
    r = M.best_f1_exact(scored(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])).first()
    assert r.best_f1 == 1 and 0.2 < r.threshold <= 0.8


def test_average_precision_of_ties(spark):
    assert M.average_precision(scored(spark, [1, 1, 1, 1], [0, 1, 0, 1])).first().ap == pytest.approx(0.5)


def test_one_class_entities_are_skipped(spark):
    assert M.anomaly_metrics(scored(spark, [1, 2], [0, 0])).first().n_entities == 0


def test_strict_and_loose_thresholds(spark):
    d = scored(spark, [1, 2, 3, 4], [0, 1, 0, 1])
    t = spark.createDataFrame([(0, 0, 2.0), (0, 1, 9.0)], "series long, k int, threshold double")
    c = M.curve(d)
    assert [(r.k, r.tp, r.fp) for r in M.at_thresholds(c, t, ("series",), True).orderBy("k").collect()] == [(0, 1, 1), (1, 0, 0)]
    assert [(r.k, r.tp, r.fp) for r in M.at_thresholds(c, t, ("series",), False).orderBy("k").collect()] == [(0, 2, 1), (1, 0, 0)]


def test_classification(spark):
    d = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 0)], "y int, pred int")
    assert M.classification_metrics(d).first().accuracy == 0.75


def test_spans(spark):
    d = scored(spark, [0] * 6, [1, 1, 0, 0, 1, 0])
    assert {(r.start, r.end) for r in M.label_spans(d).collect()} == {(0, 2), (4, 5)}


def test_risk_coverage(spark):
    d = spark.createDataFrame([(i, float(i >= 80), float(i >= 80)) for i in range(100)], "id long, score double, loss double")
    curve, summary = M.risk_coverage(d)
    assert summary.first().excess == pytest.approx(0)
    assert {r.coverage: r.risk for r in curve.collect()}[0.8] == 0


def test_top1_hit(spark):
    s = [0.0] * 100
    s[50] = 1.0
    near, far = [int(55 <= t < 60) for t in range(100)], [int(t >= 95) for t in range(100)]
    assert M.top1_hit(scored(spark, s, near), 10).first().hit_rate == 1
    assert M.top1_hit(scored(spark, s, far), 10).first().hit_rate == 0


def test_top_events(spark):
    s = [0.0] * 100
    for t, v in ((10, 5), (12, 4), (50, 3), (90, 2)):
        s[t] = float(v)
    got = N.top_events(scored(spark, s, [0] * 100), 3, 5).orderBy("rank").collect()
    assert [r.t for r in got] == [10, 50, 90]


def test_period(spark):
    import math

    d = spark.createDataFrame([(0, t, math.sin(2 * math.pi * t / 25)) for t in range(400)], "series long, t long, value double")
    assert abs(N.periods(N.autocorrelation(d, 60)).first().period - 25) <= 1


def test_tail_surprisal_counts(spark):
    import math

    ref = spark.createDataFrame([(float(i),) for i in range(1, 101)], "raw double")
    q = spark.createDataFrame([(0, 100.0), (1, 1.0), (2, 50.5)], "i long, raw double")
    got = {r.i: r.q for r in N.tail_surprisal(q, ref, "raw", "raw", "q").collect()}
    assert got[0] == pytest.approx(-math.log(2 / 101)) and got[1] == pytest.approx(0) and got[2] == pytest.approx(-math.log(51 / 101))


def test_wilcoxon(spark):
    d = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "d double")
    r = P.wilcoxon_greater(d).first()
    assert r.n == 4 and r.w_plus == 10 and r.p == pytest.approx(1 / 16)


def test_baseline_delta(spark):
    d = spark.createDataFrame([("r1", "baseline", 0.81), ("r1", "guided", 0.85), ("r2", "guided", 0.9)], "regime string, variant string, score double")
    got = {(r.regime, r.variant): r.delta for r in P.baseline_deltas(d, ("regime",), "score").collect()}
    assert got["r1", "guided"] == pytest.approx(0.04) and got["r2", "guided"] is None
