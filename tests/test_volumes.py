import numpy as np
import pytest

from wordloom.operators import readouts as O


def plain_volume(y, s, width, n_thresholds=250):
    """The definition word by word, threshold by threshold."""
    rocs, prs = [], []
    for w in range(min(width, len(y) - 1) + 1):
        soft = [float(v) for v in y]
        segments = [(a, b) for a in range(len(y)) for b in range(a, len(y)) if all(y[a : b + 1]) and (a == 0 or not y[a - 1]) and (b == len(y) - 1 or not y[b + 1])]
        for a, b in segments:
            for x in range(b, min(b + w // 2, len(y))):
                soft[x] += np.sqrt(1 - (x - b) / w)
            for x in range(max(a - w // 2, 0), a):
                soft[x] += np.sqrt(1 - (a - x) / w)
        soft = [min(1.0, v) for v in soft]
        runs, inside = [], False
        for i, v in enumerate(soft):
            if v > 0 and not inside:
                runs.append([])
            inside = v > 0
            if inside:
                runs[-1].append(i)
        tpr, fpr, prec = [0.0], [0.0], [1.0]
        positives = (sum(y) + sum(soft)) / 2
        for i in np.linspace(0, len(s) - 1, n_thresholds).astype(int):
            pred = [v >= sorted(s, reverse=True)[i] for v in s]
            tp = sum(v for v, p in zip(soft, pred, strict=True) if p)
            found = sum(any(pred[i] for i in run) for run in runs) / len(runs)
            tpr.append(min(tp / positives, 1) * found)
            fpr.append((sum(pred) - tp) / (len(y) - positives))
            prec.append(tp / sum(pred))
        tpr.append(1.0)
        fpr.append(1.0)
        rocs.append(sum((fpr[i + 1] - fpr[i]) * (tpr[i + 1] + tpr[i]) / 2 for i in range(len(fpr) - 1)))
        prs.append(sum((tpr[i + 1] - tpr[i]) * prec[i + 1] for i in range(len(tpr) - 2)))
    return np.mean(rocs), np.mean(prs)


def test_ramps_by_hand():
    got = O.soft_labels(np.array([0, 0, 1, 1, 0, 0, 0, 0]), 4)
    assert got == pytest.approx([0.5**0.5, 0.75**0.5, 1, 1, 0.75**0.5, 0, 0, 0])
    assert O.soft_labels(np.array([0, 1, 0, 1, 0]), 2) == pytest.approx([0.5**0.5, 1, 0.5**0.5, 1, 0])
    assert O.soft_labels(np.array([1, 0, 0]), 0) == pytest.approx([1, 0, 0])


def test_volumes_equal_the_definition(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(5):
        y = (rng.random(60) < 0.08).astype(int)
        y[20:26] = 1
        s = np.round(rng.random(60) + y * 0.3, 1 if k % 2 else 6)
        rows += [(k, t, int(y[t]), float(s[t])) for t in range(60)]
        want[k] = plain_volume(y.tolist(), s.tolist(), 9)
    rows += [(9, t, 0, float(t)) for t in range(10)] + [(10, 0, 1, 0.5), (10, 1, 0, 0.1), (10, 2, 0, 0.7)]
    want[10] = plain_volume([1, 0, 0], [0.5, 0.1, 0.7], 9)
    got = {r.series: (r.vus_roc, r.vus_pr) for r in O.vus(spark.createDataFrame(rows, "series long, t long, label int, score double"), 9).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert O.range_curve(np.array([0, 0, 1, 1, 0, 0]), np.array([0.1, 0.2, 0.9, 0.8, 0.3, 0.0]), 0, 250) == pytest.approx((1.0, 1.0))
