import math
import random
from collections import defaultdict

import numpy as np
import pytest

from wordloom.operators import selection

ALPHAS = (0.0, 0.1, 0.5)


@pytest.fixture(scope="module")
def made():
    """Words of two channels, active codes, residuals of three classes that follow a token, and logits."""
    rng = random.Random(3)
    words, active, values, logits = [], [], [], []
    for i in range(80):
        for ch in (0, 1):
            words.append((i, ch, [str(rng.randrange(2)) for _ in range(6)]))
            active += [(i, ch, c) for c in (4, 7) if rng.random() < 0.5]
        y = rng.randrange(3)
        for h in range(3):
            values.append((i, h, rng.gauss(0, 1) + (h == 1) * (words[-1][2][-1] == "1")))
            logits.append((i, y, h, rng.gauss(0, 1)))
    return words, active, values, logits


def brute_events(words, active, i):
    out = set()
    for s, ch, w in words:
        if s != i:
            continue
        for end in {3, len(w) // 2 + 3, len(w)}:
            end = min(end, len(w))
            out.add((f"ch={ch}|loc={'recent' if end == len(w) else 'context'}|sax={'.'.join(w[max(0, end - 3) : end])}", False))
        for a, c, code in active:
            if (a, c) == (i, ch):
                one = f"ch={ch}|miner_word={code}|active"
                out |= {(one, True), (f"ch={ch}|loc=recent|sax={'.'.join(w[-3:])}&{one}", True)}
    return out


def brute_bank(events, values, support, shrink):
    v = {i: np.array([x for j, _, x in values if j == i]) for i in events}
    every = np.array(list(v.values()))
    scale = max(math.sqrt(((every - every.mean(0)) ** 2).mean()), 1e-6)
    by = defaultdict(list)
    for i, tokens in events.items():
        for t in tokens:
            by[t].append(v[i])
    rules = {}
    for t, rows in by.items():
        if len(rows) >= support:
            m = np.mean(rows, 0)
            rules[t] = m, math.sqrt(((m - every.mean(0)) ** 2).mean()) / scale * len(rows) / (len(rows) + shrink)
    return rules


def brute_reference(tokens, rules, top):
    chosen = sorted((-rules[t][1], t) for t in tokens if t in rules)[:top]
    if not chosen:
        return None
    weight = np.array([-s for s, _ in chosen])
    return np.tensordot(weight / max(weight.sum(), 1e-12), np.stack([rules[t][0] for _, t in chosen]), axes=(0, 0))


def frames(spark, made):
    words, active, values, logits = made
    return (
        spark.createDataFrame(words, "sample long, channel int, w array<string>"), spark.createDataFrame(active, "sample long, channel int, code int"),
        spark.createDataFrame(values, "sample long, h int, value double"), spark.createDataFrame(logits, "sample long, y int, h int, logit double"),
    )


def test_joint_events(spark, made):
    w, a, _, _ = frames(spark, made)
    got = defaultdict(set)
    for r in selection.behaviour_events(w, a).collect():
        assert (r.token, r.mined) not in got[r.sample]
        got[r.sample].add((r.token, r.mined))
    assert all(got[i] == brute_events(made[0], made[1], i) for i in range(80))
    odd = spark.createDataFrame([(1, 0, ["2"]), (2, 0, []), (3, 0, None)], w.schema)
    assert [(r.sample, r.token) for r in selection.behaviour_events(odd, a.limit(0)).collect()] == [(1, "ch=0|loc=recent|sax=2")]


def test_guidance_with_controls(spark, made):
    words, active, values, logits = made
    w, a, v, lg = frames(spark, made)
    em, vm = selection.event_modes(selection.behaviour_events(w, a)), selection.value_modes(v)
    dealt = {(r.sample, r.h): r.value for r in vm.where("mode = 'permuted'").collect()}
    order = sorted(range(80), key=lambda i: ((i * 1103515245 + 12345) % 2147483648, i))
    assert all(dealt[i, h] == values[3 * order[i] + h][2] for i in range(80) for h in range(3))
    rules = selection.value_rules(em, vm, 8)
    found = selection.references(em, rules, 4)
    got = {(r.mode, r.sample, r.h): r.correction for r in found.collect()}
    cells = selection.correction_cells(lg, found, v.groupBy("h").agg({"value": "avg"}).withColumnRenamed("avg(value)", "correction"))
    grid = defaultdict(dict)
    for r in selection.guidance_grid(cells, ALPHAS).collect():
        grid[r.mode][r.alpha] = r
    report = {r["mode"]: r for r in selection.guidance_report(cells, selection.guidance_grid(cells, ALPHAS)).collect()}
    base, y = np.array([x[3] for x in logits]).reshape(80, 3), np.array([x[1] for x in logits])[::3]
    every = np.array([x[2] for x in values]).reshape(80, 3)
    permuted = [(i, h, every[order[i], h]) for i in range(80) for h in range(3)]
    for mode in ("own", "sax", "permuted", "global"):
        rows = {i: {t for t, mined in brute_events(words, active, i) if not (mined and mode == "sax")} for i in range(80)}
        if mode == "global":
            refs = [every.mean(0)] * 80
        else:
            bank = brute_bank(rows, permuted if mode == "permuted" else values, 8, 12.0)
            refs = [brute_reference(rows[i], bank, 4) for i in range(80)]
            for i, x in enumerate(refs):
                assert [got.get((mode, i, h)) for h in range(3)] == ([None] * 3 if x is None else pytest.approx(x.tolist(), abs=1e-9))
        ref = np.array([np.zeros(3) if x is None else x for x in refs])
        true = {}
        for alpha in ALPHAS:
            z = base + alpha * ref
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            true[alpha] = -np.log(p[np.arange(80), y] + 1e-12).mean(), (z.argmax(1) == y).mean()
            assert (grid[mode][alpha].nll, grid[mode][alpha].accuracy) == pytest.approx(true[alpha], abs=1e-9)
            assert grid[mode][alpha].allowed == (true[alpha][1] + 1e-12 >= true[0.0][1])
        best = min((round(n, 9), x) for x, (n, acc) in true.items() if acc + 1e-12 >= true[0.0][1])[1]
        assert [x for x in ALPHAS if grid[mode][x].chosen] == [best] == [report[mode].alpha]
        assert report[mode].change == pytest.approx(np.abs(best * ref).mean(), abs=1e-9)
        assert report[mode].coverage == (0 if mode == "global" else np.mean([x is not None for x in refs]))


def test_prior_rules(spark, made):
    words, active, _, logits = made
    w, a, _, lg = frames(spark, made)
    y = [x[1] for x in logits[::3]]
    targets = spark.createDataFrame([("sax", i, c) for i, c in enumerate(y)], "mode string, sample long, label int")
    classes = spark.createDataFrame([(h,) for h in range(4)], "h int")  # the last has no row
    got = selection.prior_rules(selection.event_modes(selection.behaviour_events(w, a)), targets, classes, 4, 8.0).collect()
    prior = np.log((np.bincount(y, minlength=4) + 1) / (len(y) + 4))
    rows = {i: {t for t, mined in brute_events(words, active, i) if not mined} for i in range(80)}
    true = {}
    for t in set().union(*rows.values()):
        n = np.bincount([y[i] for i in range(80) if t in rows[i]], minlength=4)
        if n.sum() >= 4:
            shift = np.log((n + 1) / (n.sum() + 4)) - prior
            true[t] = shift, math.sqrt((shift**2).mean()) * n.sum() / (n.sum() + 8)
    assert {r.token for r in got} == set(true)
    for r in got:
        assert [x.value for x in r.v] == pytest.approx(true[r.token][0].tolist()) and r.strength == pytest.approx(true[r.token][1])


def test_removals(spark):
    rng = random.Random(5)
    events = [(i, f"t{k}") for i in range(30) for k in range(7) if rng.random() < (0 if i == 9 else 0.6)] + [(40, "t0")]
    rules = [(f"t{k}", s, round(rng.random(), 1)) for k in range(7) for s in range(3)]
    rules = [(t, s, 0.0 if t == "t6" else x) for t, s, x in rules]
    centres = [(s, h, float(s * 2 - h)) for s in range(3) for h in range(2)]
    df = selection.removals(
        spark.createDataFrame(events, "sample long, token string"), spark.createDataFrame(rules, "token string, state int, score double"), spark.createDataFrame(centres, "state int, h int, level double"), 4
    )
    got = {(r.variant, r.sample, r.h): (r.forecast, r.reliability) for r in df.collect()}
    true = {}
    for i in {e[0] for e in events}:
        own = {t for j, t in events if j == i}
        m = sorted(((-x, t, s) for t, s, x in rules if t in own and x > 0))
        if not m:
            continue
        pick = (i * 1103515245 + 12345) % 2147483648 % min(len(m), 4)
        for variant, gone in (("all", None), ("best", m[0][1]), ("random", m[pick][1])):
            left = [x for x in m if x[1] != gone][:4]
            for h in range(2) if left else ():
                total = -sum(x[0] for x in left)
                true[variant, i, h] = sum(-x * (s * 2 - h) for x, _, s in left) / total, min(1.0, -left[0][0])
    assert set(got) == set(true) and ("best", 40, 0) not in got
    assert all(got[k] == pytest.approx(true[k]) for k in true)
    base = [(i, h, 1.0 + h) for i in range(30) for h in range(2)]
    e = selection.removal_effect(df, spark.createDataFrame(base, "sample long, h int, base double"), 0.5).first()
    move = lambda v, i, h, b: true[v, i, h][1] * (true[v, i, h][0] - b) if (v, i, h) in true else 0.0
    change = [0.5 * np.mean([abs(move("all", i, h, b) - move(v, i, h, b)) for i, h, b in base]) for v in ("best", "random")]
    assert (e.best_change, e.random_change) == pytest.approx(tuple(change)) and e.ratio == pytest.approx(change[0] / change[1])
    assert e.matched == len({i for v, i, _ in true if v == "all" and i < 30})
