"""Queries against their SQL or brute force over the whole table."""

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from wordloom.operators import reports as T_reports
from wordloom.operators import retrieval as T
from wordloom.plans import evidence_queries as V
from wordloom.plans import mining_queries as Q
from wordloom.plans import series_queries as E

DIR = "/root/testdata/sf0.001"


def sql(text):
    c = duckdb.connect()
    for t in ("embeddings", "events", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c.execute(text).fetchall()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def same(df, text):
    got, want = rows(df), sorted(sql(text))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y if isinstance(y, str) else x == pytest.approx(y, abs=2e-6) for x, y in zip(a, b, strict=True))


# ---------------------------------------------------------------- all classes
@pytest.mark.parametrize("name", ["sax_collisions", "motif_top_k", "shapelet_candidates", "min_distance"])
def test_mining_of_every_class(spark, name):
    same(Q.QUERIES[name](spark, DIR), Q.SQL[name])


@pytest.mark.parametrize("name", ["sax_ngram_events", "sax_all_offset_events", "contrast_rules", "rule_scores"])
def test_evidence_of_every_class(spark, name):
    same(V.QUERIES[name](spark, DIR), V.SQL[name])


def gain(value, label):
    """(gain, threshold) of the best split between distinct values, the first one on ties."""
    h = lambda y: -sum(p * np.log2(p) for p in np.unique(y, return_counts=True)[1] / len(y))
    cuts = np.unique(value)
    split = [(round(h(label) - np.mean(value <= a) * h(label[value <= a]) - np.mean(value > a) * h(label[value > a]), 12), (a + b) / 2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return max(split, key=lambda x: (x[0], -x[1]))


def test_gain_counts_every_class(spark):
    w, z, q = Q.candidates(spark, DIR)
    d = Q.G.min_distances(z, q, 8).toPandas()
    assert d["label"].nunique() == 10
    for r in Q.word_info_gain(spark, DIR).collect():
        own = d[d["query"] == r.feature]
        ig, threshold = gain(own["distance"].round(9).to_numpy(), own["label"].to_numpy())
        assert r.ig == pytest.approx(ig, abs=2e-6) and r.threshold == pytest.approx(threshold, abs=2e-6)


def test_rules_and_matches_of_every_class(spark):
    n = sql("SELECT count(*) FROM embeddings")[0][0]
    assert {r.label for r in V.class_prior_rules(spark, DIR).collect()} == set(range(10))
    assert Q.match_features(spark, DIR).select("series").distinct().count() == n
    assert Q.boss_match(spark, DIR).select("series").distinct().count() == n


# ---------------------------------------------------------------- contexts from every day on
@pytest.mark.parametrize("name", ["continuation_rules", "residual_rules"])
def test_every_context(spark, name):
    same(V.QUERIES[name](spark, DIR), V.SQL[name])


def test_state_key_of_every_context(spark):
    daily = {c: g.sort_values("t")["value"].to_numpy() for c, g in E.X.daily_series(spark, DIR).toPandas().groupby("channel")}
    got = {(r.channel, r.start): r for r in E.forecast_state_key(spark, DIR).collect()}
    assert set(got) == {(c, s) for c, v in daily.items() for s in range(len(v) - 89)}
    for (c, s), r in list(got.items())[::97]:
        v, x = daily[c][s : s + 90], np.linspace(-1, 1, 90)
        want = (v[-1], v.mean(), v.std(), v[-1] - v[0], v[-24:].mean() - v.mean(), (x * v).mean() / (x * x).mean())
        assert (r.last, r.mean, r.sd, r.change, r.recent_shift, r.slope) == pytest.approx(want, abs=1e-3)


def test_neighbours_of_every_context(spark):
    q, b, f = V.vectors(spark, DIR)
    days = E.X.daily_series(spark, DIR).toPandas()
    daily = {int(c[0]): g.sort_values("t")["value"].to_numpy() / 1e6 for c, g in days.groupby("channel")}
    mine = {c * 100000 + t: v[t : t + 60].reshape(6, 10).mean(axis=1) for c, v in daily.items() for t in range(len(v) - 66)}
    bank, queries = set(), set()
    for c, v in daily.items():
        n = len(v) - 66
        early = [c * 100000 + t for t in range(int(0.55 * n))]
        bank |= set(sorted(early, key=lambda i: ((i * 1103515245 + 12345) % 2147483648, i))[:1024])
        queries |= {c * 100000 + t for t in range(n) if t + 1 > 0.55 * n + 7}
    assert {r.bank for r in b.collect()} == bank and {r["query"] for r in q.collect()} == queries
    got = V.neighbours(spark, DIR)[0].toPandas().sort_values("rank").groupby("query")["bank"].apply(list)
    assert set(got.index) == queries
    for c in daily:
        ids = np.array(sorted(i for i in bank if i // 100000 == c))
        table = np.stack([mine[i] for i in ids])
        mean, sd = table.mean(0), table.std(0)
        table = (table - mean) / sd
        for i in sorted(i for i in queries if i // 100000 == c):
            far = np.sqrt(((table - (mine[i] - mean) / sd) ** 2).sum(1)).round(9)
            assert got[i] == ids[np.lexsort((ids, far))[:5]].tolist()


# ---------------------------------------------------------------- the vocabulary of every series
@pytest.mark.parametrize("name", ["novelty_vocab", "nearest_normal_word", "window_novelty", "point_novelty", "novelty_normalizer"])
def test_normal_words_of_every_series(spark, name):
    same(Q.QUERIES[name](spark, DIR), Q.SQL[name])


def test_rarity_of_every_series(spark):
    w = Q.vector_words(spark, DIR).select("series", "t", "label", "code").toPandas()
    got = {r.series: r for r in Q.word_rarity(spark, DIR).collect()}
    assert set(got) == set(w["series"])
    val = set()
    for _, g in w.groupby("label"):
        ids = sorted(set(g["series"]), key=lambda i: ((i * 1103515245 + 12345) % 2147483648, i))
        val |= set(ids[: round(len(ids) * 0.5)])
    for part in (val, set(got) - val):
        train = w[~w["series"].isin(part)]["code"]
        r = -np.log(train.value_counts() / len(train))
        own = w[w["series"].isin(part)].copy()
        own["r"] = own["code"].map(r).fillna(np.log(1 + len(train)))
        top = own.sort_values(["r", "t"], ascending=[False, True]).groupby("series").first()
        for i, x in top.iterrows():
            assert got[i].rarity == pytest.approx(x["r"], abs=2e-6) and got[i].location == x["t"]


# ---------------------------------------------------------------- periods of the data
def test_periods_come_from_the_data(spark):
    daily = E.X.daily_series(spark, DIR).withColumnRenamed("channel", "series").toPandas()
    events = E.X.event_series(spark, DIR).toPandas()
    want = set()
    for source, points in (("orders", daily), ("events", events)):
        for i, g in points.groupby("series"):
            x = g.sort_values("t")["value"].to_numpy()
            x = x - x.mean()
            acf = {k: (x[:-k] * x[k:]).sum() / (x * x).sum() for k in range(1, min(40, len(x) // 2 - 1) + 1)}
            after = min((k for k in acf if acf[k] < 0), default=10**6)
            peak = next((k for k in acf if k >= after and acf[k] > 0 and k + 1 in acf and acf[k] >= acf.get(k - 1, 9) and acf[k] >= acf[k + 1]), None)
            if peak and acf[peak] >= 0.3:
                want.add((source, str(i), peak))
    assert {tuple(r) for r in Q.estimate_period(spark, DIR).collect()} == want


def test_periods_follow_the_values(spark, tmp_path):
    day = "date_add(date'2020-01-01', cast(id as int))"
    spark.range(400).selectExpr(f"{day} AS o_orderdate", "'1-URGENT' AS o_orderpriority", "1000 + 500 * sin(2 * pi() * id / 9) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("7L AS user_id", "id AS event_id", "timestamp_seconds(id) AS ts", "sin(2 * pi() * id / 21) AS value", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    assert {tuple(r) for r in Q.estimate_period(spark, str(tmp_path)).collect()} == {("orders", "1-URGENT", 9), ("events", "7", 21)}


# ---------------------------------------------------------------- faults that a shared SQL would hide
def test_miner_events_take_the_top_two_before_the_threshold(spark):
    f = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0)], "series long, code long, presence double").selectExpr("*", "0.0 AS frequency", "0.0 AS distance")
    t = spark.createDataFrame([(10, 9.0), (11, 1.5), (12, 0.5)], "code long, threshold double")
    assert rows(V.R.miner_events(f, t)) == [(1, "miner_word=11|active")]


def test_zero_word_under_fitted_edges(spark):
    edges = spark.createDataFrame([(k, q, e) for k, own in enumerate([(1.0, 2.0, 3.0), (-2.0, -1.0, 1.0), (-3.0, -2.0, -1.0), (-1.0, 0.0, 1.0)]) for q, e in enumerate(own)], "position int, q int, edge double")
    assert E.X.sfa_zero_code(edges) == 0 * 64 + 2 * 16 + 3 * 4 + 2


def test_evidence_is_cut_and_scaled(spark):
    train = spark.createDataFrame([(float(x),) for x in (-1, 1, -1, 1, -2, 2)], "raw double")
    got = [r.evidence for r in V.T.clipped_evidence(train, spark.createDataFrame([(0.0,), (2.0,), (100.0,)], "raw double"), ("raw",)).orderBy("raw").collect()]
    z = lambda v: min(v * v / 2.0, 25.0)
    lo, hi = np.quantile([z(v) for v in (-1, 1, -1, 1, -2, 2)], [0.05, 0.95])
    assert got == pytest.approx([np.clip((z(v) - lo) / (hi - lo), 0, 1) for v in (0.0, 2.0, 100.0)])


def test_anomaly_weight_keeps_the_false_alarm_budget(spark):
    base, evidence = np.linspace(0, 1, 101), np.linspace(0, 1, 101)[::-1]
    got = V.T.anomaly_weight(spark.createDataFrame([(float(b), float(e)) for b, e in zip(base, evidence, strict=True)], "base double, evidence double")).first()
    q = np.quantile(base, [0.05, 0.95])
    q95 = {w: np.quantile(base + w * (q[1] - q[0]) * evidence, 0.95) for w in (0.0, 0.1, 0.25, 0.5, 1.0)}
    assert got.weight == max(w for w, x in q95.items() if x <= q[1] + 0.05 * (q[1] - q[0])) and got.q95 == pytest.approx(q95[got.weight])


def test_bounded_bank_is_an_exact_sample(spark):
    rows = [(i, i % 3, [float(i), 1.0]) for i in range(900)]
    df = spark.createDataFrame(rows, "bank long, ch int, v array<double>")
    got = {(r.ch, r.bank) for r in T.bounded_bank(df.repartition(7), 40, by=("ch",)).collect()}
    want = {(c, b) for c in range(3) for b in sorted((i for i, k, _ in rows if k == c), key=lambda i: ((i * 1103515245 + 12345) % 2147483648, i))[:40]}
    assert got == want and T.bounded_bank(df, 5000).count() == 900
    q, b = T.standard_keys(df.withColumnRenamed("bank", "query"), df, ("ch",))
    x = np.array([r.v for r in b.where("ch = 1").collect()])
    assert abs(x.mean(0)).max() < 1e-9 and x[:, 0].std() == pytest.approx(1) and set(x[:, 1]) == {0.0} and q.count() == 900


def test_two_views_search_the_whole_bank(spark):
    rng = np.random.default_rng(4)
    e, s = rng.normal(size=(60, 5)), rng.normal(size=(60, 8))
    e[50] = -e[0]
    s[50] = s[0]  # last by embedding, first by symbols
    bank = spark.createDataFrame([(i, e[i].tolist(), s[i].tolist()) for i in range(1, 60)], "bank long, e array<double>, s array<double>")
    query = spark.createDataFrame([(0, e[0].tolist(), s[0].tolist())], "query long, e array<double>, s array<double>")
    for beta in (0.0, 0.2, 20.0):
        got = T.two_views(query, bank, 4, (5, 8), beta).orderBy("rank").collect()
        n = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
        mean, sd = s[1:].mean(0), s[1:].std(0)
        score = n(e[1:]) @ n(e[0]) + beta * (n((s[1:] - mean) / sd) @ n((s[0] - mean) / sd))
        order = np.argsort(-score)[:4]
        assert [r.bank for r in got] == (order + 1).tolist() and [r.score for r in got] == pytest.approx(score[order])
        w = np.exp(score[order] - score[order][0])
        assert [r.weight for r in got] == pytest.approx(w / w.sum())
        assert (50 in [r.bank for r in got]) == (beta == 20.0)


def test_signed_ranks_beyond_sign_vectors(spark):
    rng = np.random.default_rng(6)
    for n, ties in ((2, False), (12, True), (60, True), (230, True)):
        d = rng.normal(0.2, 1, n)
        d = np.round(d, 1) if ties else d
        d[0] = 0.0
        d = d[np.abs(d) > 1e-12]
        m = np.round(np.abs(d), 12)
        rank = np.array([(m < x).sum() + ((m == x).sum() + 1) / 2 for x in m])
        w = rank[d > 0].sum()
        r = T_reports.wilcoxon_greater(spark.createDataFrame([(float(x),) for x in [*d, 0.0]], "d double")).first()
        assert r.n == len(d)
        if len(d) < 3:
            assert r.p is None
            continue
        assert r.w_plus == pytest.approx(w)
        chances = {0.0: 1.0}
        for x in rank:
            new = {}
            for s, c in chances.items():
                for y in (s, s + x):
                    new[y] = new.get(y, 0.0) + c / 2
            chances = new
        want = sum(c for s, c in chances.items() if s >= w - 1e-9)
        assert r.p == pytest.approx(want, abs=1e-12 if len(d) <= 200 else 3e-3)
