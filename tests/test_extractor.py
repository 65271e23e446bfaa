import math
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import extractor as E
from wordloom.operators import mining as G
from wordloom.operators import windows as X

P = "series long, channel long, t long, value double, label int"


@pytest.fixture(scope="module")
def points(spark):
    """Thirty series of four channels: a random walk, a constant, noise with a bump of class 1, another constant."""
    rng = random.Random(5)
    rows = []
    for s in range(30):
        walk, label = 0.0, s % 2
        for t in range(40):
            walk += rng.gauss(0, 1)
            bump = 4 * math.sin((t - 10) / 8 * math.pi) if label and 10 <= t < 18 else 0.0
            rows += [(s, 0, t, walk, label), (s, 1, t, 3.7, label), (s, 2, t, rng.gauss(0, 1) + bump, label), (s, 3, t, 1.0, label)]
    return spark.createDataFrame(rows, P).cache()


def test_channels_equal_runs_of_their_own(points):
    e = E.fit(points, 8, 4, 4, top_k=3, n_candidates=8, n_projections=4)
    assert e.width <= 3 and e.dim == 3 * e.width + 1
    mean, sd = e.mean, e.sd
    for c in (0, 2):
        own = points.where(F.col("channel") == c).drop("channel")
        words, z = X.sax_words(own, 8, 4, 4, carry=("label",)), G.z_windows(own, 8)
        top, queries = G.shapelets(words, z, 8, 4, 170, G.projection_masks(4, 1, 4, 0), 8, 3)
        want = {(r.rank, r.code, round(r.ig, 9), round(r.support, 9)) for r in top.collect()}
        assert {(r.rank, r.code, round(r.ig, 9), round(r.support, 9)) for r in e.dictionary.where(F.col("channel") == c).collect()} == want
        rank = {code: r for r, code, *_ in want}
        n = words.count()
        rare = {r.series: (r.rarity, r.location) for r in G.rarity(words, G.rarity_table(words), F.lit(n)).collect()}
        got = {r.series: r for r in E.transform(e, points).where(F.col("channel") == c).collect()}
        assert len(got) == 30
        for r in G.match(words, z, top, queries, 8).collect():
            k = rank[r.code] - 1
            x = [got[r.series].features[3 * k + i] * sd[3 * k + i] + mean[3 * k + i] for i in range(3)]
            assert x == pytest.approx([r.presence, r.frequency, r.distance], abs=1e-9)
            assert (got[r.series].location[k], got[r.series].informative[k]) == (r.location, r.informative)
        for s, (rarity, at) in rare.items():
            assert got[s].features[-1] * sd[-1] + mean[-1] == pytest.approx(rarity) and got[s].rarity_location == at


def test_dead_channels_are_padded_and_named(points):
    e = E.fit(points, 8, 4, 4, top_k=3, n_candidates=8, n_projections=4)
    by = {c: sorted((r.slot, r.word, r.info_gain, r.support) for r in E.words(e).where(F.col("channel") == c).collect()) for c in range(4)}
    assert by[1] == by[3] == [(k, "<none>", 0.0, 0.0) for k in range(e.width)] and all(len(v) == e.width for v in by.values())
    names = {(r.channel, r.j): (r.slot, r.kind, r.word) for r in E.feature_names(e).collect()}
    assert len(names) == 4 * e.dim and names[0, e.dim - 1] == (None, "rarity", None)
    assert names[2, 1] == (0, "frequency", by[2][0][1]) and names[1, 2][2] == "<none>"
    raw = E.raw(e, points).where("channel = 1").collect()
    assert len(raw) == 30 and all(x == 0 for r in raw for x in r.features)
    rows = E.transform(e, points).select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and min(abs(r.s - 1), abs(r.s)) < 1e-6 for r in rows)


def test_fit_on_a_subset_and_without_words(points):
    e = E.fit(points.drop("label"), 8, 4, 4, top_k=2, n_candidates=5, n_projections=2, max_fit_series=6, seed=3)
    assert E.transform(e, points).count() == 120 and {r.n_train for r in e.totals.collect()} == {6 * 33}
    assert E.subset(points, 6, 3).select("series").distinct().count() == 6
    with pytest.raises(ValueError, match="no words"):
        E.fit(points.where("channel in (1, 3)"), 8, 4, 4)
    assert E.raw(e, points.where("false")).count() == 0
