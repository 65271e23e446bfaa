import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import mining as G
from wordloom.operators import novelty as N
from wordloom.operators import ordering
from wordloom.operators import windows as X


@pytest.fixture(scope="module")
def long_series(spark):
    """One series of 60,000 points and one of 37."""
    t = F.col("id")
    one = spark.range(60_000).select(F.lit(1).cast("long").alias("series"), t.alias("t"), (F.sin(t / 7.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0).alias("value"), F.lit(0).alias("label"))
    return one.unionByName(one.where("t < 37").withColumn("series", F.lit(2).cast("long"))).cache()


@pytest.mark.parametrize("block", [16, 1000, 1 << 20])
def test_words_of_blocks_are_those_of_the_series(long_series, block):
    d = long_series if block > 16 else long_series.where("t < 3000")
    cols = ["series", "t", "word", "flat"]
    whole, parts = X.sax_words(d, 16, 4), X.over_blocks(d, 16, block, lambda x: X.sax_words(x, 16, 4))
    assert whole.select(cols).exceptAll(parts.select(cols)).count() == 0 and parts.count() == whole.count()
    if block == 1000:
        z = X.over_blocks(d, 8, block, lambda x: G.z_windows(x, 8))
        assert z.count() == G.z_windows(d, 8).count() and z.agg(F.max(F.abs("z0"))).first()[0] < 8
        assert parts.select("word").distinct().count() > 10


def test_point_scores_of_blocks(long_series):
    d = long_series.where("t < 3000").select("series", "t", "label")
    nov = d.where("t % 3 = 0").select("series", "t", (F.pmod(F.xxhash64("t"), F.lit(97)) / 7.0).alias("novelty"))
    whole, parts = N.point_novelty(d, nov, 12), N.point_novelty(d, nov, 12, 50)
    assert whole.exceptAll(parts).count() == 0 and parts.count() == whole.count()
    with pytest.raises(ValueError, match="hold a window"):
        N.point_novelty(d, nov, 12, 8)


def test_quantiles_equal_percentile_on_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9)), float(rng.normal()), None if i % 4 else float(i), None) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    got = {(r.k, r.i): r.value for r in ordering.quantiles(df, ["a", "b", "c", "d"], qs).collect()}
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c in "abc"]).first()
    assert len(got) == 18 and all(got[k, i] == pytest.approx(want[c][i], abs=1e-12) for k, c in enumerate("abc") for i in range(6))
    assert ordering.quantile_row(df, "b", [0.5]).first().q[0] == pytest.approx(np.median([r[1] for r in rows]))
