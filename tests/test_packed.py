import math
import random

from pyspark.sql import functions as F

from wordloom.operators import mining as G
from wordloom.operators import ordering
from wordloom.operators import windows as X
from wordloom.plans import mining_queries as Q
from wordloom.plans import series_queries as S

DIR = "/root/testdata/sf0.001"


def both(spark):
    """Series with a null, without variance, too short and of no point, packed and long."""
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(n)]) for i, n in enumerate((20, 8, 7, 13, 1, 0))]
    rows += [(6, 0, [2.5] * 12), (7, 1, [1.0, None, *[float(k * k) for k in range(11)]]), (8, 0, None)]
    packed = spark.createDataFrame(rows, "series long, label int, values array<double>")
    return packed, packed.select("series", F.posexplode("values").alias("t", "value"), "label").withColumn("t", F.col("t").cast("long"))


def rows(df, key=("series", "t")):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*key).collect()]


def test_packed_series_give_the_words_of_long_ones(spark):
    packed, long = both(spark)
    for step, segments in ((1, 4), (3, 4), (1, 3)):
        make = lambda p: X.sax_words(p, 8, segments, 4, step, carry=("label",))  # noqa: B023, E731
        got = rows(make(packed))
        assert got == rows(make(long)) and (step > 1 or len(got) == 13 + 1 + 6 + 5 + 4)
    assert rows(X.fourier_windows(packed, 8, 4, carry=("label",))) == rows(X.fourier_windows(long, 8, 4, carry=("label",)))
    assert rows(G.z_windows(packed, 8)) == rows(G.z_windows(long, 8))


def test_words_of_vectors_take_no_sort_and_tasks_by_rows(spark):
    """Points of vectors were shuffled and sorted for every reader, in as many tasks as the session has shuffle partitions."""
    for df in (Q.vectors(spark, DIR), S.embedding_coefs(spark, DIR)):
        assert "Window" not in df._jdf.queryExecution().analyzed().toString()
    n = spark.createDataFrame([(i, [0.0]) for i in range(X.PACKED_ROWS + 1)], "series long, values array<double>")
    assert X.dealt(n).rdd.getNumPartitions() == 2
    assert "windowspec" not in Q.vector_words(spark, DIR)._jdf.queryExecution().analyzed().toString().lower()


def test_close_quantiles_are_exact(spark):
    rng = random.Random(1)
    data = [(rng.gauss(0, 1), float(rng.randrange(3)), None, 7.0 if i % 9 else math.exp(i % 700)) for i in range(4001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.75, 0.9997, 1.0]
    pick = lambda d: {(r.k, r.i): r.value for r in d.collect()}
    got = pick(ordering.close_quantiles(df, ["a", "b", "c", "d"], qs))
    assert got == pick(ordering.quantiles(df, ["a", "b", "c", "d"], qs)) and len(got) == 18


def test_missed_bracket_is_put_in_order(spark, monkeypatch):
    """With a sketch far too coarse for its brackets the counts say so and the exact order decides."""
    df = spark.range(5000).select((F.col("id") * 1.0).alias("a"))
    monkeypatch.setattr(ordering, "SKETCH", 1_000_000_000)
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda v, p, n: F.array(*[F.lit(-1.0) for _ in p]))
    assert ordering.close_quantiles(df, ["a"], [0.5]).first().value == 2499.5


def test_masks_drawn_twice_count_twice(spark):
    w = spark.createDataFrame([(0, 0, 1, 0, 1), (1, 0, 1, 0, 1), (1, 1, 2, 0, 2), (2, 1, 4, 1, 0)], "series long, label int, code long, s0 int, s1 int")
    one = {(r.code, r.label): r.n for r in G.collisions(w, [(0,)], 2).collect()}
    two = {(r.code, r.label): r.n for r in G.collisions(w, [(0,), (1,), (0,)], 2).collect()}
    other = {(r.code, r.label): r.n for r in G.collisions(w, [(1,)], 2).collect()}
    assert two == {k: 2 * one.get(k, 0) + other.get(k, 0) for k in one | other}
