import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import symbols as S
from wordloom.operators import windows as X


def series(spark, *values, label=0):
    rows = [(i, t, float(v), label) for i, vs in enumerate(values) for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series long, t long, value double, label int")


def test_breakpoints_of_three():
    assert S.breakpoints(3) == pytest.approx([-0.4307, 0.4307], abs=1e-4)


def test_paa_weights_keep_the_mean():
    for length, n in ((10, 3), (24, 8), (64, 24), (5, 5), (7, 2)):
        w = S.paa_weights(length, n)
        assert all(sum(x for _, x in share) == pytest.approx(1) for share in w)
        each = [sum(x for share in w for i, x in share if i == p) for p in range(length)]
        assert each == pytest.approx([n / length] * length)


def test_worked_sax_words(spark):
    w = X.sax_words(series(spark, [2, 6, 9, 6], [1, 1, 1, 1], [1, 2, 1, 2]), 4, 2, 3).orderBy("series").collect()
    assert [r.word for r in w] == ["ac", "bb", "bb"]
    assert [r.flat for r in w] == [False, True, False]


def test_words_of_joined_series(spark):
    w = X.sax_words(series(spark, [2, 6, 9, 6, 1, 1, 1, 1, 1, 2, 1, 2]), 4, 2, 3, step=4).orderBy("t").collect()
    assert [(r.t, r.word) for r in w] == [(0, "ac"), (4, "bb"), (8, "bb")]


def test_worked_fourier_word(spark):
    c = X.fourier_windows(series(spark, [2, 6, 9, 6], [1, 2, 1, 2]), 4, 4).orderBy("series").collect()
    assert [c[0][f"c{k}"] for k in range(4)] == pytest.approx([-2.814, 0, -0.402, 0], abs=1e-3)
    edges = spark.createDataFrame([(p, q, e) for p in range(4) for q, e in enumerate((-0.5, 0.5))], "position int, q int, edge double")
    words = X.sfa_words(X.fourier_windows(series(spark, [2, 6, 9, 6], [1, 1, 1, 1]), 4, 4), edges, 4, 3).orderBy("series").collect()
    assert [r.word for r in words] == ["abbb", "bbbb"]


def test_code_is_positional(spark):
    r = spark.range(1).select(S.code([F.lit(1), F.lit(0), F.lit(3)], 4).alias("c")).first()
    assert r.c == 19


def test_mindist_cells(spark):
    r = spark.range(1).select(S.mindist_cell(F.lit(0), F.lit(1), 4).alias("near"), S.mindist_cell(F.lit(0), F.lit(3), 4).alias("far")).first()
    assert r.near == 0 and r.far == pytest.approx(2 * 0.6745, abs=1e-3)


def test_entropy(spark):
    r = spark.range(1).select(S.entropy([F.lit(2), F.lit(2)]).alias("e"), S.entropy([F.lit(4), F.lit(0)]).alias("z")).first()
    assert r.e == pytest.approx(1) and r.z == 0


def test_tiles_cover_the_end_and_pad(spark):
    lengths = spark.createDataFrame([(0, 10), (1, 3)], "series long, length long")
    got = {(r.series, r.start) for r in X.tile_starts(lengths, 4, 4).collect()}
    assert got == {(0, 0), (0, 4), (0, 6), (1, -1)}
    cells = X.tiled_windows(series(spark, [5, 6, 7]), 4, 4).orderBy("i").collect()
    assert [(r.value, r.label) for r in cells] == [(5, -1), (5, 0), (6, 0), (7, 0)]


def test_assemble_later_window_overwrites(spark):
    cells = spark.createDataFrame([(0, s, i, max(s + i, 0), float(s)) for s in (0, 5, -2) for i in range(5)], "series long, start long, i int, t long, score double")
    lengths = spark.createDataFrame([(0, 12)], "series long, length long")
    got = [r.score for r in X.assemble(cells, lengths).orderBy("t").collect()]
    assert got[5:10] == [5.0] * 5 and got[10:] == [0.0, 0.0]


def test_resolve_window():
    assert X.resolve_window(0.1, 512) == 51 and X.resolve_window(24, 10) == 10 and X.resolve_window(0.001, 100) == 4


def test_time_blocks_keep_the_gap():
    b = X.time_blocks(100, 5)
    assert b["residual"] == (80, 100) and b["shadow"][1] == 75 and b["train"][1] == b["shadow"][0] - 5


def test_state_key_slope(spark):
    k = X.state_key(series(spark, [0, 1, 2, 3, 4]), 5, 2).first()
    assert k.last == 4 and k.change == 4 and k.slope == pytest.approx(2.0) and k.recent_shift == pytest.approx(1.5)


def test_summary_slope(spark):
    s = X.summary_statistics(series(spark, [1, 3, 5, 7, math.nan]), 5).first()
    assert s.least == 0 and s.last == 0 and s.mean == pytest.approx(3.2)
