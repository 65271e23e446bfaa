"""Queries of windows, symbols, splits and metrics, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.symbols import breakpoints, fourier_rows, hash_order, paa_weights
from ..operators import metrics as M
from ..operators import windows as X
from .sqltext import DAILY, EMB, EV, FM, lit, sax, sym

QUERIES: dict = {}
SQL: dict = {}
B4 = breakpoints(4)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def recon(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, label, score): the stand-in reconstruction error."""
    e = X.event_series(spark, d)
    err = F.col("value") - F.avg("value").over(W.partitionBy("series", F.floor(F.col("t") / 3)))
    return e.select("series", "t", "label", F.round(err * err, 6).alias("score"))


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query(f"WITH {EV}, {sax('ev', 24, 8, B4)} SELECT series, t, word, code FROM sw")
def sax_words(spark, d):
    return X.sax_words(X.event_series(spark, d)).select("series", "t", "word", "code")


@query(f"WITH {EV}, {sax('ev', 24, 8, B4)} SELECT series, t, word, code FROM sw")
def sax_words_blocked(spark, d):
    """The same words from blocks of 32 points, each with the 23 points after it, as for series too long for one task."""
    return X.over_blocks(X.event_series(spark, d), 24, 32, X.sax_words).select("series", "t", "word", "code")


@query(f"WITH {EV}, {sax('ev', 24, 8, B4)} SELECT word, count(*) AS n FROM sw GROUP BY word")
def sax_word_histogram(spark, d):
    return X.sax_words(X.event_series(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


def _fractional() -> str:
    cols = ", ".join(" + ".join(f"lead(value, {i}) OVER w * {lit(wt)}" for i, wt in share) + f" AS m{j}" for j, share in enumerate(paa_weights(10, 4)))
    s = ", ".join(f"round((m{j} - mean) / CASE WHEN sd < 1e-8 THEN NULL ELSE sd END, 6) AS z{j}" for j in range(4))
    return f"WITH {EV}, x AS (SELECT series, t, count(*) OVER f AS n, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS sd, {cols} FROM ev WINDOW w AS (PARTITION BY series ORDER BY t), f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT series, t, {s} FROM x WHERE n = 10 AND t % 2 = 0"


@query(_fractional())
def sax_fractional_paa(spark, d):
    df, spec = X.sliding(X.event_series(spark, d), 10)
    df = X.complete(df.select("series", "t", "n", "mean", "sd", *[m.alias(f"m{j}") for j, m in enumerate(X.segment_means("value", 10, 4, spec))]), 10, 2)
    return df.select("series", "t", *[F.round((F.col(f"m{j}") - F.col("mean")) / F.when(F.col("sd") >= 1e-8, F.col("sd")), 6).alias(f"z{j}") for j in range(4)])


@query(f"""WITH {EV}, l AS (SELECT series, count(*) AS n FROM ev GROUP BY series),
s AS (SELECT DISTINCT series, unnest(CASE WHEN n < 60 THEN [n - 60] ELSE list_append(range(0, n - 59, 25), n - 60) END) AS start FROM l),
c AS (SELECT series, start, i, greatest(start + i, 0) AS t FROM (SELECT series, start, unnest(range(60)) AS i FROM s))
SELECT c.series, start, sum(CASE WHEN start + i < 0 THEN 1 ELSE 0 END)::BIGINT AS padded, round(avg(value), 6) AS mean, max(CASE WHEN start + i < 0 THEN -1 ELSE label END) AS label FROM c JOIN ev USING (series, t) GROUP BY ALL""")
def windows_tiled(spark, d):
    c = X.tiled_windows(X.event_series(spark, d), 60, 25)
    return c.groupBy("series", "start").agg(F.sum(F.when(F.col("start") + F.col("i") < 0, 1).otherwise(0)).alias("padded"), F.round(F.avg("value"), 6).alias("mean"), F.max("label").alias("label"))


@query(f"""WITH {EV}, l AS (SELECT series, count(*) AS n FROM ev GROUP BY series),
s AS (SELECT DISTINCT series, n, unnest(CASE WHEN n < 60 THEN [n - 60] ELSE list_append(range(0, n - 59, 25), n - 60) END) AS start FROM l),
c AS (SELECT series, start, start + i AS t, (start + i) * 0.5 + start AS score FROM (SELECT series, start, unnest(range(60)) AS i FROM s) WHERE start + i >= 0),
m AS (SELECT series, t, arg_max(score, start) AS score FROM c GROUP BY ALL)
SELECT series, t, coalesce(score, 0.0)::DOUBLE AS score FROM ev LEFT JOIN m USING (series, t)""")
def assembled_scores(spark, d):
    e = X.event_series(spark, d)
    cells = X.tiled_windows(e, 60, 25).withColumn("score", (F.col("start") + F.col("i")) * 0.5 + F.col("start"))
    return X.assemble(cells, e.groupBy("series").agg(F.count("*").alias("length")))


def _fourier(src: str, w: int, n: int) -> str:
    rows = fourier_rows(w, n)
    lead = ", ".join(f"lead(value, {i}) OVER w AS x{i}" for i in range(w))
    cs = ", ".join("CASE WHEN sd < 1e-8 THEN 0.0 ELSE " + " + ".join(f"((x{i} - mean) / sd) * {lit(r[i])}" for i in range(w)) + f" END AS c{k}" for k, r in enumerate(rows))
    return f"""fw AS (SELECT series, label, t, count(*) OVER f AS n, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS sd, {lead} FROM {src} WINDOW w AS (PARTITION BY series ORDER BY t), f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
fc AS (SELECT series, label, t, sd < 1e-8 AS flat, {cs} FROM fw WHERE n = {w})"""


FOURIER = _fourier("emb", 8, 4)
SFA = f"""{EMB}, {FOURIER}, ed AS (SELECT {', '.join(f'quantile_cont(c{k}, [0.25, 0.5, 0.75]) AS e{k}' for k in range(4))} FROM fc),
fs AS (SELECT series, label, t, flat, {', '.join('(' + ' + '.join(f'CASE WHEN c{k} >= e{k}[{q}] THEN 1 ELSE 0 END' for q in (1, 2, 3)) + f') AS s{k}' for k in range(4))} FROM fc, ed),
sfa AS (SELECT *, {' || '.join(f'chr((97 + s{k})::INTEGER)' for k in range(4))} AS word, s0::BIGINT * 64 + s1 * 16 + s2 * 4 + s3 AS code FROM fs)"""


def embedding_coefs(spark, d):
    return X.fourier_windows(X.packed_vectors(spark, d), 8, 4, carry=("label",))


def embedding_edges(spark, d):
    return X.sfa_edges(embedding_coefs(spark, d))


def embedding_sfa_and_zero(spark, d):
    """The SFA words of every vector and the code of the zero vector, under edges fitted once."""
    return X.fitted_sfa_words(embedding_coefs(spark, d), carry=("label",), keep=False)


def embedding_sfa(spark, d):
    return embedding_sfa_and_zero(spark, d)[0]


@query(f"WITH {EMB}, {FOURIER}, ed AS ({' UNION ALL '.join(f'SELECT {k} AS position, quantile_cont(c{k}, [0.25, 0.5, 0.75]) AS e FROM fc' for k in range(4))}) SELECT position, q - 1 AS q, round(e[q], 6) AS edge FROM (SELECT position, e, unnest([1, 2, 3]) AS q FROM ed)")
def sfa_edges(spark, d):
    return X.sfa_edges(embedding_coefs(spark, d)).select("position", "q", r6("edge"))


@query(f"WITH {SFA} SELECT series, t, word, code FROM sfa")
def sfa_words(spark, d):
    return embedding_sfa(spark, d).select("series", "t", "word", "code")


def _weights(length: int, n: int) -> str:
    return "wt(t, segment, weight) AS (VALUES " + ", ".join(f"({i}, {j}, {lit(w)})" for j, share in enumerate(paa_weights(length, n)) for i, w in share) + ")"


@query(f"""WITH {EMB}, {_weights(64, 24)}, st AS (SELECT series, avg(value) AS mean, stddev_pop(value) AS sd FROM emb GROUP BY series),
l AS (SELECT series, segment, sum(value * weight) AS level FROM emb JOIN wt USING (t) GROUP BY ALL)
SELECT series, segment, {sym('((level - mean) / sd)', B4)} AS symbol FROM l JOIN st USING (series)""")
def ordered_sax_key(spark, d):
    return X.context_key(X.vector_series(spark, d), 64)


@query(f"""WITH {DAILY}, st AS (SELECT DISTINCT t AS start FROM daily WHERE t + 89 <= (SELECT max(t) FROM daily)), x AS (SELECT channel, start, t - start AS t, value, (t - start) * 2.0 / 89 - 1.0 AS x FROM daily JOIN st ON t BETWEEN start AND start + 89)
SELECT channel, start, round(arg_max(value, t) + 1e-7, 4) AS last, round(avg(value) + 1e-7, 4) AS mean, round(stddev_pop(value) + 1e-7, 4) AS sd, round(arg_max(value, t) - arg_min(value, t) + 1e-7, 4) AS change,
round(avg(value) FILTER (t >= 66) - avg(value) + 1e-7, 4) AS recent_shift, round(avg(x * value) / avg(x * x) + 1e-7, 4) AS slope FROM x GROUP BY channel, start""")
def forecast_state_key(spark, d):
    """One row for each channel and each 90 days from day ``start`` on."""
    p = X.daily_series(spark, d)
    end = p.agg((F.max("t") - 89).alias("last"))
    starts = F.sequence(F.greatest(F.col("t") - 89, F.lit(0)), F.least("t", "last"))
    p = p.join(F.broadcast(end)).where("last >= greatest(t - 89, 0)").select("channel", "t", "value", F.explode(starts).alias("start"))
    k = X.state_key(p.withColumn("t", F.col("t") - F.col("start")), 90, keys=("channel", "start"))
    # cents over 24 and 90 days end in ties of the fifth decimal; the shift settles them
    return k.select("channel", "start", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("last", "mean", "sd", "change", "recent_shift", "slope")])


@query(f"""WITH {EMB}, x AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series ORDER BY t)) AS step, t - 31.5 AS x FROM emb)
SELECT series, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, round(arg_max(value, t), 6) AS last,
round(sum(x * value) / sum(x * x), 6) AS slope, round(avg(step), 6) AS mean_step, round(avg(value) FILTER (t >= 48) - avg(value), 6) AS late_shift FROM x GROUP BY series""")
def summary_statistics(spark, d):
    s = X.summary_statistics(X.vector_series(spark, d), 64)
    return s.select("series", *[r6(c) for c in ("mean", "sd", "least", "most", "last", "slope", "mean_step", "late_shift")])


@query(f"WITH {DAILY}, v AS (SELECT t // 200 AS block, channel, stddev_pop(value) AS sd FROM daily WHERE t % 200 >= 150 GROUP BY ALL) SELECT block, round(avg(sd), 4) AS volatility FROM v GROUP BY block")
def context_volatility(spark, d):
    p = X.daily_series(spark, d).select(F.floor(F.col("t") / 200).alias("block"), "channel", (F.col("t") % 200).alias("t"), "value")
    return X.volatility(p, 200, ("block",)).select("block", F.round("volatility", 4).alias("volatility"))


@query(f"""WITH {DAILY}, x AS (SELECT channel, t, count(value) OVER f AS n, (avg(value) OVER f - avg(value) OVER l) / (stddev_pop(value) OVER c + 1e-8) AS delta FROM daily
WINDOW c AS (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING), l AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 72 FOLLOWING AND 95 FOLLOWING), f AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 96 FOLLOWING AND 119 FOLLOWING)),
y AS (SELECT * FROM x WHERE n = 24), q AS (SELECT quantile_cont(delta, [{lit(1 / 3)}, {lit(2 / 3)}]) AS e FROM y)
SELECT channel, CASE WHEN delta >= e[1] THEN 1 ELSE 0 END + CASE WHEN delta >= e[2] THEN 1 ELSE 0 END AS direction, count(*) AS n, round(avg(delta), 5) AS mean_delta FROM y, q GROUP BY ALL""")
def future_direction_labels(spark, d):
    f = X.future_direction(X.daily_series(spark, d), 96, 24)
    return f.groupBy("channel", "direction").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 5).alias("mean_delta"))


H = "((vec_id * 1103515245 + 12345) % 2147483648)"


@query(f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {H}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return X.stratified_split(X.read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.2)


@query(f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {H}, vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
k AS (SELECT least(5, min(n)) AS k FROM r), s AS (SELECT vec_id, label, r, k, n % k AS big, n // k AS size FROM r, k)
SELECT vec_id, label, (CASE WHEN r < big * (size + 1) THEN r // (size + 1) ELSE big + (r - big * (size + 1)) // size END)::INTEGER AS fold FROM s""")
def oof_folds(spark, d):
    return X.oof_folds(X.read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 5)


@query(f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {H}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, label FROM r WHERE n <= 120 OR r <= greatest(1, round_even(120.0::DOUBLE * c / n, 0))""")
def stratified_subsample(spark, d):
    return X.stratified_sample(X.read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 120)


@query("""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, count(*) OVER () AS n FROM embeddings), w AS (SELECT DISTINCT round_even(i * ((SELECT count(*) FROM embeddings) - 1) / 49.0::DOUBLE, 0)::BIGINT AS rank FROM (SELECT unnest(range(50)) AS i))
SELECT vec_id FROM r JOIN w USING (rank)""")
def even_subset(spark, d):
    return X.even_subset(X.read(spark, d, "embeddings").select("vec_id"), "vec_id", 50)


@query(f"""WITH {EMB}, g AS (SELECT series, i, i * (63.0::DOUBLE / 39) AS p FROM (SELECT DISTINCT series FROM emb), (SELECT unnest(range(40)) AS i)), h AS (SELECT series, i, p, floor(p)::BIGINT AS lo, least(floor(p)::BIGINT + 1, 63) AS hi FROM g)
SELECT h.series, i, round(a.value + (b.value - a.value) * (p - lo), 6) AS value, 1 AS mask FROM h JOIN emb a ON a.series = h.series AND a.t = lo JOIN emb b ON b.series = h.series AND b.t = hi""")
def resampled_input(spark, d):
    return X.model_input(X.vector_series(spark, d), 64, 40, "resample").select("series", "i", r6("value"), "mask")


def predicted(spark, d):
    s = recon(spark, d)
    return s.withColumn("pred", (F.col("score") > 500.0).cast("int"))


CURVE = f"""{EV}, {FM}, g AS (SELECT series, score, sum(label) AS p, sum(1 - label) AS q FROM fm GROUP BY ALL),
cv AS (SELECT series, score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY series) AS pos, sum(q) OVER (PARTITION BY series) AS neg FROM g WINDOW w AS (PARTITION BY series ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cc AS (SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + pos) ELSE 0.0 END AS f1 FROM cv WHERE pos > 0 AND neg > 0),
ap AS (SELECT series, sum(gain::DOUBLE / pos * tp / (tp + fp)) AS ap FROM (SELECT *, tp - coalesce(lag(tp) OVER (PARTITION BY series ORDER BY score DESC), 0) AS gain FROM cc) GROUP BY series),
bf AS (SELECT series, max(f1) AS best_f1 FROM cc GROUP BY series)"""


@query(f"WITH {CURVE} SELECT series, round(ap, 6) AS ap FROM ap")
def average_precision(spark, d):
    return M.average_precision(recon(spark, d)).select("series", r6("ap"))


@query(f"WITH {CURVE} SELECT series, round(best_f1, 6) AS best_f1, round(min(score), 5) AS threshold FROM cc JOIN bf USING (series) WHERE f1 = best_f1 GROUP BY ALL")
def best_f1_protocol(spark, d):
    return M.best_f1_exact(recon(spark, d)).select("series", r6("best_f1"), F.round("threshold", 5).alias("threshold"))


@query(f"WITH {CURVE} SELECT round(avg(best_f1), 6) AS best_f1, round(avg(ap), 6) AS ap, count(*) AS n_entities FROM bf JOIN ap USING (series)")
def anomaly_metrics(spark, d):
    return M.anomaly_metrics(recon(spark, d)).select(r6("best_f1"), r6("ap"), "n_entities")


def _grid(n: int, low: float, end: bool) -> str:
    return "[" + ", ".join(lit(low + (1 - low) * k / ((n - 1) if end else n)) for k in range(n)) + "]"


@query(f"""WITH {EV}, {FM}, q AS (SELECT series, unnest(quantile_cont(score, {_grid(200, 0.5, False)})) AS thr FROM fm GROUP BY series),
c AS (SELECT series, thr, sum(CASE WHEN score > thr THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > thr THEN 1 - label ELSE 0 END) AS fp, sum(label) AS pos, sum(1 - label) AS neg FROM fm JOIN q USING (series) GROUP BY ALL)
SELECT series, round(max(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + pos) ELSE 0.0 END), 6) AS best_f1 FROM c WHERE pos > 0 AND neg > 0 GROUP BY series""")
def best_f1_grid(spark, d):
    return M.best_f1_grid(recon(spark, d)).select("series", r6("best_f1"))


ISLAND = """rise AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY series ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS r FROM fm),
isl AS (SELECT *, CASE WHEN label = 1 THEN sum(r) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) END AS island FROM rise)"""


@query(f"WITH {EV}, {FM}, {ISLAND} SELECT series, t, label, CASE WHEN score > 500.0 THEN 1 ELSE 0 END AS pred, CASE WHEN label = 1 THEN max(CASE WHEN score > 500.0 THEN 1 ELSE 0 END) OVER (PARTITION BY series, island) ELSE CASE WHEN score > 500.0 THEN 1 ELSE 0 END END AS adjusted FROM isl")
def point_adjust(spark, d):
    return M.point_adjust(predicted(spark, d)).select("series", "t", "label", "pred", "adjusted")


@query(f"WITH {EV}, {FM}, {ISLAND} SELECT series, min(t) AS start, max(t) + 1 AS \"end\" FROM isl WHERE label = 1 GROUP BY series, island")
def label_spans(spark, d):
    return M.label_spans(recon(spark, d))


@query(f"""WITH {EV}, {FM}, {ISLAND}, ra AS (SELECT series, label, CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY series, island) ELSE score END AS score FROM isl),
q AS (SELECT series, unnest(quantile_cont(score, {_grid(512, 0.0, True)})) AS thr FROM fm GROUP BY series),
c AS (SELECT series, thr, sum(CASE WHEN score >= thr THEN label ELSE 0 END) AS tp, sum(CASE WHEN score >= thr THEN 1 - label ELSE 0 END) AS fp, sum(label) AS pos, sum(1 - label) AS neg FROM ra JOIN q USING (series) GROUP BY ALL)
SELECT series, round(max(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (tp + fp + pos) ELSE 0.0 END), 6) AS best_f1 FROM c WHERE pos > 0 AND neg > 0 GROUP BY series""")
def adjusted_best_f1(spark, d):
    return M.adjusted_best_f1(recon(spark, d)).select("series", r6("best_f1"))


@query(f"""WITH {EV}, {FM}, c AS (SELECT count(*) FILTER (label = 1 AND score > 500.0) AS tp, count(*) FILTER (label = 0 AND score > 500.0) AS fp, count(*) FILTER (label = 1 AND score <= 500.0) AS fn, count(*) FILTER (label = 0 AND score <= 500.0) AS tn FROM fm)
SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM c""")
def alarm_rates(spark, d):
    return M.false_alarm_rate(predicted(spark, d)).select(*[r6(c) for c in ("precision", "recall", "f1", "fpr")])


CENTROID = f"""{EMB}, tr AS (SELECT vec_id AS series, {H} % 4 = 0 AS test FROM embeddings),
ce AS (SELECT label AS k, t, avg(value) AS c FROM emb JOIN tr USING (series) WHERE NOT test GROUP BY ALL),
lg AS (SELECT series, label AS y, k, -sum((value - c) ^ 2) AS logit FROM emb JOIN tr USING (series) JOIN ce USING (t) WHERE test GROUP BY ALL),
pr AS (SELECT series, y, arg_min(k, (-logit, k)) AS pred FROM lg GROUP BY ALL)"""


def logits(spark, d) -> DataFrame:
    """(series, y, k, logit): minus the squared distance of a held-out vector to each class's training centroid."""
    e = X.vector_series(spark, d)
    test = hash_order("series") % 4 == 0
    centre = e.where(~test).groupBy(F.col("label").alias("k"), "t").agg(F.avg("value").alias("c"))
    return e.where(test).join(F.broadcast(centre), "t").groupBy("series", F.col("label").alias("y"), "k").agg((-F.sum((F.col("value") - F.col("c")) * (F.col("value") - F.col("c")))).alias("logit"))


@query(f"""WITH {CENTROID}, c AS (SELECT c, (SELECT count(*) FROM pr WHERE y = c) AS ny, (SELECT count(*) FROM pr WHERE pred = c) AS np, (SELECT count(*) FROM pr WHERE y = c AND pred = c) AS hit FROM (SELECT y AS c FROM pr UNION SELECT pred FROM pr))
SELECT round(sum(hit) / sum(ny), 6) AS accuracy, round(avg(coalesce(hit / nullif(np, 0), 0)), 6) AS macro_precision, round(avg(coalesce(hit / nullif(ny, 0), 0)), 6) AS macro_recall, round(avg(2.0 * hit / (ny + np)), 6) AS macro_f1 FROM c""")
def classification_metrics(spark, d):
    best = logits(spark, d).groupBy("series", "y").agg(F.min(F.struct((-F.col("logit")).alias("m"), F.col("k").alias("pred"))).alias("b"))
    return M.classification_metrics(best.select("y", "b.pred")).select(*[r6(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query(f"""WITH {DAILY}, p AS (SELECT channel, value AS y, lag(value, 7) OVER (PARTITION BY channel ORDER BY t) AS pred FROM daily)
SELECT channel, round(avg((pred - y) ^ 2) / 1e6, 4) AS mse, round(avg(abs(pred - y)), 4) AS mae FROM p WHERE pred IS NOT NULL GROUP BY channel""")
def forecasting_metrics(spark, d):
    p = X.daily_series(spark, d).select("channel", F.col("value").alias("y"), F.lag("value", 7).over(W.partitionBy("channel").orderBy("t")).alias("pred")).where("pred is not null")
    return M.forecasting_metrics(p, ("channel",)).select("channel", F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("mae", 4).alias("mae"))


RISK = f"""{CENTROID}, mx AS (SELECT series, max(logit) AS m FROM lg GROUP BY series), pb AS (SELECT series, y, k, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY series) AS p FROM lg JOIN mx USING (series)),
rk AS (SELECT pb.series AS id, round(-max(p), 9) AS score, max(CASE WHEN pr.pred = pb.y THEN 0.0 ELSE 1.0 END)::DOUBLE AS loss FROM pb JOIN pr USING (series) GROUP BY pb.series),
o AS (SELECT row_number() OVER a AS k, avg(loss) OVER (ORDER BY score, id ROWS UNBOUNDED PRECEDING) AS risk, count(*) OVER () AS n, avg(loss) OVER () AS base FROM rk WINDOW a AS (ORDER BY score, id)),
b AS (SELECT avg(risk) AS oracle FROM (SELECT avg(loss) OVER (ORDER BY loss, id ROWS UNBOUNDED PRECEDING) AS risk FROM rk))"""


def confidence(spark, d) -> DataFrame:
    """(id, score, loss): score is minus the largest class probability, loss 1 for a wrong class."""
    w = W.partitionBy("series")
    p = logits(spark, d).withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.groupBy(F.col("series").alias("id")).agg(F.round(-F.max("p"), 9).alias("score"), F.when(F.min(F.struct((-F.col("logit")).alias("m"), "k"))["k"] == F.first("y"), 0.0).otherwise(1.0).alias("loss"))


@query(f"WITH {RISK} SELECT c / 20.0::DOUBLE AS coverage, round(risk, 6) AS risk FROM o, (SELECT unnest(range(1, 21)) AS c) WHERE k = ceil(c * n / 20.0)")
def risk_coverage_curve(spark, d):
    return M.risk_coverage(confidence(spark, d))[0].select("coverage", r6("risk"))


@query(f"WITH {RISK} SELECT round(avg(risk), 6) AS aurc, round(min(oracle), 6) AS oracle_aurc, round(avg(risk) - min(oracle), 6) AS excess, round(min(base) - avg(risk), 6) AS gain FROM o, b")
def risk_coverage_summary(spark, d):
    return M.risk_coverage(confidence(spark, d))[1].select(*[r6(c) for c in ("aurc", "oracle_aurc", "excess", "gain")])


@query(f"""WITH {EV}, {FM}, tp AS (SELECT series, arg_min(t, (-score, t)) AS peak FROM fm GROUP BY series)
SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM fm WHERE fm.series = tp.series AND label = 1 AND abs(t - peak) <= 2) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM tp""")
def top1_hit(spark, d):
    return M.top1_hit(recon(spark, d), 2).select(r6("hit_rate"))
