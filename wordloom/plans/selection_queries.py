"""Queries of rule selection: guided classes with their controls, and removal of rules; each with its DuckDB form.

Vectors are dealt to four folds by hash: 0 and 1 train, each scored by the centroids of the other; 2 validates and 3 tests,
scored by the centroids of both. The miner's words come from ``miner_events``, whose dictionary is mined on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.symbols import hash_order
from ..operators import reliability as L
from ..operators import rules as R
from ..operators import selection as S
from ..operators import windows as X
from ..operators.ordering import fixed
from . import evidence_queries as E
from .series_queries import r6

QUERIES: dict = {}
SQL: dict = {}
CLASSES, SMOOTHING, ALPHAS = 10, 0.05, (0.0, 0.05, 0.1, 0.2, 0.5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hash(c: str) -> str:
    return f"(({c} * 1103515245 + 12345) % 2147483648)"


EVENTS = f"""{E.KEY}, mi AS (SELECT series AS sample, 'ch=0|' || token AS word FROM ({E.SQL['miner_events']})),
be AS (SELECT DISTINCT sample, 'ch=0|loc=' || CASE WHEN en = 24 THEN 'recent' ELSE 'context' END || '|sax=' || array_to_string(w[en - 2:en], '.') AS token, false AS mined FROM (SELECT sample, w, unnest([3, 15, 24]) AS en FROM wd)
  UNION ALL SELECT sample, word, true FROM mi UNION ALL SELECT mi.sample, 'ch=0|loc=recent|sax=' || array_to_string(w[22:24], '.') || '&' || word, true FROM mi JOIN wd USING (sample))"""
FOLDS = f"""{EVENTS}, em AS (SELECT mode, sample, token FROM be, (SELECT unnest(['own', 'permuted', 'sax']) AS mode) WHERE NOT (mined AND mode = 'sax')),
fd AS (SELECT vec_id AS sample, label, {_hash('vec_id')} % 4 AS f FROM embeddings WHERE label IS NOT NULL),
ce AS (SELECT model, k, t, avg(value) AS c FROM (SELECT unnest([1 - f, 2]) AS model, fd.label AS k, t, value FROM emb JOIN fd ON fd.sample = series WHERE f < 2) GROUP BY ALL),
lg AS (SELECT fd.sample, fd.label AS y, f, k, -sum((value - c) ^ 2) AS logit FROM emb JOIN fd ON fd.sample = series JOIN ce ON ce.t = emb.t AND ce.model = least(f, 2) GROUP BY ALL),
pm AS (SELECT a.sample AS src, b.sample AS dst FROM (SELECT sample, row_number() OVER (ORDER BY sample) AS r FROM fd WHERE f < 2) b JOIN (SELECT sample, row_number() OVER (ORDER BY {_hash('sample')}, sample) AS r FROM fd WHERE f < 2) a USING (r))"""
RESIDUAL = f"""{FOLDS}, lx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY sample)) AS e FROM lg WHERE f < 2), pb AS (SELECT sample, y, k, e / sum(e) OVER (PARTITION BY sample) AS p FROM lx),
rv AS (SELECT sample, k AS h, greatest(-4.0, least(4.0, ln(CASE WHEN y = k THEN 1 ELSE 0 END * {1 - SMOOTHING}::DOUBLE + {SMOOTHING}::DOUBLE / {CLASSES}) - ln(p + 1e-12))) AS value FROM pb),
vm AS (SELECT mode, sample, h, value FROM rv, (SELECT unnest(['own', 'sax']) AS mode) UNION ALL SELECT 'permuted', dst, h, value FROM rv JOIN pm ON src = rv.sample),
gb AS (SELECT mode, h, avg(value) AS base FROM vm GROUP BY ALL), gs AS (SELECT mode, greatest(sqrt(avg((value - base) ^ 2)), 1e-6) AS scale FROM vm JOIN gb USING (mode, h) GROUP BY mode),
ru AS (SELECT mode, token, h, avg(value) AS value, count(*) AS support FROM em JOIN vm USING (mode, sample) GROUP BY ALL HAVING count(*) >= 8),
rs AS (SELECT mode, token, sqrt(avg((value - base) ^ 2)) / any_value(scale) * max(support) / (max(support) + 12.0) AS strength FROM ru JOIN gb USING (mode, h) JOIN gs USING (mode) GROUP BY ALL),
gl AS (SELECT h, base AS correction FROM gb WHERE mode = 'own')"""
PRIOR = f"""{FOLDS}, vm AS (SELECT mode, sample, label FROM fd, (SELECT unnest(['own', 'sax']) AS mode) WHERE f < 2 UNION ALL SELECT 'permuted', dst, label FROM fd JOIN pm ON src = fd.sample),
pr AS (SELECT label AS h, ln((count(*) + 1.0::DOUBLE) / (sum(count(*)) OVER () + count(*) OVER ())) AS lp, count(*) OVER () AS k FROM fd WHERE f < 2 GROUP BY label),
sp AS (SELECT mode, token, count(*) AS support FROM em JOIN vm USING (mode, sample) GROUP BY ALL HAVING count(*) >= 4), cn AS (SELECT mode, token, label AS h, count(*) AS c FROM em JOIN vm USING (mode, sample) GROUP BY ALL),
ru AS (SELECT sp.mode, sp.token, pr.h, ln((coalesce(c, 0) + 1.0::DOUBLE) / (support + k)) - lp AS value, support FROM sp CROSS JOIN pr LEFT JOIN cn ON cn.mode = sp.mode AND cn.token = sp.token AND cn.h = pr.h),
rs AS (SELECT mode, token, sqrt(avg(value ^ 2)) * max(support) / (max(support) + 8.0) AS strength FROM ru GROUP BY ALL), gl AS (SELECT h, lp - avg(lp) OVER () AS correction FROM pr)"""
CHOICE = f"""hd AS (SELECT mode, sample, token, strength FROM em JOIN rs USING (mode, token) QUALIFY row_number() OVER (PARTITION BY mode, sample ORDER BY round(strength, 9) DESC, token) <= 8),
cf AS (SELECT mode, sample, h, sum(strength * value) / greatest(sum(strength), 1e-12) AS correction FROM hd JOIN ru USING (mode, token) GROUP BY ALL),
cl AS (SELECT m.mode, lg.sample, y, f, k, logit, coalesce(correction, 0.0) AS correction, correction IS NOT NULL AS covered FROM lg CROSS JOIN (SELECT unnest(['own', 'sax', 'permuted']) AS mode) m LEFT JOIN cf ON cf.mode = m.mode AND cf.sample = lg.sample AND cf.h = k WHERE f >= 2
  UNION ALL SELECT 'global', sample, y, f, k, logit, correction, false FROM lg JOIN gl ON h = k WHERE f >= 2),
sv AS (SELECT *, logit + alpha * correction AS s FROM cl, (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha)), sx AS (SELECT *, exp(s - max(s) OVER (PARTITION BY mode, alpha, sample)) AS e FROM sv),
sc AS (SELECT mode, alpha, f, sample, -ln(sum(CASE WHEN k = y THEN e ELSE 0.0 END) / sum(e) + 1e-12) AS nll, CASE WHEN arg_min(k, (-s, k)) = any_value(y) THEN 1.0 ELSE 0.0 END AS ok, bool_or(covered) AS covered, avg(abs(alpha * correction)) AS change FROM sx GROUP BY ALL),
ag AS (SELECT mode, alpha, avg(nll) AS nll, avg(ok) AS accuracy FROM sc WHERE f = 2 GROUP BY ALL), al AS (SELECT *, accuracy + 1e-12 >= (SELECT accuracy FROM ag b WHERE b.mode = ag.mode AND alpha = 0) AS allowed FROM ag),
ch AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY allowed DESC, round(nll, 9), alpha) = 1 AS chosen FROM al)"""
GRID = "SELECT mode, alpha, round(nll, 6) AS nll, round(accuracy, 6) AS accuracy, allowed, chosen FROM ch"
REPORT = "SELECT mode, alpha, round(avg(sc.nll), 6) AS nll, round(avg(ok), 6) AS accuracy, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(change), 6) AS change FROM sc JOIN ch USING (mode, alpha) WHERE chosen AND f = 3 GROUP BY ALL"


def events(spark, d):
    active = E.miner_events(spark, d).select(F.col("series").alias("sample"), F.lit(0).alias("channel"), F.regexp_extract("token", r"=(\d+)", 1).alias("code"))
    return S.behaviour_events(E.words(spark, d), active)


def folds(spark, d):
    """(sample, y, f, h, logit): minus the squared distances to centroids that the sample had no part in."""
    e = X.vector_series(spark, d).where("label is not null").withColumn("f", hash_order("series") % 4)
    c = e.where("f < 2").select("label", "t", "value", F.explode(F.array(1 - F.col("f"), F.lit(2))).alias("model"))
    c = c.groupBy("model", F.col("label").alias("h"), "t").agg(F.avg("value").alias("c"))
    j = e.withColumn("model", F.least("f", F.lit(2))).join(c, ["model", "t"])
    return j.groupBy(F.col("series").alias("sample"), F.col("label").alias("y"), "f", "h").agg((-F.sum((F.col("value") - F.col("c")) ** 2)).alias("logit"))


def residual_cells(spark, d):
    lg = folds(spark, d)
    p = L.softmax(lg.where("f < 2"), "sample")
    v = p.select("sample", "h", R.log_residual(F.col("p"), (F.col("y") == F.col("h")).cast("int"), CLASSES, SMOOTHING).alias("value"))
    em = S.event_modes(fixed(events(spark, d)))
    found = S.references(em, S.value_rules(em, S.value_modes(v), 8))
    return S.correction_cells(lg.where("f >= 2"), found, v.groupBy("h").agg(F.avg("value").alias("correction")))


def prior_cells(spark, d):
    lg = folds(spark, d)
    y = lg.where("f < 2").select("sample", F.col("y").alias("label")).distinct()
    k = y.select(F.col("label").alias("h")).distinct()
    em = S.event_modes(fixed(events(spark, d)))
    found = S.references(em, S.prior_rules(em, S.value_modes(y), k))
    n = y.groupBy(F.col("label").alias("h")).agg(F.count("*").alias("c"))  # one row a class
    every = W.partitionBy()
    lp = n.select("h", F.log((F.col("c") + 1.0) / (F.sum("c").over(every) + F.count("*").over(every))).alias("lp"))
    return S.correction_cells(lg.where("f >= 2"), found, lp.select("h", (F.col("lp") - F.avg("lp").over(every)).alias("correction")))


def _of(cells, f):
    """The cells of one fold; folds are told by the sample's hash, as in ``folds``."""
    return cells.where(hash_order("sample") % 4 == f)


def _grid(cells):
    return S.guidance_grid(_of(cells, 2), ALPHAS)


def _rounded_grid(g):
    return g.select("mode", "alpha", r6("nll"), r6("accuracy"), "allowed", "chosen")


def _rounded_report(cells):
    cells = fixed(cells)
    r = S.guidance_report(_of(cells, 3), _grid(cells))
    return r.select("mode", "alpha", r6("nll"), r6("accuracy"), r6("coverage"), r6("change"))


@query(f"WITH {EVENTS} SELECT sample, token, mined FROM be")
def behaviour_events(spark, d):
    return events(spark, d)


@query(f"WITH {RESIDUAL}, {CHOICE} {GRID}")
def residual_guidance(spark, d):
    """Weights of out-of-fold residual rules and of their three controls, chosen on validation rows."""
    return _rounded_grid(_grid(residual_cells(spark, d)))


@query(f"WITH {RESIDUAL}, {CHOICE} {REPORT}")
def residual_guidance_report(spark, d):
    """What the chosen weights do on test rows, which took no part in rules or choice."""
    return _rounded_report(residual_cells(spark, d))


@query(f"WITH {PRIOR}, {CHOICE} {GRID}")
def prior_guidance(spark, d):
    """The same choice for class-prior shifts."""
    return _rounded_grid(_grid(prior_cells(spark, d)))


@query(f"WITH {PRIOR}, {CHOICE} {REPORT}")
def prior_guidance_report(spark, d):
    return _rounded_report(prior_cells(spark, d))


REMOVAL = f"""{E.CONT}, ctr AS (SELECT state, h, avg(level) AS level FROM fu JOIN ss USING (sample) GROUP BY ALL), sr AS (SELECT token, state, confidence * ln(greatest(lift, 1.0)) * support / (support + 12.0) AS score FROM cu),
m0 AS (SELECT sample, token, state, score, row_number() OVER (PARTITION BY sample ORDER BY round(score, 9) DESC, token, state) AS r, count(*) OVER (PARTITION BY sample) AS n FROM ev2 JOIN sr USING (token) WHERE score > 0),
bl AS (SELECT sample, 'all' AS variant, NULL AS gone FROM (SELECT DISTINCT sample FROM m0) UNION ALL SELECT sample, 'best', token FROM m0 WHERE r = 1 UNION ALL SELECT sample, 'random', token FROM m0 WHERE r = {_hash('sample')} % least(n, 8) + 1),
m1 AS (SELECT variant, m0.sample, state, score FROM m0 JOIN bl USING (sample) WHERE gone IS NULL OR token <> gone QUALIFY row_number() OVER (PARTITION BY variant, m0.sample ORDER BY r) <= 8),
fc AS (SELECT variant, sample, h, sum(score * level) / sum(score) AS forecast, least(max(score), 1.0) AS reliability FROM m1 JOIN ctr USING (state) GROUP BY ALL)"""


def removal_forecasts(spark, d):
    s, e, f, c = E.states(spark, d)
    r = R.continuation_rules(e, s).withColumn("score", F.col("confidence") * F.log(F.greatest("lift", F.lit(1.0))) * F.col("support") / (F.col("support") + 12.0))
    centres = f.join(s, "sample").groupBy("state", "h").agg(F.avg("level").alias("level"))
    return S.removals(e, r, centres), f, c


@query(f"WITH {REMOVAL} SELECT variant, sample, h, round(forecast, 5) AS forecast, round(reliability, 6) AS reliability FROM fc")
def rule_removals(spark, d):
    return removal_forecasts(spark, d)[0].select("variant", "sample", "h", F.round("forecast", 5).alias("forecast"), r6("reliability"))


@query(f"""WITH {REMOVAL}, mv AS (SELECT fu.sample, fu.h, coalesce(max(CASE WHEN variant = 'all' THEN reliability * (forecast - base) END), 0.0) AS a, coalesce(max(CASE WHEN variant = 'best' THEN reliability * (forecast - base) END), 0.0) AS b,
  coalesce(max(CASE WHEN variant = 'random' THEN reliability * (forecast - base) END), 0.0) AS c, bool_or(coalesce(variant = 'all', false)) AS m FROM fu JOIN ls ON ls.sample = fu.sample LEFT JOIN fc ON fc.sample = fu.sample AND fc.h = fu.h GROUP BY ALL)
SELECT round(0.2 * avg(abs(a - b)), 6) AS best_change, round(0.2 * avg(abs(a - c)), 6) AS random_change, round(avg(abs(a - b)) / greatest(avg(abs(a - c)), 5e-12), 4) AS ratio, count(DISTINCT sample) FILTER (m) AS matched FROM mv""")
def removal_effect(spark, d):
    """How much more a forecast moves without its strongest rule than without a random matched one, at weight 0.2."""
    r, f, c = removal_forecasts(spark, d)
    base = f.join(c.groupBy("sample").agg(F.max_by("value", "i").alias("base")), "sample").select("sample", "h", "base")
    return S.removal_effect(r, base, 0.2).select(r6("best_change"), r6("random_change"), F.round("ratio", 4).alias("ratio"), "matched")
