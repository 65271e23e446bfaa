"""Queries of word mining and novelty, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.symbols import breakpoints
from ..operators import metrics as M
from ..operators import mining as G
from ..operators import novelty as N
from ..operators import windows as X
from .series_queries import SFA, embedding_sfa, embedding_sfa_and_zero, r6
from .sqltext import DAILY, EMB, EV, lit, sax

QUERIES: dict = {}
SQL: dict = {}
B4 = breakpoints(4)
MASKS = G.projection_masks(4, 1, 6, 0)
FLAT4 = 2 * 85  # the SAX word of the zero vector: zero lies on the middle edge and goes up
#: The SFA word of the zero vector under the fitted edges.
ZERO = f"(SELECT {' + '.join(f'(CASE WHEN 0.0 >= e{k}[1] THEN 1 ELSE 0 END + CASE WHEN 0.0 >= e{k}[2] THEN 1 ELSE 0 END + CASE WHEN 0.0 >= e{k}[3] THEN 1 ELSE 0 END) * {4 ** (3 - k)}' for k in range(4))} FROM ed)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, d):
    """Every vector as a packed series, whatever its class."""
    return X.packed_vectors(spark, d)


def classes(spark, d):
    """The labels of the table in order."""
    return [r.label for r in X.read(spark, d, "embeddings").where("label is not null").select("label").distinct().orderBy("label").collect()]


def vector_words(spark, d):
    """The codes and symbols of every vector's words, made once a query."""
    return X.sax_words(vectors(spark, d), 8, 4, 4, carry=("label",)).drop("word").cache()


SW = f"{EMB}, e3 AS (SELECT * FROM emb), {sax('e3', 8, 4, B4, extra=', label')}"
NSER = "(SELECT count(DISTINCT series) FROM sw)"


@query(f"""WITH {SW}, rk AS (SELECT series, label, row_number() OVER (PARTITION BY label ORDER BY (series * 1103515245 + 12345) % 2147483648, series) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT series, label FROM sw)),
hf AS (SELECT series, CASE WHEN r <= round_even(n * 0.5, 0) THEN 1 ELSE 0 END AS half FROM rk), wh AS (SELECT series, t, code, half FROM sw JOIN hf USING (series)), nh AS (SELECT half, count(*) AS n FROM wh GROUP BY half),
rt AS (SELECT 1 - half AS half, code, -ln(count(*) / any_value(n)::DOUBLE) AS r FROM wh JOIN nh USING (half) GROUP BY half, code),
x AS (SELECT series, t, coalesce(r, ln(1.0 + n)) AS r FROM wh LEFT JOIN rt USING (half, code) JOIN (SELECT 1 - half AS half, n FROM nh) USING (half))
SELECT series, round(max(r), 6) AS rarity, arg_min(t, (-r, t)) AS location FROM x GROUP BY series""")
def word_rarity(spark, d):
    """Every series against the words of the other half of each class, the halves scored in turn."""
    w = vector_words(spark, d)
    half = X.stratified_split(w.select("series", "label").distinct(), "series", "label", 0.5).select("series", "split")
    w = w.join(F.broadcast(half), "series").cache()
    parts = []
    for scored in ("val", "train"):
        train = w.where(F.col("split") != scored)
        parts.append(G.rarity(w.where(F.col("split") == scored), G.rarity_table(train), F.lit(train.count())))
    return parts[0].unionByName(parts[1]).select("series", r6("rarity"), "location")


@query(f"WITH {SFA}, b AS (SELECT *, lag(code) OVER (PARTITION BY series ORDER BY t) AS p FROM sfa) SELECT series, word, count(*) AS n FROM b WHERE p IS NULL OR p <> code GROUP BY ALL")
def numerosity_reduced_bag(spark, d):
    return G.reduced(embedding_sfa(spark, d)).groupBy("series", "word").agg(F.count("*").alias("n"))


@query(f"WITH {SFA} SELECT series, word, count(*) AS n FROM sfa GROUP BY ALL")
def bag_of_words(spark, d):
    return embedding_sfa(spark, d).groupBy("series", "word").agg(F.count("*").alias("n"))


def _mask_sql() -> str:
    parts = [f"SELECT series, label, code, {k} AS mask, {' + '.join(f's{j}::BIGINT * {4 ** (len(m) - 1 - i)}' for i, j in enumerate(m))} AS key FROM sw" for k, m in enumerate(MASKS)]
    return f"""mk AS ({' UNION '.join(parts)}), pk AS (SELECT mask, key, label, count(DISTINCT series) AS n FROM mk GROUP BY ALL),
vk AS (SELECT DISTINCT code, mask, key FROM mk), co AS (SELECT code, label, sum(n)::BIGINT AS n FROM vk JOIN pk USING (mask, key) GROUP BY ALL)"""


COLL = f"{SW}, {_mask_sql()}"
ELIG = f"el AS (SELECT code, count(DISTINCT series) / {NSER}::DOUBLE AS support FROM sw GROUP BY code HAVING bool_or(NOT flat) AND code <> {FLAT4})"


@query(f"WITH {COLL} SELECT code, label, n FROM co")
def sax_collisions(spark, d):
    return G.collisions(vector_words(spark, d), MASKS, 4)


@query(f"""WITH {COLL}, {ELIG}, p AS (SELECT code, sum(n) / ({len(MASKS)}.0::DOUBLE * {NSER}) AS p FROM co GROUP BY code),
r AS (SELECT row_number() OVER (ORDER BY round(p, 9) DESC, round(support, 9) DESC, code) AS rank, code, support, p FROM el JOIN p USING (code))
SELECT rank, code, round(support, 6) AS support, round(p, 6) AS p FROM r WHERE rank <= 10""")
def motif_top_k(spark, d):
    w = vector_words(spark, d)
    return G.motifs(w, G.collisions(w, MASKS, 4), FLAT4, len(MASKS), 10).select("rank", "code", r6("support"), r6("p"))


CAND = f"""{COLL}, {ELIG}, lb AS (SELECT label, count(DISTINCT series) AS n FROM sw GROUP BY label),
pp AS (SELECT v.code, lb.label, coalesce(co.n, 0) / ({len(MASKS)}.0::DOUBLE * lb.n) AS p FROM (SELECT DISTINCT code FROM co) v CROSS JOIN lb LEFT JOIN co ON co.code = v.code AND co.label = lb.label),
sc AS (SELECT code, max(p - o) AS score, arg_min(label, (-round(p, 9), label)) AS dominant FROM (SELECT *, (sum(p) OVER (PARTITION BY code) - p) / greatest(1, count(*) OVER (PARTITION BY code) - 1) AS o FROM pp) GROUP BY code),
cd AS (SELECT code, score, dominant, support FROM sc JOIN el USING (code) ORDER BY round(score, 9) DESC, code LIMIT 15)"""


@query(f"WITH {CAND} SELECT code, round(score, 6) AS score, dominant FROM cd")
def shapelet_candidates(spark, d):
    w = vector_words(spark, d)
    labels = w.select("series", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    s = G.candidate_scores(G.collisions(w, MASKS, 4), labels, len(MASKS)).join(G.eligible(w, FLAT4), "code")
    return s.orderBy(F.desc(F.round("score", 9)), "code").limit(15).select("code", r6("score"), "dominant")


def _z(src: str) -> str:
    lead = ", ".join(f"lead(value, {i}) OVER w AS x{i}" for i in range(8))
    zs = ", ".join(f"CASE WHEN sd < 1e-8 THEN 0.0 ELSE (x{i} - mean) / sd END AS z{i}" for i in range(8))
    return f"""zw0 AS (SELECT series, label, t, count(*) OVER f AS n, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS sd, {lead} FROM {src} WINDOW w AS (PARTITION BY series ORDER BY t), f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
zw AS (SELECT series, label, t, sd < 1e-8 AS flat, {zs} FROM zw0 WHERE n = 8)"""


DIST = f"""{CAND}, {_z('e3')}, rp0 AS (SELECT code AS query, arg_min({{'s': sw.series, 't': sw.t}}, (CASE WHEN label = dominant THEN 0 ELSE 1 END, sw.series, sw.t)) AS m FROM sw JOIN cd USING (code) WHERE NOT flat GROUP BY code),
rp AS (SELECT query, {', '.join(f'z{i} AS q{i}' for i in range(8))} FROM rp0 JOIN zw ON zw.series = m.s AND zw.t = m.t),
dd AS (SELECT series, label, query, t, flat, sqrt(({' + '.join(f'(z{i} - q{i}) * (z{i} - q{i})' for i in range(8))}) / 8.0::DOUBLE) AS d FROM zw, rp),
md AS (SELECT series, label, query, min(d) FILTER (NOT flat) AS distance, arg_min(t, (round(d, 9), t)) FILTER (NOT flat) AS location, max(d) FILTER (NOT flat) - min(d) FILTER (NOT flat) AS spread FROM dd GROUP BY ALL)"""


def candidates(spark, d):
    w, z = vector_words(spark, d), G.z_windows(vectors(spark, d), 8)
    c = shapelet_candidates(spark, d)
    return w, z, G.representatives(w, z, c.select("code", "dominant"), 8)


@query(f"WITH {DIST} SELECT series, query, round(distance, 6) AS distance, location, round(spread, 6) AS spread FROM md")
def min_distance(spark, d):
    w, z, q = candidates(spark, d)
    return G.min_distances(z, q, 8).select("series", "query", r6("distance"), "location", r6("spread"))


def _split(src: str) -> str:
    """CTEs of best splits over the ten classes of rows (feature, value, label, n)."""
    ent = lambda c, t: " + ".join(f"CASE WHEN {x} > 0 AND {t} > 0 THEN -({x}::DOUBLE / {t}) * log2({x}::DOUBLE / {t}) ELSE 0 END" for x in c)
    lefts, tots, rights = [f"l{i}" for i in range(10)], [f"t{i}" for i in range(10)], [f"(t{i} - l{i})" for i in range(10)]
    return f"""v0 AS (SELECT feature, value, {', '.join(f'sum(CASE WHEN label = {i} THEN n ELSE 0 END)::BIGINT AS c{i}' for i in range(10))}, sum(n)::BIGINT AS n FROM {src} GROUP BY ALL),
v1 AS (SELECT feature, value, lead(value) OVER o AS next, {', '.join(f'sum(c{i}) OVER u AS l{i}, sum(c{i}) OVER a AS t{i}' for i in range(10))}, sum(n) OVER u AS nl, sum(n) OVER a AS nt, sum(n * value) OVER u AS sl, sum(n * value) OVER a AS st FROM v0 WINDOW o AS (PARTITION BY feature ORDER BY value), u AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
v2 AS (SELECT feature, value, next, CASE WHEN next IS NULL THEN -1.0 ELSE round(({ent(tots, 'nt')}) - (nl * ({ent(lefts, 'nl')}) + (nt - nl) * ({ent(rights, '(nt - nl)')})) / nt, 12) END AS ig, CASE WHEN next IS NOT NULL THEN (st - sl) / (nt - nl) - sl / nl END AS gap FROM v1),
bs AS (SELECT feature, CASE WHEN x.next IS NULL THEN 0.0 ELSE x.ig END AS ig, CASE WHEN x.next IS NULL THEN x.value ELSE (x.value + x.next) / 2 END AS threshold, CASE WHEN x.next IS NULL THEN 0.0 ELSE x.gap END AS gap FROM (SELECT feature, arg_min({{'value': value, 'next': next, 'ig': ig, 'gap': gap}}, (-ig, value)) AS x FROM v2 GROUP BY feature))"""


SHAPE = f"{DIST}, fx AS (SELECT query AS feature, round(distance, 9) AS value, label, 1 AS n FROM md), {_split('fx')}"


@query(f"WITH {SHAPE} SELECT feature, round(ig, 6) AS ig, round(threshold, 6) AS threshold, round(gap, 6) AS gap FROM bs")
def word_info_gain(spark, d):
    w, z, q = candidates(spark, d)
    dist = G.min_distances(z, q, 8)
    s = G.best_splits(dist.select(F.col("query").alias("feature"), F.round("distance", 9).alias("value"), "label", F.lit(1).alias("n")))
    return s.select("feature", r6("ig"), r6("threshold"), r6("gap"))


TOP = f"""{SHAPE}, tk AS (SELECT row_number() OVER (ORDER BY ig DESC, round(abs(gap), 9) DESC, round(score, 9) DESC, code) AS rank, code, ig, threshold, gap, dominant, support FROM bs JOIN cd ON feature = code)"""


@query(f"WITH {TOP} SELECT rank, code, round(ig, 6) AS ig, round(threshold, 6) AS threshold, round(gap, 6) AS gap, dominant, round(support, 6) AS support FROM tk WHERE rank <= 6")
def shapelet_top_k(spark, d):
    return dictionary_and_matches(spark, d)[0].select("rank", "code", r6("ig"), r6("threshold"), r6("gap"), "dominant", r6("support"))


MATCH = f"""{TOP}, di AS (SELECT code FROM tk WHERE rank <= 6), nw AS (SELECT series, count(*) AS n FROM sw GROUP BY series), hc AS (SELECT series, code, count(*) AS c FROM sw SEMI JOIN di USING (code) GROUP BY ALL),
mt AS (SELECT md.series, md.label, query AS code, CASE WHEN c > 0 THEN 1 ELSE 0 END AS presence, coalesce(c, 0) / n::DOUBLE AS frequency, distance, location, spread > 1e-4 AS informative FROM md JOIN di ON query = di.code JOIN nw USING (series) LEFT JOIN hc ON hc.series = md.series AND hc.code = query)"""


def dictionary_and_matches(spark, d):
    w, z = vector_words(spark, d), G.z_windows(vectors(spark, d), 8)
    top, q, dist = G.mined(w, z, 8, 4, FLAT4, MASKS, 15, 6)
    top = top.cache()
    return top, G.match(w, z, top, q, 8, distances=dist)


def matched(spark, d):
    return dictionary_and_matches(spark, d)[1]


@query(f"WITH {MATCH} SELECT series, code, presence, round(frequency, 6) AS frequency, round(distance, 6) AS distance, location, informative, round(CASE WHEN informative THEN location / 63.0 ELSE 0.0 END, 6) AS place FROM mt")
def match_features(spark, d):
    m = G.with_locations(matched(spark, d), 64)
    return m.select("series", "code", "presence", r6("frequency"), r6("distance"), "location", "informative", r6("place"))


@query(f"""WITH {MATCH}, st AS (SELECT code, avg(presence) AS pm, stddev_pop(presence) AS ps, avg(frequency) AS fm, stddev_pop(frequency) AS fs, avg(distance) AS dm, stddev_pop(distance) AS ds FROM mt GROUP BY code)
SELECT series, code, round((presence - pm) / CASE WHEN ps < 1e-6 THEN 1.0 ELSE ps END, 5) AS presence, round((frequency - fm) / CASE WHEN fs < 1e-6 THEN 1.0 ELSE fs END, 5) AS frequency, round((distance - dm) / CASE WHEN ds < 1e-6 THEN 1.0 ELSE ds END, 5) AS distance FROM mt JOIN st USING (code)""")
def standardised_features(spark, d):
    s = G.standardised(matched(spark, d).select("series", "code", "presence", "frequency", "distance"), ("presence", "frequency", "distance"))
    return s.select("series", "code", *[F.round(c, 5).alias(c) for c in ("presence", "frequency", "distance")])


@query(f"WITH {MATCH} SELECT code, label, count(*) AS n FROM mt WHERE presence = 1 GROUP BY ALL")
def word_tendencies(spark, d):
    lab = vectors(spark, d).select("series", "label").distinct()
    return G.word_tendencies(matched(spark, d).join(lab, "series"))


S3 = f"{SFA}, s3 AS (SELECT * FROM sfa)"
BOSS = f"""{S3}, rd AS (SELECT * FROM (SELECT *, lag(code) OVER (PARTITION BY series ORDER BY t) AS p FROM s3) WHERE p IS NULL OR p <> code),
bg AS (SELECT series, label, code, count(*) AS c FROM rd GROUP BY ALL), fq AS (SELECT series, label, code, c / sum(c) OVER (PARTITION BY series)::DOUBLE AS value FROM bg),
nl AS (SELECT label, count(DISTINCT series) AS n FROM s3 GROUP BY label), el AS (SELECT code, count(DISTINCT series) / (SELECT count(DISTINCT series) FROM s3)::DOUBLE AS support FROM s3 GROUP BY code HAVING bool_or(NOT flat) AND code <> {ZERO}),
e2 AS (SELECT * FROM el WHERE support >= 0.02), gr AS (SELECT e2.code, support, nl.label, nl.n, count(value) AS have, coalesce(sum(value), 0) / any_value(nl.n) AS mean FROM e2 CROSS JOIN nl LEFT JOIN fq ON fq.code = e2.code AND fq.label = nl.label GROUP BY e2.code, support, nl.label, nl.n),
fx AS (SELECT code AS feature, round(value, 12) AS value, label, 1 AS n FROM fq SEMI JOIN e2 USING (code) UNION ALL SELECT code, 0.0, label, n - have FROM gr WHERE n > have), {_split('fx')},
dm AS (SELECT code, support, arg_min(label, (-round(mean, 12), label)) AS dominant FROM gr GROUP BY ALL),
bk AS (SELECT row_number() OVER (ORDER BY ig DESC, round(abs(gap), 9) DESC, code) AS rank, code, ig, gap, dominant, support FROM bs JOIN dm ON feature = code)"""


@query(f"WITH {BOSS} SELECT rank, code, round(ig, 6) AS ig, round(gap, 6) AS gap, dominant, round(support, 6) AS support FROM bk WHERE rank <= 8")
def boss_top_k(spark, d):
    return G.boss_words(*embedding_sfa_and_zero(spark, d), 8).select("rank", "code", r6("ig"), r6("gap"), "dominant", r6("support"))


DIGITS = [f"(code // {4 ** (3 - i)}) % 4" for i in range(4)]


@query(f"""WITH {BOSS}, di AS (SELECT code, {', '.join(f'{x} AS r{i}' for i, x in enumerate(DIGITS))} FROM bk WHERE rank <= 8),
x AS (SELECT series, di.code, t, flat, CASE WHEN s3.code = di.code THEN 1 ELSE 0 END AS same, ({' + '.join(f'abs(s{i} - r{i})' for i in range(4))}) / 12.0::DOUBLE AS d FROM s3, di)
SELECT series, code, max(same) AS presence, round(avg(same), 6) AS frequency, round(min(d) FILTER (NOT flat), 6) AS distance, arg_min(t, (d, t)) FILTER (NOT flat) AS location, coalesce(max(d) FILTER (NOT flat) > min(d) FILTER (NOT flat), false) AS informative FROM x GROUP BY ALL""")
def boss_match(spark, d):
    w, zero = embedding_sfa_and_zero(spark, d)
    top = G.boss_words(w, zero, 8).select("code", *[(F.floor(F.col("code") / 4 ** (3 - i)) % 4).cast("int").alias(f"r{i}") for i in range(4)])
    return G.boss_match(w, top, 4).select("series", "code", "presence", r6("frequency"), r6("distance"), "location", "informative")


# ---------------------------------------------------------------- novelty on event series
EVW = f"{EV}, {sax('ev', 12, 4, B4, flat=1e-3)}"


def event_words(spark, d):
    return X.sax_words(X.event_series(spark, d), 12, 4, 4, flat_std=1e-3)


def normal(words):
    """Words of windows that end before point 30 are normal; codes of which the text says nothing are new."""
    return words.where("t <= 18")


VOC = f"{EVW}, fl AS (SELECT series, t, s0, s1, s2, s3, CASE WHEN flat THEN '<flat>' ELSE word END AS word, CASE WHEN flat THEN -1 ELSE code END AS code FROM sw), vo AS (SELECT code, word, s0, s1, s2, s3, count(*) AS cnt FROM fl WHERE t <= 18 GROUP BY ALL)"


@query(f"WITH {VOC} SELECT code, word, cnt FROM vo")
def novelty_vocab(spark, d):
    return N.vocabulary(normal(event_words(spark, d)), 4).select("code", "word", "cnt")


def _cell(a: str, b: str) -> str:
    gap = {(x, y): B4[max(x, y) - 1] - B4[min(x, y)] for x in range(4) for y in range(4) if abs(x - y) > 1}
    return f"CASE {' '.join(f'WHEN {a} = {x} AND {b} = {y} THEN {lit(g)}' for (x, y), g in gap.items())} ELSE 0.0 END"


NEAR = f"""{VOC}, ix AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, code) AS rank FROM vo WHERE code <> -1), un AS (SELECT DISTINCT code, s0, s1, s2, s3 FROM fl WHERE code <> -1 AND code NOT IN (SELECT code FROM vo)),
nd AS (SELECT un.code, ix.word, rank, round(sqrt(({' + '.join(f'({_cell(f"un.s{i}", f"ix.s{i}")}) ^ 2' for i in range(4))}) / 4.0), 9) AS d FROM un, ix WHERE rank <= 2048),
nn AS (SELECT code, arg_min(word, (d, rank)) AS nearest, min(d) AS distance FROM nd GROUP BY code)"""


@query(f"WITH {NEAR} SELECT code, nearest, round(distance, 6) AS distance FROM nn")
def nearest_normal_word(spark, d):
    w = event_words(spark, d)
    return N.nearest_words(w, N.vocabulary(normal(w), 4), 4).select("code", "nearest", r6("distance"))


NOVEL = f"""{NEAR}, dn AS (SELECT sum(cnt) + count(*) + 1 AS denom FROM vo),
nv AS (SELECT series, t, fl.word, coalesce(cnt, 0) AS cnt, nearest, coalesce(distance, 0.0) AS distance, -ln((coalesce(cnt, 0) + 1.0::DOUBLE) / denom) + 4.0 * coalesce(distance, 0.0) AS novelty FROM fl LEFT JOIN vo USING (code) LEFT JOIN nn USING (code), dn),
pn AS (SELECT ev.series, ev.t, label, coalesce(max(novelty) OVER (PARTITION BY ev.series ORDER BY ev.t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0.0) AS raw FROM ev LEFT JOIN nv ON nv.series = ev.series AND nv.t = ev.t)"""


def novelties(spark, d):
    w = event_words(spark, d)
    return N.window_novelty(w, N.vocabulary(normal(w), 4), 4)


def raw_points(spark, d):
    return N.point_novelty(X.event_series(spark, d).select("series", "t", "label"), novelties(spark, d), 12)


@query(f"WITH {NOVEL} SELECT series, t, word, cnt, nearest, round(distance, 6) AS distance, round(novelty, 6) AS novelty FROM nv")
def window_novelty(spark, d):
    return novelties(spark, d).select("series", "t", "word", "cnt", "nearest", r6("distance"), r6("novelty"))


@query(f"WITH {NOVEL} SELECT series, t, round(raw, 6) AS raw FROM pn")
def point_novelty(spark, d):
    return raw_points(spark, d).select("series", "t", r6("raw"))


@query(f"WITH {NOVEL} SELECT series, t, round(raw, 6) AS raw FROM pn")
def point_novelty_blocked(spark, d):
    return N.point_novelty(X.event_series(spark, d).select("series", "t", "label"), novelties(spark, d), 12, 16).select("series", "t", r6("raw"))


NORM = f"{NOVEL}, no AS (SELECT q[2] AS loc, greatest(q[3] - q[1], 0.5) AS scale FROM (SELECT quantile_cont(raw, [0.25, 0.5, 0.75]) AS q FROM pn WHERE t BETWEEN 30 AND 40))"


@query(f"WITH {NORM} SELECT round(loc, 6) AS loc, round(scale, 6) AS scale FROM no")
def novelty_normalizer(spark, d):
    return N.normaliser(raw_points(spark, d).where("t between 30 and 40")).select(r6("loc"), r6("scale"))


def z_points(spark, d):
    p = raw_points(spark, d)
    n = N.normaliser(p.where("t between 30 and 40"))
    return p.join(F.broadcast(n)).select("series", "t", "label", ((F.col("raw") - F.col("loc")) / F.col("scale")).alias("z"))


@query(f"WITH {NORM} SELECT series, t, round((raw - loc) / scale, 6) AS z FROM pn, no")
def novelty_standardised(spark, d):
    return z_points(spark, d).select("series", "t", r6("z"))


@query(f"""WITH {NORM}, z AS (SELECT series // 3 AS grp, series % 3 AS channel, t, (raw - loc) / scale AS z FROM pn, no),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, t ORDER BY z DESC, channel) AS r FROM z) SELECT grp AS series, t, round(avg(z), 6) AS score FROM r WHERE r <= 2 GROUP BY ALL""")
def novelty_reduced(spark, d):
    z = z_points(spark, d).select(F.floor(F.col("series") / 3).alias("grp"), (F.col("series") % 3).alias("channel"), "t", "z").withColumnRenamed("grp", "series")
    return N.reduced_channels(z, 3).select("series", "t", r6("score"))


TAIL = f"""{NORM}, rf AS (SELECT raw FROM pn WHERE t BETWEEN 30 AND 40), rs AS (SELECT count(*) AS n, max(raw) AS top, quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25) AS iqr, stddev_pop(raw) AS sd FROM rf),
qs AS (SELECT series, t, label, raw, -ln((1.0 + (SELECT count(*) FROM rf WHERE rf.raw >= pn.raw)) / (n + 1.0)) + ln(1 + greatest(0.0, raw - top) / CASE WHEN iqr > 1e-12 THEN iqr WHEN sd > 1e-12 THEN sd ELSE 1.0 END) AS q FROM pn, rs WHERE t > 40)"""


def tails(spark, d):
    p = raw_points(spark, d).withColumn("raw", F.round("raw", 9))
    return N.tail_surprisal(p.where("t > 40"), p.where("t between 30 and 40"), "raw", "raw", "q")


@query(f"WITH {TAIL.replace('coalesce(max(novelty)', 'round(coalesce(max(novelty)').replace('CURRENT ROW), 0.0) AS raw', 'CURRENT ROW), 0.0), 9) AS raw')} SELECT series, t, round(q, 6) AS q FROM qs")
def tail_surprisal(spark, d):
    return tails(spark, d).select("series", "t", r6("q"))


FUSE = f"""{NORM}, er AS (SELECT series, t, round((value - avg(value) OVER (PARTITION BY series, t // 3)) ^ 2, 6) AS e FROM ev),
es AS (SELECT quantile_cont(e, 0.5) AS m, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS s FROM er WHERE t BETWEEN 30 AND 40),
fz AS (SELECT pn.series, pn.t, label, (e - m) / s AS zf, (raw - loc) / scale AS zs FROM pn JOIN er ON er.series = pn.series AND er.t = pn.t, no, es WHERE pn.t > 40)"""


def fused(spark, d):
    from .series_queries import recon

    e = recon(spark, d).select("series", "t", F.col("score").alias("e"))
    s = N.robust(e.where("t between 30 and 40"), "e").select(F.col("loc").alias("m"), F.col("scale").alias("s"))
    return z_points(spark, d).where("t > 40").join(e, ["series", "t"]).join(F.broadcast(s)).select("series", "t", "label", ((F.col("e") - F.col("m")) / F.col("s")).alias("zf"), F.col("z").alias("zs"))


@query(f"WITH {FUSE} SELECT series, t, round(zf + 0.5 * zs, 5) AS score FROM fz")
def fusion_z(spark, d):
    return fused(spark, d).select("series", "t", F.round(F.col("zf") + 0.5 * F.col("zs"), 5).alias("score"))


LAMBDA_SQL = f"""WITH {FUSE}, g AS (SELECT lam, series, label, round(zf + lam * zs, 6) AS score FROM fz, (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS lam)),
c AS (SELECT lam, series, score, sum(label) AS p, sum(1 - label) AS q FROM g GROUP BY ALL), v AS (SELECT lam, series, score, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER a AS pos, sum(q) OVER a AS neg FROM c WINDOW w AS (PARTITION BY lam, series ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY lam, series)),
s AS (SELECT lam, series, sum(p::DOUBLE / pos * tp / (tp + fp)) AS ap FROM v WHERE pos > 0 AND neg > 0 GROUP BY ALL) SELECT lam::DOUBLE AS lam, round(avg(ap), 6) AS ap FROM s GROUP BY lam"""


@query(LAMBDA_SQL)
def lambda_sensitivity(spark, d):
    g = fused(spark, d).withColumn("lam", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]))).withColumn("score", F.round(F.col("zf") + F.col("lam") * F.col("zs"), 6))
    return M.average_precision(g, ("lam", "series")).groupBy("lam").agg(F.round(F.avg("ap"), 6).alias("ap"))


FUSECAL = f"""{FUSE}, rz AS (SELECT pn.series, pn.t, (e - m) / s AS zf, round((raw - loc) / scale, 9) AS zs FROM pn JOIN er ON er.series = pn.series AND er.t = pn.t, no, es WHERE pn.t BETWEEN 30 AND 40),
k AS (SELECT count(*) AS n, max(round(zf, 9)) AS tf, quantile_cont(round(zf, 9), 0.75) - quantile_cont(round(zf, 9), 0.25) AS jf, max(zs) AS ts, CASE WHEN quantile_cont(zs, 0.75) - quantile_cont(zs, 0.25) > 1e-12 THEN quantile_cont(zs, 0.75) - quantile_cont(zs, 0.25) ELSE stddev_pop(zs) END AS js FROM rz),
y AS (SELECT series, t, round(zf, 9) AS zf, round(zs, 9) AS zs FROM fz)
SELECT series, t, round(-ln((1.0 + (SELECT count(*) FROM rz WHERE round(rz.zf, 9) >= y.zf)) / (n + 1.0)) + ln(1 + greatest(0.0, zf - tf) / jf) - ln((1.0 + (SELECT count(*) FROM rz WHERE rz.zs >= y.zs)) / (n + 1.0)) + ln(1 + greatest(0.0, zs - ts) / js), 5) AS score FROM y, k"""


@query(f"WITH {FUSECAL}")
def fusion_calibrated(spark, d):
    from .series_queries import recon

    e = recon(spark, d).select("series", "t", F.col("score").alias("e"))
    s = N.robust(e.where("t between 30 and 40"), "e").select(F.col("loc").alias("m"), F.col("scale").alias("s"))
    z = z_points(spark, d).where("t >= 30").join(e, ["series", "t"]).join(F.broadcast(s)).select("series", "t", F.round((F.col("e") - F.col("m")) / F.col("s"), 9).alias("zf"), F.round("z", 9).alias("zs")).cache()
    ref, new = z.where("t <= 40"), z.where("t > 40")
    q = N.tail_surprisal(N.tail_surprisal(new, ref, "zf", "zf", "qf").cache(), ref, "zs", "zs", "qs")
    return q.select("series", "t", F.round(F.col("qf") + F.col("qs"), 5).alias("score"))


@query(f"""WITH {EV}, c AS (SELECT series, t, value - avg(value) OVER (PARTITION BY series) AS x FROM ev), n AS (SELECT series, count(*) AS n, sum(x * x) AS ss FROM c GROUP BY series)
SELECT a.series, b.t - a.t AS lag, round(sum(a.x * b.x) / min(ss), 6) AS acf FROM c a JOIN c b ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 20 JOIN n ON n.series = a.series WHERE b.t - a.t < n // 2 GROUP BY a.series, b.t - a.t""")
def autocorrelation(spark, d):
    a = N.autocorrelation(X.event_series(spark, d), 20)
    return a.select("series", F.col("lag").cast("long").alias("lag"), r6("acf"))


@query(f"""WITH {DAILY}, {EV}, pt AS (SELECT 'orders' AS source, channel AS series, t, value FROM daily UNION ALL SELECT 'events', series::VARCHAR, t, value FROM ev),
c AS (SELECT source, series, t, value - avg(value) OVER (PARTITION BY source, series) AS x FROM pt), n AS (SELECT source, series, count(*) AS n, sum(x * x) AS ss FROM c GROUP BY ALL),
a AS (SELECT a.source, a.series, b.t - a.t AS lag, sum(a.x * b.x) / min(ss) AS acf FROM c a JOIN c b ON a.source = b.source AND a.series = b.series AND b.t - a.t BETWEEN 1 AND 40 JOIN n ON n.source = a.source AND n.series = a.series WHERE ss > 1e-12 AND b.t - a.t < n // 2 GROUP BY ALL),
p AS (SELECT *, lag(acf) OVER w AS prev, lead(acf) OVER w AS nxt, max(CASE WHEN acf < 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS neg FROM a WINDOW w AS (PARTITION BY source, series ORDER BY lag)),
k AS (SELECT source, series, min((lag, acf)) AS p FROM p WHERE neg = 1 AND acf > 0 AND acf >= prev AND acf >= nxt GROUP BY ALL)
SELECT source, series, p[1]::BIGINT AS period FROM k WHERE p[2] >= 0.3""")
def estimate_period(spark, d):
    """Periods up to 40 days of the daily order totals by channel, and up to 40 points of the event series."""
    daily = X.daily_series(spark, d).withColumnRenamed("channel", "series")
    points = X.event_series(spark, d).select(F.col("series").cast("string").alias("series"), "t", "value")
    each = [N.periods(N.autocorrelation(p, 40)).withColumn("source", F.lit(s)) for s, p in (("orders", daily), ("events", points))]
    return each[0].unionByName(each[1]).select("source", "series", F.col("period").cast("long").alias("period"))


TOPE = f"""{NOVEL}, sc AS (SELECT series, t, round(raw, 6) AS score FROM pn), p1 AS (SELECT series, arg_min(t, (-score, t)) AS a, max(score) AS s FROM sc GROUP BY series),
p2 AS (SELECT sc.series, arg_min(t, (-score, t)) AS a, max(score) AS s FROM sc JOIN p1 USING (series) WHERE abs(t - p1.a) >= 10 GROUP BY sc.series),
p3 AS (SELECT sc.series, arg_min(t, (-score, t)) AS a, max(score) AS s FROM sc JOIN p1 USING (series) JOIN p2 USING (series) WHERE abs(t - p1.a) >= 10 AND abs(t - p2.a) >= 10 GROUP BY sc.series),
te AS (SELECT series, 1 AS rank, a AS t, s AS score FROM p1 UNION ALL SELECT series, 2, a, s FROM p2 UNION ALL SELECT series, 3, a, s FROM p3)"""


def events(spark, d):
    return N.top_events(raw_points(spark, d).select("series", "t", r6("raw").alias("score")), 3, 10)


@query(f"WITH {TOPE} SELECT series, rank, t, score FROM te")
def top_events(spark, d):
    return events(spark, d)


@query(f"""WITH {TOPE}, x AS (SELECT te.series, te.t AS point, nv.t AS start, nv.word, cnt, nearest, distance, novelty FROM te JOIN nv ON nv.series = te.series AND nv.t BETWEEN te.t - 11 AND te.t WHERE rank = 1)
SELECT series, point, b['start'] AS start, b['start'] + 12 AS "end", b.word AS word, b.cnt AS train_count, b.nearest AS nearest, round(b.distance, 6) AS distance, round(b.novelty, 6) AS novelty FROM (SELECT series, point, arg_min({{'start': start, 'word': word, 'cnt': cnt, 'nearest': nearest, 'distance': distance, 'novelty': novelty}}, (-novelty, start)) AS b FROM x GROUP BY ALL)""")
def explain_point(spark, d):
    e = N.explain_points(events(spark, d).where("rank = 1").select("series", "t"), novelties(spark, d), 12)
    return e.select("series", F.col("at").alias("point"), "start", "end", "word", "train_count", "nearest", r6("distance"), r6("novelty"))
