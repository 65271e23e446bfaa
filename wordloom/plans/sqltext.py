"""Pieces of DuckDB SQL that several oracle queries share: the series views."""

EV = "ev AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"
EMB = "emb AS (SELECT vec_id AS series, label, i - 1 AS t, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
DAILY = """o AS (SELECT o_orderdate::DATE AS day, o_orderpriority AS channel, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL),
spine AS (SELECT channel, d::DATE AS day, date_diff('day', a, d::DATE) AS t FROM (SELECT DISTINCT channel FROM o), (SELECT min(day) AS a, max(day) AS b FROM o), LATERAL (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
daily AS (SELECT channel, t, coalesce(v, 0.0) AS value FROM spine LEFT JOIN o USING (channel, day))"""
#: Points with the squared error of each against the mean of its block of three.
FM = "fm AS (SELECT series, t, label, round((value - avg(value) OVER (PARTITION BY series, t // 3)) ^ 2, 6) AS score FROM ev)"


def lit(x: float) -> str:
    return f"{x!r}::DOUBLE"


def sym(v: str, edges) -> str:
    return "(" + " + ".join(f"CASE WHEN {v} >= {lit(e)} THEN 1 ELSE 0 END" for e in edges) + ")"


def sax(src: str, window: int, n: int, edges, name: str = "sw", step: int = 1, flat: float = 1e-8, extra: str = "") -> str:
    """A CTE of SAX words of a series CTE, whole segments only."""
    k = window // n
    seg = ", ".join(f"avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {j * k} FOLLOWING AND {(j + 1) * k - 1} FOLLOWING) AS m{j}" for j in range(n))
    s = ", ".join(f"{sym(f'CASE WHEN sd < {lit(flat)} THEN 0.0 ELSE (m{j} - mean) / sd END', edges)} AS s{j}" for j in range(n))
    a = len(edges) + 1
    word = " || ".join(f"chr((97 + s{j})::INTEGER)" for j in range(n))
    code = " + ".join(f"s{j}::BIGINT * {a ** (n - 1 - j)}" for j in range(n))
    return f"""{name}_w AS (SELECT series, t{extra}, count(*) OVER f AS n, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS sd, {seg} FROM {src} WINDOW f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
{name}_s AS (SELECT series, t{extra}, sd < {lit(flat)} AS flat, {s} FROM {name}_w WHERE n = {window} AND t % {step} = 0),
{name} AS (SELECT *, {word} AS word, ({code})::BIGINT AS code FROM {name}_s)"""
