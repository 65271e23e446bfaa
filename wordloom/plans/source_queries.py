"""Queries of readers and of the stream, on text and rows made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import novelty as N
from ..operators import windows as X
from ..operators.ordering import shared_folder
from ..sources import formats as S
from .mining_queries import event_words, normal
from .series_queries import r6
from .sqltext import DAILY, EV

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH x AS (SELECT vec_id, label, i, CASE WHEN (vec_id + i) % 5 = 0 THEN NULL ELSE round(embedding[i + 1]::DOUBLE * 100)::INTEGER END AS v FROM (SELECT vec_id, label, embedding, unnest(range(8)) AS i FROM embeddings))
SELECT vec_id AS series, i // 4 AS channel, (i % 4)::BIGINT AS t, v::DOUBLE AS value, 'c' || label AS label FROM x""")
def ts_parse(spark, d):
    """Embeddings written as .ts text of two dimensions of four values, some of them '?'."""
    e = X.read(spark, d, "embeddings")
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 5 == 0, "?").otherwise(F.round(F.get("embedding", i).cast("double") * 100).cast("int").cast("string")))
    text = F.concat(F.array_join(F.slice(v, 1, 4), ","), F.lit(":"), F.array_join(F.slice(v, 5, 4), ","), F.lit(":c"), F.col("label").cast("string"))
    body = e.select((F.col("vec_id") + 10).alias("line_no"), text.alias("value"))
    head = spark.createDataFrame([(0, "# made from vectors"), (1, "@classLabel true"), (2, ""), (3, "@data"), (4, "# none")], "line_no long, value string")
    return S.parse_ts(head.unionByName(body))


@query(f"""WITH {EV}, g AS (SELECT series, t, CASE WHEN (series + t) % 4 = 0 THEN NULL ELSE value END AS v FROM ev),
w AS (SELECT series, t, v, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS s, first_value(v IGNORE NULLS) OVER f AS c, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS e FROM g
WINDOW b AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, t, round(coalesce(v, CASE WHEN e <> s THEN a + (c - a) * (t - s) / (e - s) END, a, c, 0.0), 6) AS value FROM w""")
def gap_interpolation(spark, d):
    g = X.event_series(spark, d).select("series", "t", F.when((F.col("series") + F.col("t")) % 4 != 0, F.col("value")).alias("value"))
    return S.interpolate(g).select("series", "t", r6("value"))


@query("SELECT n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS class_id FROM nation")
def class_ids(spark, d):
    return S.class_ids(X.read(spark, d, "nation").select("n_name"), "n_name")


@query(f"WITH {DAILY}, s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM daily WHERE t < 700 GROUP BY channel) SELECT channel, t, round((value - m) / (s + 1e-8), 6) AS value FROM daily JOIN s USING (channel)")
def train_standardised(spark, d):
    return S.standardise_by_train(X.daily_series(spark, d), 700).select("channel", "t", r6("value"))


@query("SELECT c_custkey AS id, lpad((c_custkey % 250)::VARCHAR, 3, '0') || '_set' || c_nationkey AS entity, 1000 + c_custkey AS train_end, 1999 + c_custkey AS start, 2100 + c_custkey AS \"end\" FROM customer")
def ucr_names(spark, d):
    f = X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/data/"), F.lpad((F.col("c_custkey") % 250).cast("string"), 3, "0"), F.lit("_UCR_Anomaly_set"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey") + 1000, F.lit("_"), F.col("c_custkey") + 2000, F.lit("_"), F.col("c_custkey") + 2100, F.lit(".txt")).alias("file"))
    return S.ucr_names(f).select("id", "entity", "train_end", "start", "end")


@query(f"WITH {EV} SELECT series AS entity, t, CASE WHEN t BETWEEN series % 7 + 3 AND series % 7 + 9 OR t BETWEEN 40 AND 42 THEN 1 ELSE 0 END AS label FROM ev")
def interval_labels(spark, d):
    p = X.event_series(spark, d).select(F.col("series").alias("entity"), "t")
    a = F.col("entity") % 7
    spans = p.select("entity").distinct().select("entity", F.concat(F.lit("[["), a + 3, F.lit(", "), a + 9, F.lit("], [40, 42]]")).alias("spans"))
    return S.interval_labels(p, spans)


@query("""WITH l AS (SELECT user_id AS entity, event_id AS t, [value::INTEGER, 7, (event_id % 3)::INTEGER] AS x FROM events), p AS (SELECT entity, t, i - 1 AS channel, x[i]::DOUBLE AS value FROM (SELECT *, unnest([1, 2, 3]) AS i FROM l)),
k AS (SELECT entity, channel FROM p GROUP BY ALL HAVING max(value) - min(value) >= 1e-8) SELECT entity, channel, t, value FROM p SEMI JOIN k USING (entity, channel)""")
def machine_channels(spark, d):
    e = X.read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.concat_ws(",", F.bround("value").cast("int").cast("string"), F.lit("7"), (F.col("event_id") % 3).cast("string")).alias("line"))
    return S.drop_constant_channels(S.explode_csv_lines(e))


@query("""WITH r AS (SELECT o_custkey % 50 AS cell, o_orderkey % 3 AS seed, o_orderkey, o_totalprice FROM orders)
SELECT cell, seed, o_orderkey AS line, round(o_totalprice, 2) AS score FROM r QUALIFY row_number() OVER (PARTITION BY cell, seed ORDER BY o_orderkey DESC) = 1""")
def results_last_write(spark, d):
    o = X.read(spark, d, "orders")
    j = o.select("o_orderkey", F.to_json(F.struct((F.col("o_custkey") % 50).alias("cell"), (F.col("o_orderkey") % 3).alias("seed"), F.col("o_orderkey").alias("line"), F.round("o_totalprice", 2).alias("score"))).alias("value"))
    r = j.select("o_orderkey", F.from_json("value", "cell long, seed long, line long, score double").alias("r")).select("o_orderkey", "r.*")
    w = W.partitionBy("cell", "seed").orderBy(F.desc("o_orderkey"))
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").select("cell", "seed", "line", "score")


@query()
def streaming_novelty(spark, d):
    """Event series replayed through the streaming scorer into a shared folder, then read back."""
    import uuid

    from ..streaming.scorer import OUT, score_stream

    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    X.event_series(spark, d).select("series", "t", "value").write.parquet(f"{base}/in")
    vocab = N.vocabulary(normal(event_words(spark, d)), 4).groupBy("word").agg(F.sum("cnt").alias("cnt"))
    words = [(r.word, r.cnt) for r in vocab.collect()]
    stream = spark.readStream.schema("series long, t long, value double").parquet(f"{base}/in")
    q = score_stream(stream, words).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")
