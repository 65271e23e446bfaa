"""Readers of time-series file formats as DataFrames, class ids, borders and scaling, and sinks.

Every reader is a Spark scan of a path or glob, so files in any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed borders in months of the hourly and quarter-hourly transformer tables: train, validation, test.
ETT_MONTHS = (12, 4, 4)


def parse_ts(lines: DataFrame) -> DataFrame:
    """(series, channel, t, value, label) from (line_no, value): the text after @data, dimensions by ':', the last part the class, '?' a missing value (null).

    Blank and # lines are skipped; series are numbered from 0 in line order.
    """
    start = lines.where(F.lower(F.trim("value")) == "@data").agg(F.min("line_no").alias("_at"))
    body = lines.join(F.broadcast(start)).where(F.col("line_no") > F.col("_at")).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    d = body.select((F.row_number().over(W.orderBy("line_no")) - 1).cast("long").alias("series"), F.split(F.trim("value"), ":").alias("parts"))
    d = d.select("series", F.trim(F.element_at("parts", -1)).alias("label"), F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("channel", "x"))
    return d.select("series", "channel", "label", F.posexplode(F.split("x", ",")).alias("t", "v")).select("series", "channel", F.col("t").cast("long").alias("t"), F.expr("try_cast(trim(v) as double)").alias("value"), "label")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value); line numbers rise in a file and need not be consecutive."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    return interpolate(parse_ts(read_lines(spark, path)), ("series", "channel"))


def interpolate(points: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """``points`` with null and NaN values filled linearly between their known neighbours, the nearest at the edges, 0 where all are missing."""
    v = F.when(~F.isnan("value"), F.col("value"))
    w = W.partitionBy(*keys).orderBy("t")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col("t"))
    d = points.withColumn("_v", v).withColumn("_a", F.last(v, True).over(back)).withColumn("_s", F.last(at, True).over(back)).withColumn("_b", F.first(v, True).over(ahead)).withColumn("_e", F.first(at, True).over(ahead))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("t") - F.col("_s")) / (F.col("_e") - F.col("_s"))
    filled = F.coalesce("_v", F.when(F.col("_e") != F.col("_s"), line), "_a", "_b", F.lit(0.0))
    return d.withColumn("value", filled).select(*points.columns)


def class_ids(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with class_id: the rank from 0 of the sorted distinct labels. Labels are few, so the table of ids is broadcast after an aggregation."""
    names = rows.select(label).distinct()
    ids = names.select(label, (F.dense_rank().over(W.orderBy(label)) - 1).alias("class_id"))
    return rows.join(F.broadcast(ids), label)


def read_forecast_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """(channel, t, value) of a CSV of a date column and one column a channel, in date order."""
    wide = spark.read.csv(path, header=True)
    cols = [c for c in wide.columns if c != date]
    t = (F.row_number().over(W.orderBy(date)) - 1).cast("long").alias("t")
    return wide.select(t, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["t"], cols, "channel", "value").select("channel", "t", "value")


def borders(n: int, seq_len: int, kind: str = "share") -> dict[str, tuple[int, int]]:
    """Rows of train, val and test; val and test start ``seq_len`` rows early for context. kind: 'hour' or 'quarter' for month borders, else 70/10/20 %."""
    if kind in ("hour", "quarter"):
        month = 30 * 24 * (1 if kind == "hour" else 4)
        a, b, c = (sum(ETT_MONTHS[: i + 1]) * month for i in range(3))
    else:
        test = int(n * 0.2)
        a, b, c = int(n * 0.7), n - test, n
    return {"train": (0, a), "val": (a - seq_len, b), "test": (b - seq_len, c)}


def standardise_by_train(points: DataFrame, end: int, keys: tuple[str, ...] = ("channel",), rule: str = "plus") -> DataFrame:
    """``points`` scaled by mean and sd of t < end for each key. rule 'plus': sd + 1e-8; 'constant': an sd below 1e-4 only centres."""
    s = points.where(F.col("t") < end).groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    sd = F.col("_s") + 1e-8 if rule == "plus" else F.when(F.col("_s") < 1e-4, 1.0).otherwise(F.col("_s"))
    return points.join(s, list(keys)).withColumn("value", (F.col("value") - F.col("_m")) / sd).select(*points.columns)


def ucr_names(files: DataFrame, name: str = "file") -> DataFrame:
    """``files`` with entity, train_end, start and end (end not included, from 0) read from <id>_UCR_Anomaly_<name>_<trainEnd>_<start>_<end>.txt, whose bounds count from 1 and include the end."""
    p = r"([^/]*?)_UCR_Anomaly_(.*)_(\d+)_(\d+)_(\d+)\.txt$"
    g = lambda i: F.regexp_extract(name, p, i)
    return files.select("*", F.concat_ws("_", g(1), g(2)).alias("entity"), g(3).cast("long").alias("train_end"), (g(4).cast("long") - 1).alias("start"), g(5).cast("long").alias("end"))


def read_ucr(spark: SparkSession, path: str) -> DataFrame:
    """(entity, t, value, label, split) of a glob of one-value-a-line files."""
    rows = ucr_names(read_lines(spark, path).where(F.trim("value") != ""))
    t = (F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1).cast("long")
    d = rows.withColumn("t", t)
    return d.select("entity", "t", F.trim("value").cast("double").alias("value"), ((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).cast("int").alias("label"), F.when(F.col("t") < F.col("train_end"), "train").otherwise("test").alias("split"))


def read_value_label(spark: SparkSession, path: str) -> DataFrame:
    """(entity, t, value, label) of a glob of 'value,label' files, one entity a file."""
    rows = read_lines(spark, path).where(F.trim("value") != "")
    t = (F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1).cast("long").alias("t")
    x = F.split("value", ",")
    return rows.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("entity"), t, x[0].cast("double").alias("value"), x[1].cast("double").cast("int").alias("label"))


def explode_csv_lines(rows: DataFrame) -> DataFrame:
    """(entity, channel, t, value) from (entity, t, line) of comma-separated numbers."""
    return rows.select("entity", "t", F.posexplode(F.split("line", ",")).alias("channel", "v")).select("entity", "channel", "t", F.trim("v").cast("double").alias("value"))


def drop_constant_channels(points: DataFrame, keys: tuple[str, ...] = ("entity", "channel"), least: float = 1e-8) -> DataFrame:
    """Without the channels whose largest and smallest value differ by less than ``least``."""
    ok = points.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("_r")).where(F.col("_r") >= least).select(*keys)
    return points.join(ok, list(keys), "left_semi")


def read_smd(spark: SparkSession, path: str, univariate: bool = False) -> DataFrame:
    """(entity, channel, t, value) of machine files; the univariate form drops constant channels and makes each machine@channel an entity."""
    rows = read_lines(spark, path)
    t = (F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1).cast("long").alias("t")
    d = explode_csv_lines(rows.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("entity"), t, F.col("value").alias("line")))
    return drop_constant_channels(d).select(F.concat_ws("@", "entity", F.col("channel").cast("string")).alias("entity"), F.lit(0).alias("channel"), "t", "value") if univariate else d


def read_psm(spark: SparkSession, path: str, time: str = "timestamp_(min)") -> DataFrame:
    """(channel, t, value) of a CSV without its time column; missing is 0."""
    wide = spark.read.csv(path, header=True)
    cols = [c for c in wide.columns if c != time]
    t = (F.row_number().over(W.orderBy(F.col(f"`{time}`").cast("double"))) - 1).cast("long").alias("t")
    d = wide.select(t, *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols])
    return d.unpivot(["t"], cols, "channel", "value").select("channel", "t", "value")


def interval_labels(points: DataFrame, intervals: DataFrame, entity: str = "entity") -> DataFrame:
    """``points`` with label 1 inside any inclusive [s, e] of (entity, spans), spans the text of a list of pairs.

    Intervals are spread to the points they cover, so the range join is an equality join.
    """
    pairs = intervals.select(entity, F.explode(F.from_json("spans", "array<array<long>>")).alias("p"))
    hits = pairs.select(entity, F.explode(F.sequence(F.col("p")[0], F.col("p")[1])).alias("t")).distinct().withColumn("label", F.lit(1))
    return points.drop("label").join(hits, [entity, "t"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def long_enough(points: DataFrame, least: int, entity: str = "entity") -> DataFrame:
    """Without entities of fewer than ``least`` points."""
    n = points.groupBy(entity).agg(F.count_distinct("t").alias("_n")).where(F.col("_n") >= least).select(entity)
    return points.join(n, entity, "left_semi")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, keys: tuple[str, ...]) -> DataFrame:
    """The last line of each key of JSON-lines files under a folder tree, by file then line."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"), F.from_json("value", schema).alias("r"))
    d = raw.select("_f", "_i", "r.*")
    w = W.partitionBy(*keys).orderBy(F.desc("_f"), F.desc("_i"))
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_f", "_i")


def synthetic_waves(spark: SparkSession, n: int, length: int, seed: int = 0, bump: int = 16) -> DataFrame:
    """(series, t, value, label): noise for class 0, noise with a raised-cosine bump for class 1; the place comes from the id."""
    d = spark.range(n).select(F.col("id").alias("series"), (F.col("id") % 2).cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    at = (F.col("series") * 7919 + seed) % (length - bump)
    inside = (F.col("label") == 1) & (F.col("t") >= at) & (F.col("t") < at + bump)
    noise = (F.pmod(F.xxhash64("series", "t", F.lit(seed)), F.lit(20001)) - 10000) / 33333.0
    return d.select("series", F.col("t").cast("long").alias("t"), (noise + F.when(inside, 2.0 * (1 - F.cos(2 * 3.141592653589793 * (F.col("t") - at) / bump))).otherwise(0.0)).alias("value"), "label")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Fitted tables (dictionary, edges, vocabulary, rules) as Parquet, one folder each."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
