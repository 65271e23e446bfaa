"""Evaluation metrics as aggregations and windows. Scores are (entity, t, score, label) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def curve(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(by, score, tp, fp, pos, neg): counts at or above each distinct score. Rows are aggregated by score first, so the running sums see distinct scores only."""
    d = scores.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("q"))
    down = W.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*by)
    return d.select(*by, "score", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(all_).alias("pos"), F.sum("q").over(all_).alias("neg"))


def two_classes(curves: DataFrame) -> DataFrame:
    return curves.where("pos > 0 and neg > 0")


def f1(tp: Column, fp: Column, pos: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 where nothing is hit."""
    return F.when(tp > 0, 2.0 * tp / (tp + fp + pos)).otherwise(F.lit(0.0))


def average_precision(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(by, ap): the sum of precision times the gain of recall over distinct descending scores."""
    c = two_classes(curve(scores, by))
    c = c.withColumn("gain", F.col("tp") - F.coalesce(F.lag("tp").over(W.partitionBy(*by).orderBy(F.desc("score"))), F.lit(0)))
    return c.groupBy(*by).agg(F.sum(F.col("gain") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def best_f1_exact(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(by, best_f1, threshold): over all scores, score >= threshold; of equal F1 the lowest threshold."""
    c = two_classes(curve(scores, by)).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("pos")))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("f1")).alias("f"), F.col("score").alias("s"))).alias("b"))
    return best.select(*by, (-F.col("b.f")).alias("best_f1"), F.col("b.s").alias("threshold"))


def at_thresholds(curves: DataFrame, thresholds: DataFrame, by: tuple[str, ...], strict: bool) -> DataFrame:
    """Counts of score > threshold (or >=) for a few thresholds an entity, by one merge of both orders.

    Curve rows and thresholds are sorted together and the last curve row above each threshold is carried
    down, so no threshold meets every score.
    """
    c = curves.select(*by, F.col("score").alias("at"), F.lit(0).alias("kind"), "tp", "fp", "pos", "neg", F.lit(None).cast("int").alias("k"))
    t = thresholds.select(*by, F.col("threshold").alias("at"), F.lit(1 if not strict else -1).alias("kind"), *[F.lit(None).cast("long").alias(x) for x in ("tp", "fp", "pos", "neg")], "k")
    w = W.partitionBy(*by).orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*by)
    d = c.unionByName(t).select(*by, "at", "k", *[F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(0)).alias(x) for x in ("tp", "fp")], F.max("pos").over(all_).alias("pos"), F.max("neg").over(all_).alias("neg"))
    return d.where("k is not null").withColumnRenamed("at", "threshold")


def quantile_grid(scores: DataFrame, by: tuple[str, ...], n: int, low: float, end: bool) -> DataFrame:
    """(by, k, threshold): n quantiles from ``low`` to 1, with or without 1 itself."""
    at = [low + (1 - low) * k / ((n - 1) if end else n) for k in range(n)]
    g = scores.groupBy(*by).agg(F.percentile("score", F.array(*[F.lit(x) for x in at])).alias("q"))
    return g.select(*by, F.posexplode("q").alias("k", "threshold"))


def best_f1_grid(scores: DataFrame, by: tuple[str, ...] = ("series",), n: int = 200, low: float = 0.5) -> DataFrame:
    """(by, best_f1): score > threshold over n quantiles in [low, 1)."""
    c = two_classes(curve(scores, by))
    d = at_thresholds(c, quantile_grid(scores, by, n, low, False), by, True).where("pos is not null")
    return d.groupBy(*by).agg(F.max(f1(F.col("tp"), F.col("fp"), F.col("pos"))).alias("best_f1"))


def segments(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """``scores`` with island: a number for each run of label 1, null outside."""
    w = W.partitionBy(*by).orderBy("t")
    rise = F.when((F.col("label") == 1) & (F.coalesce(F.lag("label").over(w), F.lit(0)) == 0), 1).otherwise(0)
    d = scores.withColumn("_rise", rise).withColumn("_k", F.sum("_rise").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("island", F.when(F.col("label") == 1, F.col("_k"))).drop("_rise", "_k")


def point_adjust(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """``scores`` with adjusted: a prediction anywhere in a true segment marks all of it."""
    w = W.partitionBy(*by, "island")
    return segments(scores, by).withColumn("adjusted", F.when(F.col("label") == 1, F.max("pred").over(w)).otherwise(F.col("pred")))


def label_spans(scores: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(by, start, end): runs of label 1, the end not included."""
    return segments(scores, by).where("label = 1").groupBy(*by, "island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("island")


def adjusted_best_f1(scores: DataFrame, by: tuple[str, ...] = ("series",), n: int = 512) -> DataFrame:
    """(by, best_f1) of point-adjusted predictions score >= threshold over n quantiles in [0, 1].

    A segment is hit if its largest score is, so each of its points takes that score; then cumulative sums do.
    """
    w = W.partitionBy(*by, "island")
    raised = segments(scores, by).withColumn("score_", F.when(F.col("label") == 1, F.max("score").over(w)).otherwise(F.col("score")))
    c = two_classes(curve(raised.select(*by, F.col("score_").alias("score"), "label"), by))
    d = at_thresholds(c, quantile_grid(scores, by, n, 0.0, True), by, False).where("pos is not null")
    return d.groupBy(*by).agg(F.max(f1(F.col("tp"), F.col("fp"), F.col("pos"))).alias("best_f1"))


def anomaly_metrics(scores: DataFrame, by: str = "series") -> DataFrame:
    """One row: best F1 on the exact curve and average precision, each averaged over entities with two classes, and their number."""
    per = best_f1_exact(scores, (by,)).join(average_precision(scores, (by,)), by)
    return per.agg(F.avg("best_f1").alias("best_f1"), F.avg("ap").alias("ap"), F.count("*").alias("n_entities"))


def false_alarm_rate(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, precision, recall, f1, fpr) of pred against label, 0 where undefined."""
    both = lambda p, y: F.sum(F.when((F.col("pred") == p) & (F.col("label") == y), 1).otherwise(0))
    d = scores.groupBy(*by).agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"), both(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return d.select(*by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """One row from (y, pred): accuracy and macro precision, recall and F1 over classes that are true or predicted somewhere."""
    cells = pred.groupBy("y", "pred").agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(f"n_{c}"))
    per = side("y").join(side("pred"), "c", "full").join(cells.where("y = pred").select(F.col("y").alias("c"), F.col("n").alias("hit")), "c", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("hit", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "n_y"), F.lit(0.0))
    return per.agg((F.sum("hit") / F.sum("n_y")).alias("accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(2.0 * F.col("hit") / (F.col("n_y") + F.col("n_pred"))).alias("macro_f1"))


def forecasting_metrics(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mse, mae) over all cells of (y, pred)."""
    e = F.col("pred") - F.col("y")
    return cells.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def risk_coverage(rows: DataFrame, by: tuple[str, ...] = (), coverages: int = 20) -> tuple[DataFrame, DataFrame]:
    """(curve: by, coverage, risk; summary: by, aurc, oracle_aurc, excess, gain) from (id, score, loss): trusted first means lowest score first, ties by id.

    ``by`` keeps independent problems apart; the running mean of one problem is one ordered pass.
    """
    def running(order: list[Column]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(*order) if by else W.partitionBy(F.lit(1)).orderBy(*order)
        n = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
        return rows.select(*by, F.row_number().over(w).alias("k"), F.avg("loss").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("risk"), F.count("*").over(n).alias("n"), F.avg("loss").over(n).alias("base"))

    own = running([F.col("score"), F.col("id")])
    points = own.select(*by, "k", "risk", "n", F.explode(F.sequence(F.lit(1), F.lit(coverages))).alias("c")).where(F.col("k") == F.ceil(F.col("c") * F.col("n") / F.lit(coverages)))
    a = own.groupBy(*by).agg(F.avg("risk").alias("aurc"), F.first("base").alias("base"))
    b = running([F.col("loss"), F.col("id")]).groupBy(*by).agg(F.avg("risk").alias("oracle_aurc"))
    s = a.join(b, list(by)) if by else a.join(b)
    summary = s.select(*by, "aurc", "oracle_aurc", (F.col("aurc") - F.col("oracle_aurc")).alias("excess"), (F.col("base") - F.col("aurc")).alias("gain"))
    return points.select(*by, (F.col("c") / F.lit(float(coverages))).alias("coverage"), "risk"), summary


def top1_hit(scores: DataFrame, tolerance: int, by: str = "series") -> DataFrame:
    """One row hit_rate: share of entities whose first highest point has a labelled point within ``tolerance``."""
    top = scores.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("t").alias("peak"))).alias("b")).select(by, "b.peak")
    near = scores.where("label = 1").select(by, "t").join(top, by).groupBy(by).agg(F.min(F.abs(F.col("t") - F.col("peak"))).alias("gap"))
    hit = top.join(near, by, "left").select(F.when(F.col("gap") <= tolerance, 1.0).otherwise(0.0).alias("hit"))
    return hit.agg(F.avg("hit").alias("hit_rate"))


def window_scores(cells: DataFrame, keys: tuple[str, ...] = ("series", "start", "i")) -> DataFrame:
    """(keys, score): squared reconstruction error averaged over channels, 0 where the mask is 0."""
    e = F.col("y") - F.col("pred")
    return cells.groupBy(*keys).agg(F.avg(F.when(F.coalesce(F.col("mask"), F.lit(1)) == 1, e * e).otherwise(F.lit(0.0))).alias("score"))
