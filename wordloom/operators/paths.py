"""Sparse linear heads by the hundred: one aggregation a step fits all strengths, folds, heads and permuted targets.

A model is one (head, target, fold left out, strength). Every pass over the rows takes the coefficients of all
models, multiplies a batch of rows by all of them at once and adds up, for each model, gradient and curvature;
each model's proximal Newton step is then taken where its sums meet. Least squares are done after one pass,
logistic models after about eight, whatever the number of models. A model's sums are those of its own head's
features, half of the symmetric curvature, so a narrow head costs little beside a wide one. What travels is
models x features^2 / 2 numbers from each of at most ``TASKS`` tasks, bounded by the parameters and not by the rows.

L1 with an intercept that is not penalised: the mean weighted loss plus strength x the sum of absolute
coefficients. Log-odds heads weigh both classes alike (balanced over the rows they are fitted on).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import hash_order
from .metrics import risk_coverage
from .ordering import fixed, places
from .reliability import combined

KINDS = ("classification", "regression")
#: Strengths C of the log-odds path, from strong to weak; number of the Lasso path and its ratio of last to first.
STRENGTHS = tuple(float(c) for c in np.logspace(-2.5, 1.0, 10))
LASSO_PATH, LASSO_RATIO = 30, 1e-3
TOLERANCE, STEPS = 1e-5, 40
#: Rows that a task of a pass takes at least, and the most tasks of a pass: each sends the sums of all models.
TASK_ROWS, TASKS = 2048, 96


@dataclass(frozen=True)
class Model:
    head: str
    target: int
    fold: int  # left out; -1: none
    penalty: float
    step: int  # place of its strength in the path


@dataclass
class Head:
    """A fitted head: coefficients of standardised features, or a constant where there were too few rows of a class to learn from."""

    name: str
    strength: float
    coef: list[float]
    intercept: float
    constant: float | None = None

    @property
    def n_nonzero(self) -> int:
        return sum(c != 0 for c in self.coef)


def penalised(g: np.ndarray, h: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Least value over d of g d + d h d / 2 + penalty |b + d|_1; the last coordinate is the intercept.

    Coordinate descent finds which coordinates are not zero, linear equations give these their values; a coordinate
    that would change its sign on the way stops at zero.
    """
    new, r = b.copy(), g.copy()  # r: gradient of the quadratic at ``new``
    diag = np.maximum(np.diag(h), 1e-12)
    cut = penalty / diag
    last = len(b) - 1
    cut[last] = 0.0
    for _ in range(200):
        most = 0.0
        for j in range(len(b)):
            z = new[j] - r[j] / diag[j]
            x = z - cut[j] if z > cut[j] else z + cut[j] if z < -cut[j] else 0.0
            if d := x - new[j]:
                r += h[:, j] * d
                new[j] = x
                most = max(most, abs(d))
        if most < TOLERANCE / 100:
            break
        for _ in range(len(b)):
            at = np.append(np.flatnonzero(new[:last]), last)
            sign = np.sign(new[at])
            sign[-1] = 0.0
            try:
                d = -np.linalg.solve(h[np.ix_(at, at)], r[at] + penalty * sign)
            except np.linalg.LinAlgError:
                break
            turned = sign * (new[at] + d) < 0
            part = np.full(len(at), 1.0)
            part[turned] = -new[at][turned] / d[turned]
            least = part.min()
            r += h[:, at] @ (d * least)
            new[at] += d * least
            new[at[turned & (part == least)]] = 0.0
            if not turned.any():
                break
    return new


def fold_matrix(part: pd.DataFrame, target: np.ndarray) -> np.ndarray:
    """rows x models: the fold of each row for each model's target; ``fold`` is one number a row, or one for each target."""
    return np.stack(part["fold"].to_numpy())[:, target] if part["fold"].dtype == object else part["fold"].to_numpy()[:, None]


def sums_kernel(kind: str, models: list[Model], coefs: np.ndarray, weights: dict, columns: dict[str, np.ndarray], slices: int):
    """mapInPandas over (x, fold, ys): for each model the sums of weight, loss, gradient and curvature of one task, over the ``columns`` of its head; the curvature by rows of its upper triangle."""
    fold = np.array([m.fold for m in models])
    target = np.array([m.target for m in models])
    one = np.array([[weights.get((m.target, m.fold, c), 1.0) for c in (0, 1)] for m in models])
    groups = [([k for k, m in enumerate(models) if m.head == h], columns[h], np.triu_indices(len(columns[h]))) for h in dict.fromkeys(m.head for m in models)]
    most = max(len(up[0]) for _, _, up in groups)
    size = max(64, min(2000, 2_000_000 // most))  # 16 MB of products at a time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss = np.zeros(len(models)), np.zeros(len(models))
        grad, curve = [np.zeros((len(g), len(c))) for g, c, _ in groups], [np.zeros((len(g), len(up[0]))) for g, _, up in groups]
        some = False
        for b in batches:
            for since in range(0, len(b), size):
                part = b.iloc[since : since + size]
                if not len(part):
                    continue
                some = True
                x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
                y = np.stack(part["ys"].to_numpy())[:, target]  # rows x models
                m = x @ coefs.T
                w = (fold_matrix(part, target) != fold[None, :]).astype(float)
                if kind == "classification":
                    w *= np.where(y > 0.5, one[:, 1], one[:, 0])
                    p = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
                    loss += (w * (np.logaddexp(0, m) - y * m)).sum(0)
                    h = w * p * (1 - p)
                else:
                    p, h = m, w
                    loss += (w * (m - y) ** 2).sum(0) / 2
                total += w.sum(0)
                d = w * (p - y)
                for i, (g, c, (left, right)) in enumerate(groups):
                    own = x[:, c]
                    grad[i] += d[:, g].T @ own
                    curve[i] += h[:, g].T @ (own[:, left] * own[:, right])
        if some:
            for i, (g, _, _) in enumerate(groups):
                yield pd.DataFrame({"model": np.array(g), "slice": TaskContext.get().partitionId() % slices, "total": total[g], "loss": loss[g], "grad": list(grad[i]), "curve": list(curve[i])})

    return run


SUMS = "model int, slice int, total double, loss double, grad array<double>, curve array<double>"


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of several tasks as one row for each model."""
    rows = [(k, 0, own["total"].sum(), own["loss"].sum(), np.sum(np.stack(own["grad"].to_numpy()), 0), np.sum(np.stack(own["curve"].to_numpy()), 0)) for k, own in pdf.groupby("model")]
    return pd.DataFrame(rows, columns=["model", "slice", "total", "loss", "grad", "curve"])


def newton(models: list[Model], columns: dict[str, np.ndarray], coefs: np.ndarray, last: np.ndarray, best: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The next coefficients of some models from their sums; a step that went too far is taken half back."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in added(pdf).itertuples():
            k, own = s.model, columns[models[s.model].head]
            b = coefs[k, own]
            here = s.loss / s.total + models[k].penalty * np.abs(b[:-1]).sum()
            if here > best[k] + 1e-10:
                out.append((k, (coefs[k] + last[k]) / 2, best[k], 1.0, last[k]))
                continue
            h = np.zeros((len(own), len(own)))
            h[np.triu_indices(len(own))] = s.curve / s.total
            h = h + np.triu(h, 1).T + 1e-10 * np.eye(len(own))
            new = coefs[k].copy()
            new[own] = penalised(s.grad / s.total, h, b, models[k].penalty)
            out.append((k, new, here, np.abs(new - coefs[k]).max(), coefs[k]))
        return pd.DataFrame(out, columns=["model", "coef", "value", "moved", "base"])

    return step


def solve(rows: DataFrame, kind: str, models: list[Model], free: dict[str, np.ndarray], weights: dict, width: int, slices: int = 16) -> np.ndarray:
    """Coefficients (models x (width + 1), intercept last) of all models. ``rows``: (x, fold, ys), standardised; ``free``: the features of each head and the intercept."""
    columns = {h: np.flatnonzero(f) for h, f in free.items()}
    now = np.zeros((len(models), width + 1))
    before, value = now.copy(), np.full(len(models), np.inf)
    active, many = list(range(len(models))), rows.rdd.getNumPartitions() > slices
    for _ in range(STEPS):
        mine = [models[k] for k in active]
        sums = rows.select("x", "fold", "ys").mapInPandas(sums_kernel(kind, mine, now[active], weights, columns, slices), SUMS)
        some = (F.col("model") % slices).alias("some")
        if many:
            sums = sums.groupBy(some, "slice").applyInPandas(added, SUMS)
        got = sums.groupBy(some).applyInPandas(newton(mine, columns, now[active], before[active], value[active]), "model int, coef array<double>, value double, moved double, base array<double>").collect()  # models x features numbers
        moving = []
        for r in got:
            k = active[r.model]
            now[k], before[k], value[k] = r.coef, r.base, r.value
            if r.moved > TOLERANCE:
                moving.append(k)
        active = sorted(moving) if kind == "classification" else []
        if not active:
            break
    return now


def standardised(rows: DataFrame, x: str = "x") -> tuple[DataFrame, list[float], list[float]]:
    """``rows`` with each feature by its mean and sd, NaN and null as 0; an sd of 0 counts as 1."""
    clean = F.transform(x, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    s = rows.select(F.posexplode(clean).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("j").collect()  # one row a feature
    mean, sd = [r.m for r in s], [r.s if r.s > 1e-12 else 1.0 for r in s]
    return rows.withColumn(x, scaled(clean, mean, sd)), mean, sd


def scaled(x: Column, mean: list[float], sd: list[float]) -> Column:
    scale = F.arrays_zip(F.array(*[F.lit(float(m)) for m in mean]).alias("m"), F.array(*[F.lit(float(s)) for s in sd]).alias("s"))
    return F.zip_with(x, scale, lambda v, k: (v - k["m"]) / k["s"])


def shuffled(rows: DataFrame, target: str, n: int, seed: int, id_: str = "id", n_folds: int | None = None) -> DataFrame:
    """``rows`` with ys: the target, then n permutations of it.

    The target of the row at one hash order's place goes to the row at another's. Places come from ranges of
    the hash, so no task orders all rows. With ``n_folds``, fold becomes an array of the same length: the rows'
    own fold, then for each permutation the fold that its targets, in order, are dealt to in turn, so that every
    permutation has each class in all folds alike.
    """
    ids = rows.select(F.col(id_).alias("_to"), F.col(target).cast("double").alias("_y"))
    total = ids.count()
    own = places(ids, ["_y", "_to"] if n_folds else ["_to"], "_place").select("_place", "_y")
    draws = ids.select("_to", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k")) if n else ids.select("_to", F.lit(0).alias("_k")).where("false")
    draws = places(draws.withColumn("_h", F.xxhash64(F.lit(seed + 7919), "_k", "_to")), ["_k", "_h", "_to"], "_place")
    drawn = draws.withColumn("_place", F.col("_place") - (F.col("_k") - 1) * F.lit(total)).join(own, "_place")
    drawn = drawn.withColumn("_f", (F.col("_place") % F.lit(n_folds or 1)).cast("int"))
    drawn = drawn.groupBy(F.col("_to").alias(id_)).agg(F.array_sort(F.collect_list(F.struct("_k", "_y", "_f"))).alias("_ys"))  # n values
    d = rows.join(drawn, id_, "left").withColumn("_ys", F.coalesce("_ys", F.array().cast("array<struct<_k:int,_y:double,_f:int>>")))
    d = d.withColumn("ys", F.concat(F.array(F.col(target).cast("double")), F.transform("_ys", lambda v: v["_y"])))
    return (d.withColumn("fold", F.concat(F.array("fold"), F.transform("_ys", lambda v: v["_f"]))) if n_folds else d).drop("_ys")


def folds_of(rows: DataFrame, n: int, id_: str = "id", target: str | None = None, time_ordered: bool = False) -> DataFrame:
    """``rows`` with fold 0 to n - 1: consecutive runs of ids, or dealt in turn by hash (within each class of ``target``)."""
    if time_ordered:
        total = rows.agg(F.count("*").alias("_n"))
        return places(rows, [id_], "_place").join(F.broadcast(total)).withColumn("fold", F.floor(F.col("_place") * n / F.col("_n")).cast("int")).drop("_place", "_n")
    key = [F.col(target)] if target else []
    d = rows.withColumn("_h", F.xxhash64(F.lit(17), id_))
    d = places(d.withColumn("_k", key[0] if key else F.lit(0)), ["_k", "_h", id_], "_place")
    return d.withColumn("fold", (F.col("_place") % n).cast("int")).drop("_h", "_k", "_place")


def fit_heads(rows: DataFrame, kind: str, heads: dict[str, list[int]], n_folds: int = 5, strengths: tuple[float, ...] = STRENGTHS, only: Callable[[str, int], bool] = lambda head, target: True) -> tuple[dict[tuple[str, int], Head], list[float], list[float]]:
    """({(head, target): fitted head}, means, sds of the features) of every head on every target, or those of ``only``.

    ``rows``: (fold, x: all features, ys: targets), the fold a number or an array with one for each target;
    ``heads``: the features each head may use; one without variance stays at 0. The strength of
    each is the one of least mean loss on the folds left out (the strongest on ties): log loss for
    "classification" over ``strengths`` (C), squared error for "regression" over 30 penalties down to a
    thousandth of the least that leaves no feature. Targets with fewer than two rows of a class in some
    training part leave that fold out; with fewer than two usable folds the head is a constant.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rows, mean, sd = standardised(rows)
    rows = rows.select("x", "fold", "ys").repartition(max(1, min(TASKS, -(-rows.count() // TASK_ROWS)))).persist()
    width = len(mean)
    live = rows.agg(*[F.max(F.get("x", F.lit(j)) != 0).alias(f"f{j}") for j in range(width)]).first()
    free = {h: np.isin(np.arange(width + 1), [*(j for j in use if live[j]), width]) for h, use in heads.items()}
    own_fold = F.get("fold", F.col("t")) if dict(rows.dtypes)["fold"].startswith("array") else F.col("fold")
    counts = rows.select("fold", F.posexplode("ys").alias("t", "y")).select("t", own_fold.alias("fold"), "y").groupBy("t", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # targets x folds rows
    n, pos = {}, {}
    for r in counts:
        for f in (-1, *range(n_folds)):
            if f != r.fold:
                n[r.t, f] = n.get((r.t, f), 0) + r.n
                pos[r.t, f] = pos.get((r.t, f), 0.0) + r.y
    targets = sorted({t for t, _ in n})
    weights, usable = {}, {}
    for t in targets:
        if kind == "classification":
            least = min(pos[t, -1], n[t, -1] - pos[t, -1])
            folds = [f for f in range(n_folds) if (t, f) in n and 0 < pos[t, f] < n[t, f]]
            usable[t] = folds if min(least, len(folds)) >= 2 else []
            for f in (-1, *usable[t]):
                if 0 < pos[t, f] < n[t, f]:
                    weights |= {(t, f, 1): n[t, f] / (2 * pos[t, f]), (t, f, 0): n[t, f] / (2 * (n[t, f] - pos[t, f]))}
        else:
            usable[t] = [f for f in range(n_folds) if (t, f) in n and n[t, f] < n[t, -1]]
    models = []
    if kind == "classification":
        for h in heads:
            for t in (t for t in targets if only(h, t)):
                models += [Model(h, t, f, 1.0 / (c * n[t, f]), k) for f in ((-1, *usable[t]) if usable[t] else ()) for k, c in enumerate(strengths)]
    else:
        total = {t: pos[t, -1] / n[t, -1] for t in targets}
        top = rows.select(F.posexplode("ys").alias("t", "y"), "x").select("t", F.posexplode(F.transform("x", lambda v: v * F.col("y"))).alias("j", "xy"), F.get("x", F.col("j")).alias("v")).groupBy("t", "j").agg(F.sum("xy").alias("xy"), F.sum("v").alias("v")).collect()  # targets x features rows
        most = {(h, t): max([abs(r.xy - total[t] * r.v) / n[t, -1] for r in top if r.t == t and r.j in set(use)], default=0.0) or 1.0 for h, use in heads.items() for t in targets}
        path = np.logspace(0, np.log10(LASSO_RATIO), LASSO_PATH)
        models = [Model(h, t, f, float(most[h, t] * x), k) for h in heads for t in targets if only(h, t) for f in (-1, *usable[t]) for k, x in enumerate(path)]
    coefs = solve(rows, kind, models, free, weights, width) if models else np.zeros((0, width + 1))
    losses = held_out(rows, kind, models, coefs)
    rows.unpersist()
    out = {}
    for h in heads:
        for t in (t for t in targets if only(h, t)):
            mine = [k for k, m in enumerate(models) if m.head == h and m.target == t]
            if not mine:
                out[h, t] = Head(h, 0.0, [0.0] * width, 0.0, pos[t, -1] / n[t, -1])
                continue
            by: dict[int, list[float]] = {}
            for k in mine:
                if models[k].fold >= 0:
                    by.setdefault(models[k].step, []).append(losses[k])
            best = min(by, key=lambda s: (np.mean(by[s]), s)) if by else 0
            k = next(k for k in mine if models[k].fold < 0 and models[k].step == best)
            strength = strengths[best] if kind == "classification" else models[k].penalty
            out[h, t] = Head(h, float(strength), coefs[k, :-1].tolist(), float(coefs[k, -1]))
    return out, mean, sd


def held_out(rows: DataFrame, kind: str, models: list[Model], coefs: np.ndarray) -> list[float]:
    """Mean loss of each model on the fold it left out (0 for those that left none out)."""
    if not models:
        return []
    fold, target = np.array([m.fold for m in models]), np.array([m.target for m in models])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n = np.zeros(len(models)), np.zeros(len(models))
        for b in batches:
            for since in range(0, len(b), 2000):
                part = b.iloc[since : since + 2000]
                if len(part):
                    m = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))]) @ coefs.T
                    y = np.stack(part["ys"].to_numpy())[:, target]
                    out = fold_matrix(part, target) == fold[None, :]
                    each = np.logaddexp(0, m) - y * m if kind == "classification" else (m - y) ** 2
                    loss += np.where(out, each, 0).sum(0)
                    n += out.sum(0)
        yield pd.DataFrame({"model": np.arange(len(models)), "loss": loss, "n": n})

    got = rows.select("x", "fold", "ys").mapInPandas(run, "model int, loss double, n double").groupBy("model").agg((F.sum("loss") / F.greatest(F.lit(1.0), F.sum("n"))).alias("loss")).collect()
    out = [0.0] * len(models)
    for r in got:
        out[r.model] = r.loss
    return out


def score(rows: DataFrame, heads: list[tuple[str, Head]], kind: str, mean: list[float], sd: list[float], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, name, score) of each row (x) by each head: a probability or a predicted value."""
    clean = F.transform("x", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    d = rows.withColumn("x", scaled(clean, mean, sd))

    def one(h: Head) -> Column:
        if h.constant is not None:
            return F.lit(float(h.constant))
        dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in h.coef]), lambda v, c: v * c), F.lit(float(h.intercept)), lambda a, v: a + v)
        return 1 / (1 + F.exp(-dot)) if kind == "classification" else dot

    return d.select(*keep, F.inline(F.array(*[F.struct(F.lit(name).alias("name"), one(h).alias("score")) for name, h in heads])))


def top_terms(head: Head, names: list[str], k: int = 10) -> list[tuple[str, float, str]]:
    """The k terms of largest absolute coefficient (first ones on ties) with their direction; zeros are no terms."""
    order = sorted(range(len(head.coef)), key=lambda i: -abs(head.coef[i]))
    return [(names[i], head.coef[i], "raises_risk" if head.coef[i] > 0 else "lowers_risk") for i in order[:k] if head.coef[i]]


def contributions(x: Column, head: Head, mean: list[float], sd: list[float]) -> Column:
    """Array of coefficient x standardised feature; with the intercept they add up to the row's log-odds or predicted value."""
    clean = F.transform(x, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return F.zip_with(scaled(clean, mean, sd), F.array(*[F.lit(float(c)) for c in head.coef]), lambda v, c: v * c)


def readout(fit_rows: DataFrame, test_rows: DataFrame, kind: str, heads: dict[str, list[int]], base: str, n_folds: int = 5, n_permutations: int = 20, permuted: str = "symbolic", seed: int = 0, strengths: tuple[float, ...] = STRENGTHS, n_examples: int = 6) -> tuple[DataFrame, dict]:
    """((name, aurc, oracle_aurc, excess, gain, curve), report) of sparse reliability heads against fit-free signals.

    ``fit_rows``: (id, x, target): 1 for a wrong class, or the log of the loss; ``test_rows``: (id, x, loss,
    ``base``: the model's own risk signal). Heads are fitted once on the fit rows and judged once on the test
    rows, next to ``base``, mean percent ranks of it (and of an "embedding" head) with the other plain heads
    ("rank:"), and chance. The null of the ``permuted`` head refits it, folds and strengths included, on permuted
    targets, in the same passes as the heads themselves; its p is (1 + #{null <= observed}) / (1 + permutations).
    Classes are dealt to min(n_folds, rows of the smaller class) folds. ``curve``: the risks at 5, 10 to 100 %
    coverage; ``report["examples"]``: the test rows of highest risk by the ``permuted`` head with their
    ``contributions``.
    """
    if kind == "classification":
        n = fit_rows.agg(F.count_if(F.col("target") > 0.5).alias("a"), F.count_if(F.col("target") <= 0.5).alias("b")).first()
        n_folds = max(1, min(n_folds, n.a, n.b))
    d = folds_of(fit_rows, n_folds, target="target" if kind == "classification" else None, time_ordered=kind == "regression")
    d = fixed(shuffled(d, "target", n_permutations, seed, n_folds=n_folds if kind == "classification" else None))
    own, mean, sd = fit_heads(d, kind, heads, n_folds, strengths, lambda h, t: t == 0 or h == permuted)
    fitted = [(h, own[h, 0]) for h in heads] + [(f"null:{k}", own[permuted, 1 + k]) for k in range(n_permutations)]
    by_head = score(test_rows, fitted, kind, mean, sd, ("id", "loss", base))
    by_head = fixed(by_head)
    plain = by_head.where(F.col("name") == permuted).select("id", "loss", F.col(base).alias("score"))
    streams = [by_head.select("name", "id", "score", "loss"), plain.select(F.lit(base).alias("name"), "id", "score", "loss"), plain.select(F.lit("random").alias("name"), "id", hash_order("id", seed + 17).cast("double").alias("score"), "loss")]
    simple = [h for h in heads if "+" not in h and h != "embedding"]
    for a, h in [(a, h) for a in (base, "embedding") if a == base or a in heads for h in simple]:
        both = by_head.where(F.col("name") == h).select("id", "loss", F.col(base).alias("a"), F.col("score").alias("b"))
        if a != base:
            both = both.drop("a").join(by_head.where(F.col("name") == a).select("id", F.col("score").alias("a")), "id")
        streams.append(combined(both, "a", "b").select(F.lit(f"rank:{a}+{h}").alias("name"), "id", "score", "loss"))
    every = streams[0]
    for s in streams[1:]:
        every = every.unionByName(s)
    curve, summary = risk_coverage(fixed(every), ("name",))
    curve = curve.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("coverage", "risk"))), lambda c: c["risk"]).alias("curve"))  # 20 numbers a name
    summary = fixed(summary.join(curve, "name"))
    values = {r["name"]: r["aurc"] for r in summary.select("name", "aurc").collect()}  # heads and permutations
    nulls = [values[f"null:{k}"] for k in range(n_permutations)]
    first = by_head.where(F.col("name") == permuted).orderBy(F.desc("score"), "id").limit(n_examples).select("id", F.col("score").alias("risk"))
    examples = test_rows.join(F.broadcast(first), "id").withColumn("parts", contributions(F.col("x"), own[permuted, 0], mean, sd)).orderBy(F.desc("risk"), "id").collect()  # n_examples rows
    report = {
        "observed_aurc": values[permuted], "null_aurc": nulls, "p_value": (1 + sum(v <= values[permuted] for v in nulls)) / (1 + len(nulls)),
        "head_sparsity": {h: {"n_nonzero": own[h, 0].n_nonzero, "n_features": len(heads[h]), "abstained_constant": own[h, 0].constant is not None} for h in heads},
        "heads": {h: own[h, 0] for h in heads}, "examples": examples,
    }
    return summary.where(~F.col("name").startswith("null:")), report
