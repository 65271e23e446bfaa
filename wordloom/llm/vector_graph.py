"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of one label are dealt to the nearest few of that label's clusters, so the shards overlap. How many
is measured: all links of a sample of rows are found by brute force, and the overlap of a label is raised
until both ends of each of them share a cluster. In each shard a graph is built by robust pruning (a candidate goes if a nearer pick is closer to it than the node
is, by a factor), the adjacency lists of all shards are united, and every vector is searched: greedily from
the shard's medoid and its own node, then expanding from every node in range until nothing new is in range.
Each link found is verified by its cosine in double precision, and counted in one shard only, the first
that both ends share. A shard returns a count and a tree edge a vector, never its pairs.

Equal vectors of a label are one node with a count. A cluster that stays larger than a shard (a tight group
of copies) is cut in blocks by hash and every two blocks are searched together, which loses nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, materialise, small_batches

DEGREE = 24
CANDIDATES = 48
BEAM = 12
ALPHA = 1.2


def unit(x) -> np.ndarray:
    v = np.stack([np.asarray(r, np.float64) for r in x])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def robust_graph(v: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency of unit vectors: pruned out-links of all nodes at once, and their reverses."""
    n = len(v)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    c = min(candidates, n - 1)
    near, sim = np.empty((n, c), np.int64), np.empty((n, c))
    for lo in range(0, n, 512):
        s = v[lo : lo + 512] @ v.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2.0
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        t = np.take_along_axis(s, top, 1)
        order = np.argsort(-t, axis=1, kind="stable")
        near[lo : lo + 512], sim[lo : lo + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(t, order, 1)
    far = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
    alive, picks = np.ones((n, c), bool), []
    rows = np.arange(n)
    for _ in range(min(degree, c)):
        some = alive.any(axis=1)
        if not some.any():
            break
        r = rows[some]
        k = alive[r].argmax(axis=1)
        pick = near[r, k]
        picks.append(np.stack([r, pick], axis=1))
        alive[r, k] = False
        for lo in range(0, len(r), 1024):
            q, p = r[lo : lo + 1024], pick[lo : lo + 1024]
            between = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("qcd,qd->qc", v[near[q]], v[p])))
            alive[q] &= alpha * between > far[q]
    e = np.concatenate(picks)
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    return np.split(e[:, 1], np.searchsorted(e[:, 0], np.arange(1, n)))


def padded(adjacency: list[np.ndarray]) -> np.ndarray:
    """Adjacency as a matrix; -1 fills short rows."""
    width = max([1, *map(len, adjacency)])
    out = np.full((len(adjacency), width), -1, np.int64)
    for i, a in enumerate(adjacency):
        out[i, : len(a)] = a
    return out


def range_search(v: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query position, node) of what a search over the graph finds at cosine ``least`` or more, the query's own node left out.

    ``queries``: nodes. Greedy search with a beam from the medoid and the query's own node, then expansion
    from all nodes in range.
    """
    n, q = len(v), len(queries)
    medoid = int((v @ v.mean(axis=0)).argmax())
    of = v[queries]
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    node = np.stack([np.full(q, medoid), queries], axis=1)
    sim = np.einsum("qbd,qd->qb", v[node], of)
    sim[node[:, 1] == node[:, 0], 1] = -3.0
    seen[rows, medoid], seen[rows, queries] = True, True
    done = np.zeros(node.shape, bool)
    done[sim < -2] = True
    in_q, in_n = [rows, rows], [np.full(q, medoid), queries]
    for _ in range(4 * beam):
        open_sim = np.where(done, -3.0, sim)
        k = open_sim.argmax(axis=1)
        live = np.flatnonzero(open_sim[rows, k] > -2.5)
        if not len(live):
            break
        done[live, k[live]] = True
        nbr = graph[node[live, k[live]]]
        fresh = (nbr >= 0) & ~seen[live[:, None], nbr]
        seen[live[:, None], np.where(fresh, nbr, node[live, k[live]][:, None])] = True
        s = np.where(fresh, np.einsum("qbd,qd->qb", v[np.maximum(nbr, 0)], of[live]), -3.0)
        x, y = np.nonzero(s >= least)
        in_q.append(live[x])
        in_n.append(nbr[x, y])
        all_sim, all_node, all_done = np.full((q, node.shape[1] + nbr.shape[1]), -3.0), np.zeros((q, node.shape[1] + nbr.shape[1]), np.int64), np.ones((q, node.shape[1] + nbr.shape[1]), bool)
        all_sim[:, : node.shape[1]], all_node[:, : node.shape[1]], all_done[:, : node.shape[1]] = sim, node, done
        all_sim[live, node.shape[1] :], all_node[live, node.shape[1] :], all_done[live, node.shape[1] :] = s, np.maximum(nbr, 0), ~fresh
        top = np.argpartition(-all_sim, min(beam, all_sim.shape[1]) - 1, axis=1)[:, :beam]
        sim, node, done = (np.take_along_axis(z, top, 1) for z in (all_sim, all_node, all_done))
    x, y = np.concatenate(in_q), np.concatenate(in_n)
    keep = np.einsum("ij,ij->i", v[y], of[x]) >= least
    x, y = x[keep], y[keep]
    found = np.zeros((q, n), bool)
    found[x, y] = True
    fresh = found.copy()
    while True:
        x, y = np.nonzero(fresh)
        if not len(x):
            break
        fresh = np.zeros((q, n), bool)
        for lo in range(0, len(x), 1 << 14):
            p, nbr = x[lo : lo + (1 << 14)], graph[y[lo : lo + (1 << 14)]]
            a, b = np.nonzero(nbr >= 0)
            key = np.unique(p[a] * n + nbr[a, b])
            a, b = key // n, key % n
            new = ~seen[a, b]
            a, b = a[new], b[new]
            seen[a, b] = True
            near = np.einsum("ij,ij->i", v[b], of[a]) >= least
            fresh[a[near], b[near]] = True
        found |= fresh
    found[rows, queries] = False
    return np.nonzero(found)


def needed_overlap(nodes: DataFrame, centres: dict, probes: dict, least: float) -> dict[str, tuple[int, int]]:
    """part: (links of the probes, nearest clusters that both ends of every one of them must be dealt to).

    ``probes``: unit vectors by part. Each is compared with every node of its part, itself left out.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((centres, probes))

    def ranks(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (-(v @ c.T)).argsort(axis=1).argsort(axis=1)

    def meet(batches):
        centres, probes = shared.value
        own = {p: ranks(v, centres[p][1]) for p, v in probes.items()}
        for pdf in batches:
            out = []
            for p, at in pdf.groupby("part").indices.items():
                if p not in probes:
                    continue
                v = unit(pdf["x"].iloc[at])
                s = v @ probes[p].T
                a, b = np.nonzero((s >= least) & (s < 1 - 1e-12))
                rank, need = ranks(v, centres[p][1]), 0
                for lo in range(0, len(a), 1 << 13):
                    need = max(need, int(np.maximum(rank[a[lo : lo + (1 << 13)]], own[p][b[lo : lo + (1 << 13)]]).min(axis=1).max()) + 1)
                out.append((p, len(a), need))
            yield pd.DataFrame(out, columns=["part", "links", "need"])

    found = nodes.select("part", "x").mapInPandas(meet, "part string, links long, need long")
    return {r.part: (r.links, r.need) for r in found.groupBy("part").agg(F.sum("links").alias("links"), F.max("need").alias("need")).collect()}


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, shard_rows: int = 1500, overlap: int = 3, sample_rows: int = 20_000, max_clusters: int = 4096, audit_rows: int = 2000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared only if their labels are equal and not null. A vector that is null, empty or zero,
    or has a null or non-finite component, links with nothing; so does one of another length than the
    query. Clusters are fitted on at most ``sample_rows`` rows; every row is indexed and searched. A row is
    dealt to ``overlap`` clusters at least, and to as many as the links of ``audit_rows`` sampled rows need. Repeated
    rows are vectors of their own that link with each other. n_links counts rows; a null id is kept false.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col(embedding).cast("array<double>")
    good = F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(good, x).alias("x"))
    key = [F.col("label"), F.size("x").alias("dim"), F.col("x")]
    nodes = rows.where("x is not null and vec_id is not null").groupBy(*key).agg(F.min("vec_id").cast("long").alias("gid"), F.count("*").alias("times"))
    nodes = materialise(nodes.withColumn("part", F.concat_ws("|", "label", "dim")), "vectors")
    counts = {r.part: r["count"] for r in nodes.groupBy("part").count().orderBy(F.desc("count")).limit(max_clusters).collect()}
    total = max(1, sum(counts.values()))
    clusters = {p: max(1, min(-(-n * overlap // shard_rows), max_clusters * n // total)) for p, n in counts.items()}
    some = nodes.where(F.shiftrightunsigned(F.xxhash64("gid"), 11) < F.lit(float(1 << 53) * min(1.0, sample_rows / total))).select("part", "x").limit(sample_rows).toPandas()
    centres, ids = {}, 0
    for p, group in some.groupby("part"):
        k = min(clusters.get(p, 1), len(group))
        if k > 1:
            centres[p] = (ids, kmeans(unit(group["x"]), k))
            ids += k
    probes = {p: unit(g["x"].iloc[: -(-audit_rows * len(g) // len(some))]) for p, g in some.groupby("part") if p in centres and audit_rows}
    need = {p: max(overlap, t) for p, (_, t) in needed_overlap(nodes, centres, probes, least).items()} if probes else {}
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches):
        for pdf in batches:
            out = np.empty(len(pdf), object)
            for p, at in pdf.groupby("part").indices.items():
                if p in shared.value:
                    first, c = shared.value[p]
                    t = min(need.get(p, overlap), len(c))
                    near = np.argpartition(-(unit(pdf["x"].iloc[at]) @ c.T), t - 1, axis=1)[:, :t] + first
                else:
                    near = np.full((len(at), 1), -1)
                for i, s in zip(at, np.sort(near, axis=1).tolist(), strict=True):
                    out[i] = s
            yield pdf.assign(shards=out)

    dealt = materialise(nodes.select("gid", "part", "times", "x").mapInPandas(deal, "gid long, part string, times long, x array<double>, shards array<int>"), "dealt")
    each = dealt.withColumn("shard", F.explode("shards"))
    sizes = materialise(each.groupBy("part", "shard").agg(F.ceil(F.count("*") / F.lit(2.0 * shard_rows)).cast("int").alias("blocks")), "shard-sizes")
    # a shard of several blocks is met block by block: a row goes to the pairs that its own block is in
    each = each.join(sizes, ["part", "shard"]).withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("gid", "part", "times", "x", "shards", "shard", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    group = ["part", "shard", "lo", "hi"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = pdf["gid"].to_numpy()
        return pd.DataFrame({"gid": gid, "near": [gid[a] for a in robust_graph(unit(pdf["x"]))]})

    lists = each.groupBy(*group).applyInPandas(build, "gid long, near array<long>")
    united = materialise(lists.groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid", ignore_index=True)
        v, gid, times = unit(pdf["x"]), pdf["gid"].to_numpy(), pdf["times"].to_numpy()
        graph = []
        for a in pdf["near"]:
            at = np.searchsorted(gid, np.asarray(a, np.int64))
            at[at == len(gid)] = 0
            graph.append(at[gid[at] == np.asarray(a, np.int64)])
        graph, width = padded(graph), max(map(len, pdf["shards"]))
        of = np.array([[*s, *[-2] * (width - len(s))] for s in pdf["shards"]], np.int64)  # wide enough for the mark of no shard below
        here, own, cross = int(pdf["shard"].iloc[0]), pdf["own"].to_numpy(), pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        links, parent = np.zeros(len(pdf), np.int64), list(range(len(pdf)))
        step = max(16, min(512, (1 << 22) // len(pdf)))
        for lo in range(0, len(pdf), step):
            queries = np.arange(lo, min(lo + step, len(pdf)))
            a, b = range_search(v, graph, queries, least)
            a = queries[a]
            first = np.empty(len(a), np.int64)
            for k in range(0, len(a), part := max(1, (1 << 24) // width**2)):
                x, y = of[a[k : k + part]], of[b[k : k + part]]
                same = (x[:, :, None] == y[:, None, :]) & (x > -2)[:, :, None]
                first[k : k + part] = np.where(same.any(axis=2), x, np.iinfo(np.int64).max).min(axis=1)
            mine = (first == here) & ((own[a] != own[b]) | (not cross))
            a, b = a[mine], b[mine]
            links += np.bincount(a, times[b], len(pdf)).astype(np.int64)
            up = a < b
            parent, _ = forest(len(pdf), a[up], b[up], parent)
        root = np.arange(len(pdf))
        for i in range(len(pdf)):
            root[i] = root[parent[i]] if parent[i] != i else i
        return pd.DataFrame({"gid": gid, "links": links, "root": gid[root]})

    found = materialise(each.join(united, "gid").groupBy(*group).applyInPandas(search, "gid long, links long, root long"), "links")
    comp = components(found.where("gid <> root").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("gid").agg(F.sum("links").alias("links")).join(comp.withColumnRenamed("node", "gid"), "gid", "left")
    named = nodes.select("gid", "label", "x", "times").join(per, "gid").select("label", "x", (F.col("links") + F.col("times") - 1).alias("n_links"), F.coalesce("component", "gid").alias("component_id"))
    r = rows.join(named, ["label", "x"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", F.col("vec_id").cast("long")))
    return r.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, every: int = 50, block: int = 2000) -> float | None:
    """Share of the links of all rows whose id ``every`` divides that ``result`` counts, against brute force over all rows; None if they have no link.

    The queries are broadcast in blocks of about ``block`` of them, one pass over the rows a block, so none is left out
    and the driver holds one block at a time.
    """
    rows = vectors.where(F.col(embedding).isNotNull() & F.col(label).isNotNull()).select(F.col(vec_id).alias("i"), F.col(label).cast("string").alias("l"), F.col(embedding).cast("array<double>").alias("x"))
    asked = rows.where(F.col("i") % every == 0)
    blocks = -(-asked.count() // block)
    counted = result.select(F.col(vec_id).alias("i"), "n_links")
    found = true = 0
    for k in range(blocks):
        q = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).toPandas()
        if not len(q):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((q["i"].to_numpy(), q["l"].to_numpy(), unit(q["x"])))

        def count(batches, shared=shared):
            ids, labels, v = shared.value
            for pdf in batches:
                s = v @ unit(pdf["x"]).T >= least
                s &= (labels[:, None] == pdf["l"].to_numpy()[None, :]) & (ids[:, None] != pdf["i"].to_numpy()[None, :])
                yield pd.DataFrame({"i": ids, "n": s.sum(axis=1)})

        n = rows.mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
        t = n.join(counted, "i").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
        found, true = found + (t[0] or 0), true + (t[1] or 0)
        shared.unpersist()
    return found / true if true else None
