"""Embedding near-deduplication on a robust-pruned flat graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table
from .components import connected_components

#: A shard with more vectors is split further, which bounds a task but costs work, as the parts overlap (2.5 times the vectors where 5,000 are cut in five). Shards that one round makes of one at most, and vectors that their centres are fitted on.
CELL, FAN, SAMPLE = 8_192, 256, 8_192
#: Links that pruning leaves a node, links it may gather before it is pruned again, width of the greedy search, ends of it expanded at once.
DEGREE, ROOM, BEAM, AT_ONCE, ALPHA, MEDOIDS = 16, 32, 24, 4, 1.2, 16
#: Nodes inserted, or queries run, at once.
BATCH = 256
#: The audit's queries: of all ids divisible by AUDIT so many, by a hash of the id. Bounds the audit, not the search.
AUDIT, AUDITED, LEAST_RECALL = 20, 1_024, 0.9
#: Rows of one shard that one task deals to its parts.
DEAL = 20_000

_SHARD = "cell string, rid long, vec {kind}, norm double, n long, was long"


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    """Unit rows in double precision. Vectors travel as they are stored, with their norms: as floats they take half the room."""
    return np.array(rows["vec"].tolist(), np.float64).reshape(len(rows), -1) / rows["norm"].to_numpy()[:, None]


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of unit rows, from evenly spaced first rows; deterministic."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=k) > 0
        c = c.copy()
        c[full] = sums[full] / np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-12)
    return c


def _centres(cell: int, radius: float):
    """Centres of a shard's sample, 2 * `radius` apart at least, so that a crowd of vectors that all link is not cut up."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(rows.sort_values("rid"))
        c = _kmeans(x, min(max(2, math.ceil(4 * int(rows["size"].iloc[0]) / cell)), len(x), FAN))
        far = [0]
        for i in range(1, len(c)):
            if ((c[far] - c[i]) ** 2).sum(1).min() >= (2 * radius) ** 2:
                far.append(i)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "k": [len(far)], "at": [c[far].ravel().tolist()]})

    return run


def _deal(radius: float):
    """Deals the rows of a shard, or of one part of them, to its new shards."""

    def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centres):
            return rows[["cell", "rid", "vec", "norm", "n", "size"]].rename(columns={"size": "was"})
        x, k = _vectors(rows), int(centres["k"].iloc[0])
        c = np.array(centres["at"].iloc[0], np.float64).reshape(k, -1)
        d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
        near = d.argmin(1)
        gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        over = (d - d.min(1, keepdims=True) <= gap[near] * radius + 1e-9) | (np.arange(k) == near[:, None])
        i, to = np.nonzero(over)
        out = rows.iloc[i]
        return pd.DataFrame({"cell": [f"{a}/{b}" for a, b in zip(out["cell"], to.tolist(), strict=True)], "rid": out["rid"].to_numpy(), "vec": out["vec"].to_numpy(), "norm": out["norm"].to_numpy(), "n": out["n"].to_numpy(), "was": out["size"].to_numpy()})

    return run


def shards(nodes: DataFrame, radius: float, cell: int = CELL) -> DataFrame:
    """(cell, rid, vec, norm, n, was): overlapping shards of the nodes of each label.

    A shard of more than `cell` vectors is split by centres that are fitted on a bounded sample of it. Each vector goes to
    its nearest centre, and to every other one if the plane midway between the two is within half of `radius`, a link's length: the ends of a
    link are on either side of such a plane, so one of them is near enough to it, and both meet in a shard. Every shard above the bound is split in
    each round, until it is small enough or has kept over 0.8 of what was split, as vectors that are all alike do. Sizes, samples
    and centres stay in tables; the driver learns only whether there is a shard to split.
    """
    kind = F.col("label").cast("string")
    now = nodes.select(F.concat(F.length(kind), F.lit(":"), kind).alias("cell"), "rid", "vec", "norm", "n", F.lit(1 << 62).alias("was"))
    shard = _SHARD.format(kind=nodes.schema["vec"].dataType.simpleString())
    while True:
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("was").alias("before")).filter((F.col("size") > cell) & (F.col("size") <= 0.8 * F.col("before")))
        sizes = materialise(sizes.select(F.col("cell").alias("c"), "size"))
        if sizes.isEmpty():
            return now
        large = now.join(sizes, F.col("cell") == F.col("c")).drop("c")
        some = large.filter(F.pmod(F.xxhash64("rid", "cell"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("size"))
        centres = some.groupBy("cell").applyInPandas(_centres(cell, radius), "cell string, k int, at array<double>")
        parts = F.ceil(F.col("size") / DEAL)
        centres = centres.join(sizes, F.col("cell") == F.col("c")).select("cell", "k", "at", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        dealt = large.withColumn("part", F.pmod(F.xxhash64("rid"), parts)).groupBy("cell", "part").cogroup(centres.groupBy("cell", "part")).applyInPandas(_deal(radius), shard)
        now = materialise(now.join(sizes, F.col("cell") == F.col("c"), "left_anti").union(dealt))


def _prune(x: np.ndarray, pool: np.ndarray, sim: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning, a row of `pool` for each node: a candidate stays unless one kept is ALPHA times nearer to it than the node. -1 pads."""
    order = np.argsort(-sim, axis=1, kind="stable")
    pool, sim = np.take_along_axis(pool, order, 1), np.take_along_axis(sim, order, 1)
    valid = (pool >= 0) & (sim > -np.inf)
    v = x[np.maximum(pool, 0)]
    to = np.float32(ALPHA**2) * (2 - 2 * v @ v.transpose(0, 2, 1))
    own = 2 - 2 * sim
    keep, dropped, kept = np.zeros(pool.shape, bool), ~valid, np.zeros(len(pool), int)
    for j in range(pool.shape[1]):
        now = ~dropped[:, j] & (kept < degree)
        keep[:, j] = now
        kept += now
        dropped |= now[:, None] & (to[:, j] <= own)
    out = np.where(keep, pool, -1)
    first = np.argsort(~keep, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(out, first, 1)


def walk(x: np.ndarray, links: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM, least: float | None = None, own: np.ndarray | None = None):
    """Greedy search of the graph from the starts for each row of `queries`: (ids, cosines) of the best met, -1 pads.

    With `least` the range is expanded too: every node met within it, or half as far again, is expanded, until no new one turns
    up; gives the pairs (query, node) met with a cosine of about `least` or more. `own` are the queries' own nodes: one
    that the greedy search has not met is met then.
    """
    n, q = len(x), len(queries)
    seen, spread, wide = (np.zeros((q, n), bool) for _ in range(3))
    order = np.zeros((q, n), np.int32)
    pool, sim, shut = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32), np.ones((q, beam), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    slack = None if least is None else 1 - 1.5 * (1 - least)

    def look(qi: np.ndarray, vi: np.ndarray):
        new = ~seen[qi, vi]
        qi, vi = qi[new], vi[new]
        at = np.arange(len(qi), dtype=np.int32)
        order[qi, vi] = at
        first = order[qi, vi] == at  # one of those that meet the same node
        qi, vi = qi[first], vi[first]
        seen[qi, vi] = True
        s = np.einsum("ij,ij->i", x[vi], queries[qi])
        if least is not None:
            wide[qi, vi] = s >= slack
            near = s >= least - 1e-4
            hits.append((qi[near], vi[near]))
        return qi, vi, s

    def merge(qi, vi, s):
        nonlocal pool, sim, shut
        if not len(qi):
            return
        begin = np.concatenate([[True], qi[1:] != qi[:-1]])
        col = np.arange(len(qi)) - np.maximum.accumulate(np.where(begin, np.arange(len(qi)), 0))
        width = int(col.max()) + 1
        new_v, new_s = np.full((q, width), -1), np.full((q, width), -np.inf, np.float32)
        new_v[qi, col], new_s[qi, col] = vi, s
        all_v, all_s = np.concatenate([pool, new_v], 1), np.concatenate([sim, new_s], 1)
        all_shut = np.concatenate([shut, new_v < 0], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        pool, sim, shut = (np.take_along_axis(a, top, 1) for a in (all_v, all_s, all_shut))

    def around(qi, vi):
        spread[qi, vi] = True
        to = links[vi]
        ok = to >= 0
        return look(np.broadcast_to(qi[:, None], to.shape)[ok], to[ok])

    merge(*look(np.repeat(np.arange(q), len(starts)), np.tile(starts, q)))
    while not shut.all():
        score = np.where(shut, -np.inf, sim)
        top = np.argpartition(-score, AT_ONCE - 1, axis=1)[:, :AT_ONCE]
        qi, col = np.nonzero(np.take_along_axis(score, top, 1) > -np.inf)
        at = top[qi, col]
        shut[qi, at] = True
        merge(*around(qi, pool[qi, at]))
    if least is None:
        return pool, sim
    if own is not None:
        look(np.arange(q), own)
    while True:
        qi, vi = np.nonzero(wide & ~spread)
        if not len(qi):
            return tuple(map(np.concatenate, zip(*hits, strict=True)))
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        around(qi[rank < 16], vi[rank < 16])


def _medoids(x: np.ndarray) -> np.ndarray:
    """Rows nearest to the centres of a few clusters."""
    c = _kmeans(x[:: max(1, len(x) // 1000)], min(MEDOIDS, len(x)), 3)
    return np.unique((c @ x.T).argmax(1))


def graph(x: np.ndarray) -> np.ndarray:
    """Adjacency (n, ROOM), -1 pads. Nodes are inserted by searching the graph so far from the medoids; as many at once as it holds, BATCH at most."""
    n = len(x)
    links = np.full((n, ROOM), -1)
    starts = _medoids(x)
    rest = np.random.default_rng(n).permutation(np.setdiff1d(np.arange(n), starts))
    todo, batch = rest, starts
    while len(batch):
        if batch is starts:
            pool, sim = np.zeros((len(batch), 0), int), np.zeros((len(batch), 0), np.float32)
        else:
            pool, sim = walk(x, links, starts, x[batch])
        fellow = x[batch] @ x[batch].T  # those inserted at once don't meet in the graph
        np.fill_diagonal(fellow, -np.inf)
        k = min(8, len(batch))
        top = np.argpartition(-fellow, k - 1, axis=1)[:, :k]
        pool, sim = np.concatenate([pool, batch[top]], 1), np.concatenate([sim, np.take_along_axis(fellow, top, 1)], 1)
        found = _prune(x, pool, sim)
        links[batch, : found.shape[1]] = found
        _link_back(x, links, batch, found)
        size = min(BATCH, n - len(todo))
        batch, todo = todo[:size], todo[size:]
    return links


def _link_back(x: np.ndarray, links: np.ndarray, batch: np.ndarray, found: np.ndarray) -> None:
    """Adds the reverse of the links batch -> found. A node with no room left is pruned anew."""
    ok = found >= 0
    to, come = found[ok], np.broadcast_to(batch[:, None], found.shape)[ok]
    back = (links[to] == come[:, None]).any(1)
    to, come = to[~back], come[~back]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, come = to[order], come[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    new = np.full((len(nodes), int(count.max())), -1)
    row = np.repeat(np.arange(len(nodes)), count)
    new[row, np.arange(len(to)) - np.repeat(first, count)] = come
    pool = np.concatenate([links[nodes], new], 1)
    full = (pool >= 0).sum(1) > ROOM
    tight = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), 1)[:, :ROOM]
    links[nodes[~full]] = tight[~full]
    if full.any():
        own, some = nodes[full], pool[full]
        sim = np.where(some >= 0, np.einsum("qwd,qd->qw", x[np.maximum(some, 0)], x[own]), -np.inf).astype(np.float32)
        links[own] = -1
        kept = _prune(x, some, sim)
        links[own, : kept.shape[1]] = kept


def _reached(links: np.ndarray, starts: np.ndarray) -> np.ndarray:
    met = np.zeros(len(links), bool)
    met[starts] = True
    now = starts
    while len(now):
        to = np.unique(links[now])
        now = to[(to >= 0) & ~met[to]]
        met[now] = True
    return met


def _widened(links: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """links with at -> to besides, in as many more columns as that takes."""
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    col = np.arange(len(at)) - np.searchsorted(at, at)
    more = np.full((len(links), int(col.max(initial=-1)) + 1), -1)
    more[at, col] = to
    return np.concatenate([links, more], 1)


def connect(x: np.ndarray, links: np.ndarray, starts: np.ndarray, nearest: int = 4) -> np.ndarray:
    """links, widened: the `nearest` ends of each node's links lead back to it, as pruning takes such links from nodes in a crowd; and
    every node can be reached from the starts: one that can't gets a link from the nearest of its links' ends that can."""
    sim = np.where(links >= 0, np.einsum("qwd,qd->qw", x[np.maximum(links, 0)], x), -np.inf)
    top = np.argsort(-sim, axis=1, kind="stable")[:, :nearest]
    node, via = np.repeat(np.arange(len(links)), top.shape[1]), np.take_along_axis(links, top, 1).ravel()
    node, via = node[via >= 0], via[via >= 0]
    lacks = ~(links[via] == node[:, None]).any(1)
    links = _widened(links, via[lacks], node[lacks])
    while True:
        met = _reached(links, starts)
        lost = np.flatnonzero(~met)
        if not len(lost):
            return links
        to = links[lost]
        ok = (to >= 0) & met[np.maximum(to, 0)]
        some = ok.any(1)
        if some.any():
            lost, to, ok = lost[some], to[some], ok[some]
            sim = np.where(ok, np.einsum("qwd,qd->qw", x[np.maximum(to, 0)], x[lost]), -np.inf)
            via = to[np.arange(len(lost)), sim.argmax(1)]
        else:
            lost, via = lost[:1], starts[:1]
        links = _widened(links, via, lost)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of one shard, by rid."""
    rows = rows.sort_values("rid")
    ids = rows["rid"].to_numpy()
    links = graph(_vectors(rows).astype(np.float32))
    return pd.DataFrame({"rid": ids, "cell": rows["cell"].to_numpy(), "nbrs": [ids[v[v >= 0]] for v in links]})


class _Pairs:
    """Links of the rows of one shard: counted for the pairs that are the shard's to count, and joined in a forest."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.weight = rows["rid"].to_numpy(), rows["n"].to_numpy()
        self.linked, self.root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        here = rows["cell"].iloc[0]
        lower = [sorted(c for c in set(cells) if c < here) for cells in rows["cells"]]
        names = {c: i for i, c in enumerate(sorted({c for cs in lower for c in cs}))}
        self.lower = np.full((len(rows), max(1, max(map(len, lower)))), -1)
        for i, cs in enumerate(lower):
            self.lower[i, : len(cs)] = [names[c] for c in cs]

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs a -> b, all different. Of the shards where both are, the first by name counts them."""
        both = self.lower[a][:, :, None] == self.lower[b][:, None, :]
        mine = ~(both & (self.lower[a] >= 0)[:, :, None]).any((1, 2))
        self.linked += np.bincount(a[mine], self.weight[b[mine]], len(self.ids)).astype(np.int64)
        apart = self.root[a] != self.root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if self.root[i] != self.root[j]:
                i, j = self.top(i), self.top(j)
                self.root[max(i, j)] = min(i, j)
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]

    def out(self) -> pd.DataFrame:
        roots = np.array([self.top(i) for i in range(len(self.ids))], np.int64)
        out = pd.DataFrame({"rid": self.ids, "linked": self.linked, "root": self.ids[roots]})
        return out[(out["linked"] > 0) | (out["rid"] != out["root"])]


def _search(least: float):
    """Searches one shard's part of the united graph for the links of each of its rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        x, ids, n = _vectors(rows), rows["rid"].to_numpy(), len(rows)
        size = np.array([len(v) for v in rows["nbrs"]])
        flat = np.concatenate(rows["nbrs"].to_numpy()).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ids, flat), n - 1)
        row, here = np.repeat(np.arange(n), size), ids[at] == flat
        row, at = row[here], at[here]
        links = np.full((n, max(1, int(np.bincount(row, minlength=n).max()))), -1)
        links[row, np.arange(len(row)) - np.searchsorted(row, row)] = at
        small, pairs = x.astype(np.float32), _Pairs(rows)
        starts = _medoids(small)
        links = connect(small, links, starts)
        for a in range(0, n, BATCH):
            own = np.arange(a, min(n, a + BATCH))
            qi, vi = walk(small, links, starts, small[own], least=least, own=own)
            qi = own[qi]
            good = (qi != vi) & (np.einsum("ij,ij->i", x[qi], x[vi]) >= least)
            pairs.add(qi[good], vi[good])
        return pairs.out()

    return run


def _compare(least: float):
    """All cosines between two blocks, or in one, of a shard whose vectors are all alike."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        x, block, pairs = _vectors(rows), rows["block"].to_numpy(), _Pairs(rows)
        one = rows["low"].iloc[0] == rows["high"].iloc[0]
        for a in range(0, len(x), BATCH):
            own = np.arange(a, min(len(x), a + BATCH))
            near = x[own] @ x.T >= least
            near &= (own[:, None] != np.arange(len(x))) if one else block[own][:, None] != block
            qi, vi = np.nonzero(near)
            pairs.add(own[qi], vi)
        return pairs.out()

    return run


_FOUND = "rid long, linked long, root long"


def _links(nodes: DataFrame, least: float, cell: int) -> DataFrame:
    """(rid, linked, root): for each shard the links counted there, and a spanning forest of them."""
    dealt = shards(nodes, math.sqrt(2 - 2 * least), cell)
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > cell)
    sizes = materialise(sizes.select(F.col("cell").alias("c"), "size"))
    lists = dealt.join(sizes, F.col("cell") == F.col("c"), "left_anti").groupBy("cell").applyInPandas(_build, "rid long, cell string, nbrs array<long>")
    lists = lists.union(dealt.join(sizes, F.col("cell") == F.col("c"), "left_semi").select("rid", "cell", F.array().cast("array<long>")))
    united = lists.groupBy("rid").agg(F.collect_list("cell").alias("cells"), F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    ready = materialise(dealt.select("cell", F.col("rid").alias("r"), "vec", "norm", "n").join(united, F.col("r") == F.col("rid")).drop("r"))
    found = ready.join(sizes, F.col("cell") == F.col("c"), "left_anti").groupBy("cell").applyInPandas(_search(least), _FOUND)
    alike = ready.drop("nbrs").join(sizes, F.col("cell") == F.col("c"))
    blocks = F.ceil(F.col("size") / cell)
    alike = alike.withColumn("block", F.pmod(F.xxhash64("rid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    alike = alike.select("cell", "rid", "vec", "norm", "n", "cells", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return materialise(found.union(alike.groupBy("cell", "low", "high").applyInPandas(_compare(least), _FOUND)))


def _audit(nodes: DataFrame, counted: DataFrame, least: float) -> DataFrame:
    """(hits, true): links counted of the audited nodes, and their true ones, each compared with all vectors of its label."""
    some = nodes.filter(F.col("least_id") % AUDIT == 0).orderBy(F.xxhash64("least_id"), "rid").limit(AUDITED)
    picked = materialise(some.select("rid", F.col("label").cast("string").alias("label"), "vec", "norm"))
    by_label = {k: (g["rid"].to_numpy(), _vectors(g)) for k, g in picked.toPandas().groupby("label")}  # AUDITED rows at most

    def count(parts):
        for part in parts:
            for k, rows in part.groupby("label"):
                if k in by_label:
                    ids, q = by_label[k]
                    yield pd.DataFrame({"v": ids, "t": ((q @ _vectors(rows).T >= least) @ rows["n"].to_numpy()).astype(np.int64)})

    true = nodes.select(F.col("label").cast("string").alias("label"), "vec", "norm", "n").mapInPandas(count, "v long, t long").groupBy("v").agg(F.sum("t").alias("t"))
    own = picked.select("rid").join(nodes.select("rid", "n"), "rid").join(counted, F.col("rid") == F.col("f"), "left").join(true, F.col("rid") == F.col("v"))
    links, t = F.coalesce("linked", F.lit(0)), F.col("t") - F.col("n")  # equal vectors aside
    return own.agg(F.coalesce(F.sum(F.least(links, t)), F.lit(0)).alias("hits"), F.coalesce(F.sum(t), F.lit(0)).alias("true"))


def near_vectors(vectors: DataFrame, least: float = 0.98, cell: int = CELL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(one row for each vector: vec_id, n_links, component_id, kept; the audit: hits, true).

    Vectors of one label link at cosine >= `least`, in double precision. Vectors that are null, empty, zero or hold
    null or non-finite numbers, or whose label is null, link with nothing and are their own component. Equal vectors of a
    label are one node, so repeated rows and ids are counted and cost one node. Nodes are dealt to overlapping shards; in each
    a graph is grown by greedy insertion with robust pruning; the adjacency lists that a node has in its shards are
    united; then every row of a shard searches the united graph there, from medoids, and every node in range is expanded. An edge that
    leaves a shard is followed where both its ends are. Each pair is verified in double precision and counted in one shard.
    Shards that no splitting makes smaller are compared in full, block by block. The audit compares vectors whose id is divisible by AUDIT,
    AUDITED of them at most, with all vectors of their label: hits / true is the recall. Links leave a shard as counts and
    as a spanning forest, so a blob of m vectors makes m rows, not m * m. Null ids are never the smallest. Vectors of different
    lengths in one label are an error. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    ship(vectors.sparkSession)
    kind = "array<float>" if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("raw"))
    square = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    fine = F.col("label").isNotNull() & F.col("raw").isNotNull() & F.coalesce(square > 0, F.lit(False)) & F.coalesce(square < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(square), F.lit(True))
    base = base.withColumn("fine", fine)
    nodes = base.filter("fine").groupBy("label", "raw").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.select("label", F.col("raw").alias("vec"), "least_id", "n", F.monotonically_increasing_id().alias("rid"), F.sqrt(square).alias("norm")))
    found = _links(nodes, least, cell)
    parts = connected_components(found.filter("rid <> root").select("rid", "root"))
    counted = materialise(found.groupBy(F.col("rid").alias("f")).agg(F.sum("linked").alias("linked")))
    own = nodes.select("rid", "label", F.col("vec").alias("raw"), "least_id", "n").join(counted, F.col("rid") == F.col("f"), "left")
    own = own.join(parts, F.col("rid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rid"))
    least_of = own.groupBy("part").agg(F.min("least_id").alias("c_id")).withColumnRenamed("part", "p")
    own = own.join(least_of, F.col("part") == F.col("p")).select(F.col("label").alias("l"), F.col("raw").alias("v"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), "c_id")
    both = base.join(own, F.col("fine") & (F.col("label") == F.col("l")) & (F.col("raw") == F.col("v")), "left")
    out = both.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("l").isNotNull(), F.col("c_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), _audit(nodes, counted, least)


def audited(vectors: DataFrame, **options) -> DataFrame:
    """near_vectors()'s rows, once the audit's recall is LEAST_RECALL or more; else an error with its figures."""
    out, audit = near_vectors(vectors, **options)
    hits, true = audit.first()
    if hits < LEAST_RECALL * true:
        raise RuntimeError(f"recall {hits} / {true} is below {LEAST_RECALL}")
    return out


def op7_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "embeddings"))
