"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a size penalty.  Every
vector goes to its nearest centroid and, near a boundary, to the next ones
within ``REPLICATE`` times that distance.  A query walks a neighbour graph of
the centroids in memory and takes the lists within ``ratio`` times its nearest
centroid's distance; the ratio is the least that reaches ``RECALL`` on the
sample.  Queries are dealt to blocks by their nearest lists, in an order in
which lists that are near each other stand together, so the queries of a block
ask for much the same lists, and a list goes only to the blocks that ask for it.
A block meets its lists in shards dealt by hash, so no list, however large, is
one task; vectors stream past in batches and each shard returns a query's best
k only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .embed_dedup import usable

#: About so many vectors a list, up to MANY_LISTS; beyond, lists grow with the square root of the table.
LIST_ROWS, MANY_LISTS = 1000, 4096
#: Centroids and the ratio are fitted on so many rows, or on SAMPLE_PER_LIST a list if that is more, chosen by a hash of their ids.
SAMPLE, SAMPLE_PER_LIST = 16_384, 4
REPLICATE, COPIES = 1.08, 2  # at most one copy beside a vector's first list
QUERY_BLOCK = 4096
#: A block meets the vectors in so many shards, or in one for each SHARD_ROWS rows of the table if that is more.
SHARDS, SHARD_ROWS = 16, 2_000_000
RECALL = 0.97
ROWS_AT_ONCE, CELLS_AT_ONCE = 1024, 4 << 20  # rows, and distances to centroids, that are computed at once
DEGREE = 24


def lists_for(total: int) -> int:
    """Number of lists of a table of so many vectors."""
    most = MANY_LISTS * LIST_ROWS
    return max(1, total // LIST_ROWS) if total <= most else int(MANY_LISTS * (total / most) ** 0.5)


def _chunks(n: int, k: int) -> list[slice]:
    step = max(1, min(ROWS_AT_ONCE * 16, CELLS_AT_ONCE // max(1, k)))
    return [slice(i, i + step) for i in range(0, n, step)]


def _fit_centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means by squared distance plus a penalty on lists above the mean size."""
    c, mean = x[np.linspace(0, len(x) - 1, k).astype(int)].copy(), len(x) / k
    penalty = np.zeros(k)
    for _ in range(rounds):
        near, least = np.zeros(len(x), "int64"), np.zeros(len(x))
        norm = (c * c).sum(1)
        for part in _chunks(len(x), k):
            d = norm - 2 * x[part] @ c.T
            near[part], least[part] = (d + penalty).argmin(1), d.min(1)
        size = np.bincount(near, minlength=k)
        penalty += 0.05 * np.abs(least).mean() * np.clip(size / mean - 1, -1, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _line_up(c: np.ndarray) -> np.ndarray:
    """Position of each centroid in an order by repeated halving along the widest axis: near ones stand together."""
    place, at, stack = np.zeros(len(c), "int64"), 0, [np.arange(len(c))]
    while stack:
        ids = stack.pop()
        if len(ids) <= 1:
            place[ids], at = at, at + len(ids)
            continue
        own = c[ids]
        ids = ids[np.argsort(own[:, int(own.var(0).argmax())], kind="stable")]
        stack += [ids[len(ids) // 2 :], ids[: len(ids) // 2]]
    return place


class Graph:
    """Neighbour graph over the centroids; walks expand every node within the bound."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.norm = (centroids * centroids).sum(1)
        k = len(centroids)
        own, near = [], []
        for part in _chunks(k, k):
            d = self.norm[None, :] - 2 * centroids[part] @ centroids.T
            few = min(k, DEGREE + 1)
            hit = np.argpartition(d, few - 1, 1)[:, :few]
            own.append(np.repeat(np.arange(k)[part], few))
            near.append(hit.ravel())
        ring = np.arange(k)  # keeps the graph connected
        a, b = np.concatenate([*own, ring]), np.concatenate([*near, (ring + 1) % k])
        links = np.unique(np.concatenate((a * k + b, b * k + a)))
        self.to, self.ptr = links % k, np.searchsorted(links // k, np.arange(k + 1))
        self.entry = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))

    def _beside(self, grown: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Nodes not seen yet that are linked with the grown ones, by row."""
        r, c = np.nonzero(grown)
        n = self.ptr[c + 1] - self.ptr[c]
        first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
        out = np.zeros(seen.shape, bool)
        out[np.repeat(r, n), self.to[np.repeat(self.ptr[c] - first, n) + np.arange(n.sum())]] = True
        return out & ~seen

    def distances(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids a walk visits; infinite to the others."""
        d = np.full((len(x), len(self.c)), np.inf)
        new, done = np.zeros(d.shape, bool), np.zeros(d.shape, bool)
        new[:, self.entry] = True
        xx = (x * x).sum(1)
        while new.any():
            j = np.flatnonzero(new.any(0))
            reached = np.sqrt(np.maximum(0, xx[:, None] + self.norm[j] - 2 * x @ self.c[j].T))
            d[:, j] = np.where(new[:, j], reached, d[:, j])
            seen = np.isfinite(d)
            best = d.min(1, keepdims=True)
            grow = seen & ~done & ((d <= ratio * best) | (d == np.where(seen & ~done, d, np.inf).min(1, keepdims=True)) & ~done.any(1, keepdims=True) | (d == best))
            done |= grow
            new = self._beside(grow, seen)
        return d


def _lists(graph: Graph, x: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists within ``ratio`` of the nearest, nearest first, at most ``most`` a row."""
    step = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // len(graph.c)))
    if len(x) > step:
        parts = [_lists(graph, x[i : i + step], ratio, most) for i in range(0, len(x), step)]
        return np.concatenate([r + i * step for i, (r, _) in enumerate(parts)]), np.concatenate([c for _, c in parts])
    d = graph.distances(x, ratio)
    order = np.argsort(d, 1)[:, :most]
    own = np.take_along_axis(d, order, 1)
    ok = own <= np.maximum(ratio * own[:, :1], own[:, :1])
    r, c = np.nonzero(ok)
    return r, order[r, c]


def _fit_ratio(graph: Graph, x: np.ndarray, k: int) -> float:
    """The least ratio with which the sample's own queries reach RECALL."""
    q = x[:: max(1, len(x) // 256)][:256]
    at = np.arange(0, len(x), max(1, len(x) // 256))[:256]
    s = q @ x.T
    s[np.arange(len(q)), at] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    true = np.argpartition(-s, k - 1, 1)[:, :k]
    member = np.zeros((len(x), len(graph.c)), bool)
    member[_lists(graph, x, REPLICATE, COPIES)] = True
    full = graph.distances(q, np.inf)
    least = full / full.min(1, keepdims=True).clip(1e-12)
    need = np.sort(np.where(member[true], least[:, None, :], np.inf).min(2).ravel())
    return float(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) * 1.0001


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` (a condition on ``node``) marks.

    Candidates are all other rows; ``score`` is the inner product in double
    precision, ties go to the smaller id.  Null, zero and non-finite vectors
    and those of another length than the commonest take no part; rows that
    repeat an id count once, with their best score.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors).select("node", "v"), "vectors")
    sizes = rows.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    rows, total = rows.where(F.size("v") == sizes[0]["s"]), sizes[0]["n"]
    n_lists = lists_for(total)
    sample = rows.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, SAMPLE_PER_LIST * n_lists)).select("v")
    x = np.stack([np.asarray(v, "float64") for v in sample.toPandas()["v"]])
    n_lists = min(n_lists, len(x))
    graph = Graph(_fit_centroids(x, n_lists))
    ratio = _fit_ratio(graph, x, k)
    shared = spark.sparkContext.broadcast(graph)

    def deal(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                own = pdf[at : at + ROWS_AT_ONCE]
                r, c = _lists(shared.value, np.stack([np.asarray(v, "float64") for v in own["v"]]), REPLICATE, COPIES)
                again = np.concatenate(([False], r[1:] == r[:-1]))
                first = np.where(again, np.concatenate(([-1], c[:-1])), -1)
                yield pd.DataFrame({"list": c.astype("int32"), "first": first.astype("int32"), "node": own["node"].to_numpy()[r], "v": own["v"].to_numpy()[r]})

    def ask(batches):
        for pdf in batches:
            if len(pdf):
                r, c = _lists(shared.value, np.stack([np.asarray(v, "float64") for v in pdf["v"]]), ratio, n_lists)
                yield pdf.assign(lists=np.split(c.astype("int32"), np.searchsorted(r, np.arange(1, len(pdf)))))

    posted = rows.mapInPandas(deal, "list int, first int, node long, v array<double>")
    asked = cut(rows.where(is_query).mapInPandas(ask, "node long, v array<double>, lists array<int>"), "asked")
    # blocks: the queries by their nearest list, in the order of the lists; a list with many queries has blocks of its own
    home = asked.groupBy(F.col("lists")[0].alias("list")).agg(F.count("*").alias("n")).collect()  # a row per list
    place, blocks, at, room = _line_up(graph.c), [], 0, QUERY_BLOCK
    for r in sorted(home, key=lambda r: int(place[r["list"]])):
        if r["n"] > room and room < QUERY_BLOCK:
            at, room = at + 1, QUERY_BLOCK
        parts = -(-r["n"] // QUERY_BLOCK)
        blocks.append((r["list"], at, parts))
        at, room = (at, room - r["n"]) if parts == 1 else (at + parts, QUERY_BLOCK)
    homes = F.broadcast(spark.createDataFrame(blocks, "home int, at int, parts int"))  # a row per list
    block = (F.col("at") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    asked = asked.join(homes, F.col("lists")[0] == F.col("home")).select(block.alias("block"), "node", "v", "lists")
    shards = max(SHARDS, total // SHARD_ROWS)
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    right = asked.select("block", every_shard, F.lit(-1).alias("list"), "lists", F.lit(-1).alias("first"), "node", "v")
    # lists and shards meet the blocks that ask for them; the shard splits a hot list
    probing = asked.select("block", F.explode("lists").alias("list")).distinct().select("list", "block", every_shard)
    left = posted.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).join(probing, ["list", "shard"])
    left = left.select("block", "shard", "list", F.lit(None).cast("array<int>").alias("lists"), "first", "node", "v")
    # queries (list -1) come first in their group, then the vectors by list: one pass, a batch at a time
    sorted_ = right.unionByName(left).repartition("block", "shard").sortWithinPartitions("block", "shard", "list", "node")

    def best(batches):
        walk = None
        for pdf in batches:
            for (block, shard), group in pdf.groupby(["block", "shard"], sort=False):
                if walk is None or walk.key != (block, shard):
                    if walk is not None:
                        yield from walk.result()
                    walk = _Block((block, shard), k, n_lists)
                walk.add(group)
        if walk is not None:
            yield from walk.result()

    found = sorted_.mapInPandas(best, "query_id long, vec_id long, score double")
    # k rows from each shard of a query meet here, whatever the size of the table
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """One block of queries while the vectors of a shard pass by; keeps each query's best k."""

    def __init__(self, key: tuple, k: int, n_lists: int):
        self.key, self.k, self.n_lists = key, k, n_lists
        self.ids, self.vectors, self.lists = [], [], []
        self.probes = None

    def add(self, group: pd.DataFrame) -> None:
        asks = group["list"].to_numpy() < 0
        if asks.any():
            self.ids += group["node"][asks].tolist()
            self.vectors += list(group["v"][asks])
            self.lists += list(group["lists"][asks])
        if asks.all():
            return
        if self.probes is None:
            self._seal()
        rest = group[~asks]
        for c, own in rest.groupby("list", sort=False):
            sel = np.flatnonzero(self.probes[:, c])
            if len(sel):
                self._meet(sel, own)

    def _seal(self) -> None:
        n = len(self.ids)
        self.probes = np.zeros((n, self.n_lists), bool)
        for i, lists in enumerate(self.lists):
            self.probes[i, np.asarray(lists, "int64")] = True
        self.q = np.stack([np.asarray(v, "float64") for v in self.vectors]) if n else np.zeros((0, 1))
        self.query = np.asarray(self.ids, "int64")
        self.score = np.full((n, self.k), -np.inf)
        self.hit = np.full((n, self.k), np.iinfo("int64").max)

    def _meet(self, sel: np.ndarray, own: pd.DataFrame) -> None:
        ids, first = own["node"].to_numpy(), own["first"].to_numpy()
        s = self.q[sel] @ np.stack([np.asarray(v, "float64") for v in own["v"]]).T
        s[self.query[sel][:, None] == ids[None, :]] = -np.inf
        # a boundary copy counts only for queries that do not see the vector in its first list
        copy = first >= 0
        if copy.any():
            s[:, copy] = np.where(self.probes[sel][:, first[copy]], -np.inf, s[:, copy])
        score = np.concatenate((self.score[sel], s), 1)
        hit = np.concatenate((self.hit[sel], np.broadcast_to(ids, s.shape)), 1)
        order = np.lexsort((hit, -score), axis=1)[:, : self.k]
        self.score[sel] = np.take_along_axis(score, order, 1)
        self.hit[sel] = np.take_along_axis(hit, order, 1)

    def result(self):
        if self.probes is not None:
            r, c = np.nonzero(self.score > -np.inf)
            yield pd.DataFrame({"query_id": self.query[r], "vec_id": self.hit[r, c], "score": self.score[r, c]})
