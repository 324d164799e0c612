"""Near-duplicate vectors by a pivot-permutation index.

Coarse pivots, whose number follows the table, divide the vectors into cells of
bounded size, each vector in its nearest two; within its cells a vector is
described by its nearest pivots, whose number follows the cell.  So the lists
stay short however large the table is: an inverted list holds the vectors of one
label that name one pivot.  Vectors that share at least
``SHARED`` pivots are candidates and are verified by cosine in double
precision.  Lists are dealt in blocks of bounded size, and every pair of blocks
is one task unit that returns link counts and a spanning forest of its links,
never the pairs; a pair that shares several pivots is counted at the first.
Equal vectors collapse into one class ahead of everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

NAMED, SHARED = 8, 2  # pivots that describe a vector; pivots that candidates share
BLOCK = 256  # about so many rows of a list in one block
#: A cell holds about so many rows, and a vector lies in so many cells.
CELL_ROWS, CELLS = 400_000, 2
#: Pivots of a cell are drawn by hash; their number follows the cell within these bounds.
LEAST_PIVOTS, MOST_PIVOTS, ROWS_A_PIVOT = 64, 4096, 200
#: So many rows are drawn for each pivot, and pivots have a cosine below SPREAD with each other.
DRAWN, SPREAD = 4, 0.8
#: Rows of a cell that one task names at a time.
SHARD_ROWS = 20_000


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``node, v array<double>`` of vectors that are not null or zero and hold only finite components."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("node"), v.alias("v"), *[c for c in vectors.columns if c == "label"])
    finite = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("node").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, "float64") for r in rows])
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows in order, none within SPREAD of an earlier one: a dense group gives one pivot, not many alike."""
    chosen = np.zeros((min(n, len(x)), x.shape[1]))
    k = 0
    for row in x:
        if k < len(chosen) and (k == 0 or (chosen[:k] @ row).max() < SPREAD):
            chosen[k] = row
            k += 1
    return chosen[:k]


def _pivots(rows, n: int) -> dict[int, np.ndarray]:
    """Up to n pivots for each length of vector."""
    by_size: dict[int, list] = {}
    for v in rows:
        by_size.setdefault(len(v), []).append(v)
    return {size: _spread(_unit(own), n) for size, own in by_size.items()}


def _in_cells(classes: DataFrame, total: int) -> DataFrame:
    """``cls, cell, v``: each vector in its nearest cells."""
    n_cells = -(-total // CELL_ROWS)
    # a few rows a cell; the last cell is that of lengths without a pivot
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(DRAWN * n_cells).collect() if n_cells > 1 else []
    shared = classes.sparkSession.sparkContext.broadcast(_pivots([r["v"] for r in sample], n_cells))

    def run(batches):
        for pdf in batches:
            cells = []
            for v in pdf["v"]:
                p = shared.value.get(len(v))
                cells.append(np.full(1, n_cells) if p is None else np.argsort(-(p @ _unit([v])[0]), kind="stable")[:CELLS])
            yield pdf.assign(cell=cells).explode("cell").astype({"cell": "int64"})

    return classes.select("cls", "v").mapInPandas(run, "cls string, v array<double>, cell long")


def _named(classes: DataFrame, total: int) -> DataFrame:
    """``cls, named``: the pivots nearest to each vector in its cells, numbered over all cells.

    A cell's vectors are dealt in shards; its pivots go to each shard ahead of them.
    """
    rows = cut(_in_cells(classes, total), "cells")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("rows"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(LEAST_PIVOTS), (F.col("rows") / ROWS_A_PIVOT).cast("int")))
    cells = cut(sizes.select("cell", wanted.alias("pivots"), F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("shards"), (wanted * DRAWN / F.col("rows")).alias("share")), "sizes")
    by_cell = rows.join(F.broadcast(cells), "cell")  # a row per CELL_ROWS rows of the table
    drawn = by_cell.where(F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 20)) / float(1 << 20) < F.col("share"))

    def spread(key, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("cls")
        found = _pivots(list(order["v"]), int(pdf["pivots"].iloc[0]))
        vectors = [list(v) for size in sorted(found) for v in found[size]]
        return pd.DataFrame({"cell": key[0], "k": np.arange(len(vectors), dtype="int64"), "v": vectors})

    # about DRAWN * MOST_PIVOTS rows a cell, whatever its size
    pivots = drawn.select("cell", "cls", "v", "pivots").groupBy("cell").applyInPandas(spread, "cell long, k long, v array<double>")
    ahead = pivots.join(F.broadcast(cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "k", F.lit(None).cast("string").alias("cls"), "v")
    after = by_cell.select("cell", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int").alias("shard"), F.lit(1 << 40).alias("k"), "cls", "v")
    met = ahead.unionByName(after).repartition("cell", "shard").sortWithinPartitions("cell", "shard", "k")

    def name(batches):
        key, gathered, ready = None, [], {}
        for pdf in batches:
            for at, group in pdf.groupby(["cell", "shard"], sort=False):
                if at != key:
                    key, gathered, ready = at, [], None
                is_pivot = group["cls"].isna().to_numpy()
                gathered += [(int(k), np.asarray(v, "float64")) for k, v in zip(group["k"][is_pivot], group["v"][is_pivot])]
                own = group[~is_pivot]
                if not len(own):
                    continue
                if ready is None:
                    ready = {}
                    for size in {len(v) for _, v in gathered}:
                        chosen = [(k, v) for k, v in gathered if len(v) == size]
                        ready[size] = (np.asarray([k for k, _ in chosen], "int64"), np.stack([v for _, v in chosen]))
                base, out = int(at[0]) * (2 * MOST_PIVOTS * DRAWN), []
                for v in own["v"]:
                    ids, p = ready.get(len(v), (np.zeros(1, "int64"), None))
                    out.append(base + (ids if p is None else np.sort(ids[np.argsort(-(p @ _unit([v])[0]), kind="stable")[:NAMED]])))
                yield pd.DataFrame({"cls": own["cls"], "named": out})

    names = met.mapInPandas(name, "cls string, named array<long>")
    return names.groupBy("cls").agg(F.sort_array(F.flatten(F.collect_list("named"))).alias("named"))  # CELLS rows a vector


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of a spanning forest of the links (a, b) among n nodes."""
    parent, kept = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            kept.append(i)
    return kept


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows link if their labels are equal and not null and their cosine is at
    least ``least``; vectors of other lengths never link.  Null, zero and
    non-finite vectors have no links and their own id as component.  Rows that
    repeat an id are vectors of their own; equal vectors link with each other.
    """
    rows = usable(vectors).where("label is not null").withColumn("label", F.col("label").cast("string"))
    # equal vectors, -0.0 as 0.0, are one class with a multiplicity; their cosine is 1
    canon = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    classes = rows.groupBy("label", canon.alias("v")).agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cls", F.sha2(F.concat_ws("|", "label", F.col("v").cast("string")), 256)), "vectors")
    named = cut(classes.join(_named(classes, classes.count()), "cls"), "named")
    listed = named.withColumn("pivot", F.explode("named"))
    blocks = listed.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = listed.join(blocks, ["label", "pivot"]).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("label", "pivot", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "cls", "rep", "n", "v", "named")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, pivot, lo, hi = key
        parts = []
        for size, group in pdf.groupby(pdf["v"].map(len)):
            x, sets = _unit(group["v"]), list(group["named"])
            few = min(NAMED, min(map(len, sets)))
            ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
            member = np.zeros((len(group), len(ids)), "float32")
            member[np.repeat(np.arange(len(group)), [len(s) for s in sets]), flat] = 1
            ok = (x @ x.T >= least) & (member @ member.T >= min(SHARED, few))
            before = member[:, ids < pivot]
            ok &= before @ before.T == 0
            block = group["i"].to_numpy()
            if lo != hi:
                ok &= block[:, None] != block[None, :]
            np.fill_diagonal(ok, False)
            n, rep = group["n"].to_numpy(), group["rep"].to_numpy()
            count = ok @ n
            hit = np.flatnonzero(count)
            a, b = np.nonzero(np.triu(ok))
            keep = _forest(a, b, len(group))
            parts.append(pd.DataFrame({"cls": group["cls"].to_numpy()[hit], "links": count[hit], "a": -1, "b": -1}))
            parts.append(pd.DataFrame({"cls": None, "links": 0, "a": rep[a[keep]], "b": rep[b[keep]]}))
        return pd.concat(parts, ignore_index=True).astype({"links": "int64", "a": "int64", "b": "int64"})

    found = cut(pairs.groupBy("label", "pivot", "lo", "hi").applyInPandas(compare, "cls string, links long, a long, b long"), "found")
    links = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("cls is null").select("a", "b").distinct())
    told = classes.join(links, "cls", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    told = told.where("n_links > 0")
    every = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("_l"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("_e"))
    out = every.join(told, (F.col("_l") == F.col("_label")) & (F.col("_e") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
