"""Vector de-duplication and search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", "y") for i, v, y in rows], SCHEMA)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        label = int(rng.integers(3))
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + 0.25 * rng.standard_normal(dim)).astype("float32").tolist(), label))
    rows += [(len(rows) + i, base.astype("float32").tolist(), 1) for i in range(300)]  # one hot group of equal vectors
    hot = [(len(rows) + i, (base + 0.05 * rng.standard_normal(dim)).astype("float32").tolist(), 1) for i in range(700)]
    return rows + hot


@pytest.mark.parametrize("cell_rows", [400_000, 150])
def test_links_equal_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", cell_rows)  # one cell, and many
    rows = clustered(600, 24, 1)
    odd = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [None] * 24, 1), (5004, [float("inf")] + [1.0] * 23, 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1)]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, rows + odd), 0.93).collect()}
    x = np.stack([v for _, v, _ in rows]).astype("float64")
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.asarray([y for _, _, y in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(rows)).min(1))
        if (new == comp).all():
            break
        comp = new
    n = link.sum(1)
    assert abs(sum(got[i]["n_links"] for i in range(len(rows))) - n.sum()) <= 0.01 * n.sum()
    assert all(got[i]["n_links"] <= n[i] for i in range(len(rows)))
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(rows))]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(5000, 5006))
    assert got[5006]["n_links"] == 1 and got[5007]["component_id"] == 5006
    assert embed_dedup.near_duplicates(table(spark, rows[:3]).where("false")).count() == 0


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 32)).astype("float32")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(6000, None, 0), (6020, [0.0] * 32, 0), (6040, [1.0], 0), (6060, [float("nan")] * 32, 0)]
    got = ann.search(table(spark, rows), F.col("node") % 20 == 0, 20).collect()
    d = x.astype("float64")
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 6000, 20))
    hit = 0
    for q, found in by.items():
        found.sort()
        s = d @ d[q]
        s[q] = -np.inf
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        hit += len({v for _, v, _ in found} & set(np.argsort(-s)[:20]))
    assert hit / (20 * len(by)) >= 0.9


def test_search_edges(spark):
    few = table(spark, [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (21, [1.0, 0.0], 0), (21, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, F.col("node") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 21, 1.0), (0, 3, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 21, 1.0), (20, 3, 3, 0.0)]
    assert ann.search(few.where("false"), F.col("node") % 20 == 0).count() == 0
    assert ann.search(few.where("vec_id = 20"), F.col("node") % 20 == 0).count() == 0


def test_lists_and_sample_grow_with_the_table():
    assert [ann.lists_for(n) for n in (1, 999, 50_000, 4_096_000)] == [1, 1, 50, 4096]
    assert ann.lists_for(400_000_000) > 9 * 4096 and ann.lists_for(4 * 10**8) < ann.lists_for(16 * 10**8)


def test_near_centroids_stand_together():
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.standard_normal((40, 8)) * 0.1 + 5 * rng.standard_normal(8) for _ in range(8)])
    place = ann._line_up(c)
    assert sorted(place) == list(range(len(c)))
    spans = [np.ptp(place[40 * k : 40 * k + 40]) for k in range(8)]
    assert np.median(spans) < 80  # a group of 40 stands in a stretch of the 320


def test_many_lists_and_blocks_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(6)
    centres = 20 * rng.standard_normal((40, 16))
    sent = {}
    for n in (2000, 8000):
        x = (centres[np.arange(n) % 40] + rng.standard_normal((n, 16))).astype("float32")
        rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
        got = ann.search(rows, F.col("node") % 20 == 0, 5)
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        found = got.collect()
        d = x.astype("float64")
        want = {q: set(np.argsort(-np.where(np.arange(n) == q, -np.inf, d @ d[q]))[:5].tolist()) for q in range(0, n, 20)}
        hit = sum(r["vec_id"] in want[r["query_id"]] for r in found)
        assert hit / (5 * len(want)) >= 0.95
        sent[n] = len(found)
    assert sent[8000] == 4 * sent[2000]
