"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same shingle set collapse into one class first, so copies
cost one row of aggregation each; a class is a node of its own, whatever ids its
documents bear.  Every class signature is laid out in several
orders (trees), each order is sorted as a whole by a range partitioning, and a
class meets the neighbours that share its longest common prefix: at least
``PREFIX`` hashes, and as many more as its region is dense.  Where sorted
partitions meet, their border rows are compared once more.

Candidates pass an estimate on the whole signature, set six deviations below
the threshold, and are then confirmed on full shingle sets: first the two best
of every class, then each remaining candidate whose ends are still in different
components, which leaves the components as if all had been confirmed.  Regions
with more rows than a neighbourhood are then gone through once more: whatever
is still apart in them meets by blocks, so no link hides behind nearer rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, unused
from .components import components

TREES, PREFIX, DEPTH = 20, 4, 12  # orders; hashes that candidates share at least; hashes that are sorted by
HASHES = TREES * PREFIX
NEIGHBOURS = 4
#: Estimates this far below the threshold are dropped: over five standard errors of HASHES hashes.
MARGIN = 0.25
#: Ids up to this count are broadcast to pick or drop texts; more are joined by shuffle.
BROADCAST_IDS = 250_000
WORDS_KEPT = 120_000
_RNG = np.random.default_rng(20_240_501)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype="uint64") * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype="uint64")
#: Rows and bytes of sets of a dense region in one block, about; its estimates reach so far below the threshold (four standard errors).
BLOCK, BLOCK_BYTES, DENSE_MARGIN = 512, 8 << 20, 0.17
PAIR, DENSE, BORDER = 0, 1, 2
KEYS = "tree int, k1 long, k2 long, k3 long, node long"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of ``text``.

    A-Z are lower-cased, words lie between ASCII white space; with fewer than n
    words the whole sequence is one shingle, without words there is none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(words.__getitem__, parts), "uint64", len(parts))
    size = min(n, len(parts))
    acc = np.full(len(h) - size + 1, size, "uint64")
    for i in range(size):
        acc = _mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - size + 1 + i])
    return np.unique(acc)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES 16-bit MinHashes of a set."""
    out = np.full(HASHES, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=out)
    return (_mix(out) >> np.uint64(48)).astype("<u2")


def text_key(text: Column) -> Column:
    """What tells the texts of one id apart; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, th, n_shingles, fp, sig`` of each row; ``th`` is the text's key, ``fp`` and ``sig`` are null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles(text if isinstance(text, str) else None, n, words)
                rows.append((len(s), blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()) if len(s) else (0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "fp", "sig"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            out.insert(1, "th", pdf["th"].array)
            yield out

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("th"))
    return texts.mapInPandas(run, "doc_id long, th binary, n_shingles long, fp binary, sig binary")


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every signature once a tree: DEPTH of its hashes from hash PREFIX * tree on, around the end."""
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), HASHES).astype("uint64")
        node = pdf["node"].to_numpy()
        for tree in range(TREES):
            own = sig[:, (np.arange(DEPTH) + PREFIX * tree) % HASHES]
            k = [(own[:, i] << np.uint64(48) | own[:, i + 1] << np.uint64(32) | own[:, i + 2] << np.uint64(16) | own[:, i + 3]).view("int64") for i in (0, 4, 8)]
            yield pd.DataFrame({"tree": np.full(len(node), tree, "int32"), "k1": k[0], "k2": k[1], "k3": k[2], "node": node})


def _near(batches: Iterator[pd.DataFrame], borders: bool = True) -> Iterator[pd.DataFrame]:
    """What the sorted rows show, by ``kind``: PAIR of rows at most NEIGHBOURS apart that share the
    prefix, DENSE key of a region with more rows than that, and with ``borders`` the outer rows."""
    reach = NEIGHBOURS + 1
    tail, first, seen = None, True, False

    def told(kind: int, tree, k1, **more) -> pd.DataFrame:
        zero = np.zeros(len(k1), "int64")
        out = pd.DataFrame({"tree": tree, "k1": k1, **{c: more.get(c, zero) for c in ("k2", "k3", "node", "a", "b")}, "kind": np.full(len(k1), kind, "int32")})
        return out.astype({"tree": "int32"})

    def edge(r: pd.DataFrame) -> pd.DataFrame:
        return told(BORDER, r["tree"].to_numpy(), r["k1"].to_numpy(), k2=r["k2"].to_numpy(), k3=r["k3"].to_numpy(), node=r["node"].to_numpy())

    for pdf in batches:
        if not len(pdf):
            continue
        seen = True
        rows = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if borders and first and len(rows) >= reach:
            yield edge(rows[:reach])
            first = False
        tree, k1, node = rows["tree"].to_numpy(), rows["k1"].to_numpy(), rows["node"].to_numpy()
        old, found = len(rows) - len(pdf), []
        for d in range(1, reach + 1):
            i = np.flatnonzero((tree[d:] == tree[:-d]) & (k1[d:] == k1[:-d]) & (node[d:] != node[:-d]))
            i = i[i + d >= old]
            if d <= NEIGHBOURS:
                found.append((np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])))
            elif len(i):
                keys = pd.DataFrame({"tree": tree[i], "k1": k1[i]}).drop_duplicates()
                yield told(DENSE, keys["tree"].to_numpy(), keys["k1"].to_numpy())
        a, b = (np.concatenate(x) for x in zip(*found))
        yield told(PAIR, np.zeros(len(a), "int32"), np.zeros(len(a), "int64"), a=a, b=b)
        tail = rows[-reach:]
    if borders and seen:
        yield edge(tail)


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of neighbouring nodes over all trees, and ``tree, k1`` of dense regions."""
    order, out = ["tree", "k1", "k2", "k3", "node"], KEYS + ", a long, b long, kind int"
    n = max(1, partitions(nodes.sparkSession))
    rows = nodes.where("sig is not null").select("node", "sig").mapInPandas(_orders, KEYS)
    found = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_near, out), "near")
    # a few rows of each partition: those next to its two ends
    edges = found.where(F.col("kind") == BORDER).select(*order).distinct().repartition(1).sortWithinPartitions(*order)
    every = found.unionByName(edges.mapInPandas(functools.partial(_near, borders=False), out))
    return every.where(F.col("kind") == PAIR).select("a", "b").distinct(), cut(every.where(F.col("kind") == DENSE).select("tree", "k1").distinct(), "dense")


def members(nodes: DataFrame, dense: DataFrame) -> DataFrame:
    """``tree, k1, node`` of the rows in dense regions."""
    rows = nodes.where("sig is not null").select("node", "sig").mapInPandas(_orders, KEYS).select("tree", "k1", "node")
    return rows.join(F.broadcast(dense) if dense.count() <= BROADCAST_IDS else dense, ["tree", "k1"])


def _apart(inside: DataFrame, nodes: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in dense regions between different components, ``a, b``, confirmed on full sets.

    Neighbours alone do not exhaust a dense region.  A region's rows outside
    its commonest component meet all others, in pairs of blocks of bounded
    size; rows of the commonest component never meet each other.  The sets come
    along, so a pair of blocks returns the links that join components and no
    other pair; a pair that shares several prefixes is looked at in the first.
    """
    least = (percent / 100 - DENSE_MARGIN) * HASHES
    known = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "sig")
    sized = known.select("node", "label").join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    rows = inside.join(sized, "node")
    each = rows.groupBy("tree", "k1", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    stats = each.groupBy("tree", "k1").agg(F.max(F.struct("n", "bytes", "label")).alias("m"), F.sum("n").alias("all"), F.sum("bytes").alias("of_all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c, size: F.ceil(F.greatest(c / BLOCK, size / BLOCK_BYTES)).cast("int")
    stats = stats.select("tree", "k1", F.col("m.label").alias("common"), blocks(F.col("all") - F.col("m.n"), F.col("of_all") - F.col("m.bytes")).alias("bo"), blocks(F.col("m.n"), F.col("m.bytes")).alias("bd"))
    dealt = rows.join(cut(stats, "regions"), ["tree", "k1"]).join(known.select("node", "sig"), "node").join(sets, "node")
    other = F.col("label") != F.col("common")
    h = F.xxhash64("node")
    dealt = dealt.withColumn("i", F.when(other, F.pmod(h, F.col("bo"))).otherwise(F.col("bo") + F.pmod(h, F.col("bd"))).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(other, F.col("bo") + F.col("bd") - 1).otherwise(F.col("bo") - 1))))
    dealt = dealt.select("tree", "k1", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "label", "sig", "set")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), HASHES)
        node, label, block = pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["i"].to_numpy()
        x, y = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        same = np.zeros((len(x), len(y)), "uint8")
        for c in sig.T:
            same += c[x, None] == c[None, y]
        own = [np.frombuffer(b, "uint64") for b in pdf["set"]]
        size = np.asarray([len(b) for b in own], "int64")
        ok = (same >= least) & (label[x, None] != label[None, y])
        ok &= 100 * np.minimum(size[x, None], size[None, y]) >= percent * np.maximum(size[x, None], size[None, y])
        if key[2] == key[3]:
            ok &= node[x, None] < node[None, y]
        a, b = np.nonzero(ok)
        agree, a, b = same[a, b], x[a], y[b]
        prefix = np.ascontiguousarray(sig).view("uint64")  # PREFIX hashes of 16 bits: one word a tree
        new = ~(prefix[a, : key[0]] == prefix[b, : key[0]]).any(1)
        a, b, agree = a[new], b[new], agree[new]
        order = np.argsort(-agree.astype("int16"), kind="stable")
        parent, links = {}, []

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for i, j in zip(a[order].tolist(), b[order].tolist()):
            p, q = root(label[i]), root(label[j])
            if p != q:
                inter = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if 100 * inter >= percent * (size[i] + size[j] - inter):
                    parent[max(p, q)] = min(p, q)
                    links.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("tree", "k1", "lo", "hi").applyInPandas(meet, "a long, b long").distinct()


def _estimate(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a, b, est`` of the pairs whose signatures agree in at least ``least`` of the hashes."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "_sa"), "a").join(sig.toDF("b", "_sb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), HASHES) for c in ("_sa", "_sb"))
                est = (x == y).mean(1)
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "est": est})[est >= least]

    return both.select("a", "b", "_sa", "_sb").mapInPandas(run, "a long, b long, est double")


def _sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``node, set`` of the given classes, from the texts that stand for them."""
    reps = classes.select("node", F.col("rep_id").alias("_id"), F.col("rep_th").alias("_th"))
    chosen = F.broadcast(reps) if classes.count() <= BROADCAST_IDS else reps
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("th"))
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            sets = [shingles(t if isinstance(t, str) else None, n, words).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "set": sets})

    return texts.mapInPandas(run, "node long, set binary").groupBy("node").agg(F.min("set").alias("set"))  # repeated rows give one set again


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.select("a", "b").join(sets.toDF("a", "_sa"), "a").join(sets.toDF("b", "_sb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["_sa"], pdf["_sb"])):
                p, q = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    inter = len(np.intersect1d(p, q, assume_unique=True))
                    ok[i] = 100 * inter >= percent * (len(p) + len(q) - inter)
            yield pdf.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    label = lambda c: comp.toDF(c, f"_{c}")
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """``node, component`` after further links, by components of the contracted graph."""
    if more.isEmpty():
        return comp
    label = lambda c: comp.toDF(c, f"_{c}")
    contracted = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = components(contracted).toDF("component", "_to")
    every = comp.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("component")))
    return cut(every.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "comp")


def _classes(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``fp, node, rep_id, rep_th, sig, n`` of each set, and the node number of an ``fp``.

    The row that stands for a class has its smallest id, a null id last.  Node
    numbers are 64-bit hashes, salted until no two classes share one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "th")).alias("r")
    found = rows.where("fp is not null").groupBy("fp").agg(first, F.min("sig").alias("sig"), F.count("*").alias("n"))
    found = cut(found.select("fp", F.col("r.doc_id").alias("rep_id"), F.col("r.th").alias("rep_th"), "sig", "n"), "classes")
    salt = 0
    while True:
        node = F.xxhash64(F.lit(salt), F.col("fp"))
        numbered = found.withColumn("node", node)
        if numbered.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return numbered, node
        salt += 1


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, Column, DataFrame]:
    """The sketched rows, their classes and node numbers, and ``node, component`` of the classes that are linked."""
    rows = cut(sketch(docs, n), "sketch")
    classes, node = _classes(rows)
    nodes = classes.select("node", "sig")
    near, dense = candidates(nodes)
    pairs = cut(_estimate(near, nodes, percent / 100 - MARGIN), "pairs")
    inside = cut(members(nodes, dense), "members")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "est")
    best = Window.partitionBy("node").orderBy(F.desc("est"), "a", "b")  # at most 2 * NEIGHBOURS * TREES rows a node
    top = ends.withColumn("_r", F.row_number().over(best)).where("_r <= 2").select("a", "b").distinct()
    involved = ends.select("node").unionByName(inside.select("node")).distinct()
    sets = cut(_sets(docs, cut(classes.select("node", "rep_id", "rep_th").join(involved, "node", "left_semi"), "involved"), n), "sets")
    comp = components(cut(_confirm(top, sets, percent), "links"))
    rest = _between(pairs.select("a", "b"), comp)
    comp = _joined(comp, cut(_confirm(rest, sets, percent), "links"))
    comp = _joined(comp, cut(_apart(inside, nodes, comp, sets, percent), "links"))
    return rows, classes, node, comp


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the smallest id reachable and ``kept``
    marks the document that bears it.  Null, empty and blank texts have no
    shingles and are linked with nothing.  Rows that repeat an id are one
    document: all links of its texts are its own, and its rows are kept or
    dropped alike.  Rows with a null id are linked by their texts, have a null
    component if no id is reachable, and are never kept.
    """
    rows, classes, node, comp = _linked(docs, n, percent)
    named = rows.where("fp is not null and doc_id is not null").select("doc_id", node.alias("node"))
    several = cut(named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a"), "several")
    if not several.isEmpty():  # an id with more than one text ties their classes
        comp = _joined(comp, named.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    label = classes.select("fp", "node", "rep_id", "n").join(comp, "node", "left")
    least = label.where("component is not null").groupBy("component").agg(F.min("rep_id").alias("_least"))
    of = label.where("n > 1 or component is not null").join(least, "component", "left").select("fp", F.coalesce("_least", "rep_id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "fp").join(of, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies; all rows without words stay.

    Rows are told apart by id and text, so an id that holds two texts may keep
    both.  The row with the smallest id stays, null ids last; of rows that
    repeat id and text one stays, the first by a hash of all its columns.
    """
    rows, classes, _, comp = _linked(docs, n, percent)
    label = classes.select("fp", "node", "rep_id", "rep_th", "n").join(comp, "node", "left").where("n > 1 or component is not null")
    label = label.withColumn("group", F.coalesce("component", "node"))
    stays = label.groupBy("group").agg(F.min(F.struct(F.col("rep_id").isNull().alias("o"), "rep_id", "rep_th")).alias("s"))
    stays = stays.select("group", F.col("s.rep_id").alias("_stays"), F.col("s.rep_th").alias("_text"))
    of = rows.select("doc_id", "th", "fp").join(label.select("fp", "group"), "fp").groupBy("group", "doc_id", "th").agg(F.count("*").alias("n")).join(stays, "group")
    first = F.col("doc_id").eqNullSafe(F.col("_stays")) & (F.col("th") == F.col("_text"))
    of = cut(of.withColumn("gone", ~first).where("gone or n > 1").select("doc_id", "th", "gone"), "copies")
    i, t, whole, other, its = unused(docs, "_id", "_th", "_row", "_other", "_its")
    keyed = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(t, text_key(F.col("text")))
    pick = lambda x: x.select(F.col("doc_id").alias(other), F.col("th").alias(its))
    at = F.col(i).eqNullSafe(F.col(other)) & (F.col(t) == F.col(its))
    listed = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x  # noqa: E731  the texts are not shuffled
    kept = keyed.join(listed(pick(of.where("gone"))), at, "left_anti")
    again = listed(pick(of.where("not gone")))
    if again.isEmpty():
        return kept.select(*docs.columns)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(again, at, "left_semi").groupBy(i, t).agg(F.min_by(F.struct(*cols), F.xxhash64(F.to_json(F.struct(*cols)))).alias(whole)).select(f"{whole}.*")
    return kept.join(again, at, "left_anti").select(*docs.columns).unionByName(one)
