"""URL filter: a blocked Bloom filter ahead of an exact hash join.

Listed entries are canonical (host, path prefix) pairs.  Each URL offers its
canonical candidates: every suffix of its host, and with the suffixes that may be
listed its path cut at each path length listed for them.  The filter, one 256-bit
block per key with eight bits set, drops nearly all candidates where they are
made; the rest meet the list in hash joins, which remove the false positives.  The filter is sized by a count of the
list and only broadcast up to ``MAX_FILTER_BYTES``; for longer lists the block
size stays and the false-positive rate rises, which the join makes good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK_WORDS = 8  # of 32 bits
KEYS_PER_BLOCK = 16
MAX_FILTER_BYTES = 64 << 20
# Odd multipliers that pick one bit in each word of a block (fixed values of the split-block design).
SALTS = np.asarray([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], "uint32")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF)).astype("uint32")
    return block.astype("int64"), np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))


class BlockedBloom:
    """Built by OR-ing partial filters; ``might`` has no false negatives."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.words = np.zeros((blocks, BLOCK_WORDS), "uint32") if words is None else words

    def add(self, hashes: np.ndarray) -> None:
        block, bits = _bits(hashes.astype("int64").view("uint64"), len(self.words))
        for i in range(BLOCK_WORDS):
            np.bitwise_or.at(self.words[:, i], block, bits[:, i])

    def might(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = _bits(hashes.astype("int64").view("uint64"), len(self.words))
        return ((self.words[block] & bits) == bits).all(1)


def build_filter(keys: DataFrame, n_keys: int) -> BlockedBloom:
    """A filter of the long column ``h``; each task sends one filter, tree-merged by block in Spark."""
    blocks = max(1, min(n_keys // KEYS_PER_BLOCK + 1, MAX_FILTER_BYTES // (4 * BLOCK_WORDS)))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BlockedBloom(blocks)
        for pdf in batches:
            own.add(pdf["h"].to_numpy())
        hit = np.flatnonzero(own.words.any(1))
        yield pd.DataFrame({"b": hit, **{f"w{i}": own.words[hit, i].astype("int64") for i in range(BLOCK_WORDS)}})

    schema = "b long, " + ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))
    merged = keys.mapInPandas(part, schema).groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    out = BlockedBloom(blocks)
    for r in merged.toLocalIterator():  # at most `blocks` rows, bounded by MAX_FILTER_BYTES
        out.words[r["b"]] = [r[f"w{i}"] for i in range(BLOCK_WORDS)]
    return out


def match(urls: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path`` and the longest listed entry of each row, else nulls.

    ``listed`` has ``host, path, kind, verdict``; a host covers its subdomains,
    a path is a prefix.  Kinds rank by their first
    letter, descending (``rule`` before ``list``);
    within a kind the longest host plus path wins, and equal entries
    with two verdicts resolve to the one whose first letter is smaller.  Rows keep null keys and
    repeats; null URLs and those without ``://`` have empty host and path and
    match nothing.
    """
    spark = urls.sparkSession
    listed = cut(listed.select(F.lower("host").alias("lh"), F.col("path").alias("lp"), "kind", "verdict").where("lh is not null and lp is not null"), "listed")
    lengths = listed.groupBy("lh").agg(F.collect_set(F.length("lp")).alias("_lengths"))
    hashed = listed.select(F.explode(F.array(F.xxhash64("lh"), F.xxhash64("lh", "lp"))).alias("h"))
    shared = spark.sparkContext.broadcast(build_filter(hashed, 2 * listed.count()).words)

    @F.pandas_udf("boolean")
    def might(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(0, shared.value).might(h.to_numpy()))

    rows = urls.select(F.col(key), F.col(url).cast("string").alias("_url"))
    rows = rows.select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = rows.where("host <> ''").select("host", "path").distinct()
    hosts = distinct.select("host", "path", F.explode(tails).alias("lh")).where(might(F.xxhash64("lh"))).join(lengths, "lh")
    offered = hosts.select("host", "path", "lh", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    offered = offered.select("host", "path", "lh", F.substring("path", F.lit(1), F.col("_n")).alias("lp"))
    possible = offered.where(might(F.xxhash64("lh", "lp")))
    exact = possible.join(listed, ["lh", "lp"])
    rank = F.struct(F.ascii("kind").alias("k"), (F.length("lh") + F.length("lp")).alias("n"), (-F.ascii("verdict")).alias("v"))
    best = exact.groupBy("host", "path").agg(F.max(F.struct(rank.alias("r"), "lh", "lp", "kind", "verdict")).alias("m"))
    found = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.concat("m.lh", "m.lp").alias("entry"), "m.kind", "m.verdict")
    return rows.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
