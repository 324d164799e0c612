"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Character 1- to 3-grams are hashed into a fixed number of buckets.  Document
frequencies cover every training document; the regression is fitted on a
bounded sample by follow-the-regularised-leader with elastic-net penalties,
and a held-back part of the sample calibrates its temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, within
from .mixing import unit_draw

BUCKETS = 1 << 15
#: About so many rows of each language, so many in all and so many characters of them are fitted on, chosen by a hash of their ids.
MAX_TRAIN_PER_LANGUAGE, MAX_TRAIN, MAX_TRAIN_CHARS = 800, 64_000, 60_000_000


def buckets_of(text: str) -> np.ndarray:
    """Bucket of each 1-, 2- and 3-gram of the lower-cased letters, spaces between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "uint32").astype("uint64")
    # what is not a letter in ASCII is a word boundary; other scripts keep their characters
    codes = np.where((codes < 128) & ~((codes >= 97) & (codes <= 122)), np.uint64(32), codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    h1 = codes * np.uint64(0x9E3779B97F4A7C15)
    h2 = (h1[:-1] ^ (codes[1:] + np.uint64(0x51ED270B))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h3 = (h2[:-1] ^ (codes[2:] + np.uint64(0x2545F491))) * np.uint64(0x165667B19E3779F9)
    return (np.concatenate((h1[codes != 32], h2, h3)) >> np.uint64(49)).astype("int64")


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.bincount(buckets_of(text), minlength=BUCKETS)
    at = np.flatnonzero(c)
    return at, c[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, c = counts_of(text)
    x = (1 + np.log(c)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature

    def predict(self, text) -> tuple[str, float]:
        """Label and calibrated probability; ``und`` and 0 without a letter or a learned label."""
        if not has_letter(text) or not self.labels:
            return "und", 0.0
        at, x = vector(text, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.labels[k], float(p[k] / p.sum())


def fit(texts: list[str], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 0) -> Model:
    labels = sorted(set(langs))
    index = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    rows = [(*vector(t, idf), index[v]) for t, v in zip(texts, langs)]
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, x, y = rows[i]
            w, b = leader(z[at], n[at], l1), leader(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    weights, bias = leader(z, n, l1), leader(zb, nb, 0.0)
    held = [(rows[i][1] @ weights[rows[i][0]] + bias, rows[i][2]) for i in (back if len(back) else used)]

    def loss(t: float) -> float:
        total = 0.0
        for s, y in held:
            u = s / t
            m = u.max()
            total += m + np.log(np.exp(u - m).sum()) - u[y]
        return total

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))]) if held else 1.0
    return Model(labels, idf, weights.astype("float32"), bias, temperature)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed IDF of every bucket over all rows of ``text``; a row per bucket reaches the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS + 1, "int64"), 0
        for pdf in batches:
            for t in pdf["text"]:
                if isinstance(t, str) and t:
                    df[np.unique(buckets_of(t))] += 1
                n += 1
        df[BUCKETS] = n
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"b": hit, "n": df[hit]})

    rows = texts.select("text").mapInPandas(part, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in rows:
        df[r["b"]] = r["n"]
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


def train(docs: DataFrame, per_language: int = MAX_TRAIN_PER_LANGUAGE) -> Model:
    """Learns from ``text`` and non-null ``lang`` of all rows given.

    Every language is learned, of many the fewer rows each; the model has a
    weight per bucket and language.  Texts are learned from whole, however long;
    one that does not fit the sample's characters any more is passed over.
    Repeated rows count as often as they stand; an empty table gives a model
    without labels.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    idf = inverse_frequencies(known)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return Model([], idf, np.zeros((BUCKETS, 0), "float32"), np.zeros(0), 1.0)
    most = max(1, min(per_language, MAX_TRAIN // n_langs))
    share = F.broadcast(sizes.select("lang", (F.lit(float(most)) / F.col("n")).alias("share")))  # a row per language
    drawn = unit_draw(F.col("doc_id"), 2)
    sample = known.join(share, "lang").where(drawn < F.col("share")).select("doc_id", "text", "lang", drawn.alias("draw"), F.xxhash64("doc_id", "text", "lang").alias("k"))
    sample = cut(sample.orderBy("draw", "k").limit(2 * most * n_langs), "labelled")
    rows = sample.select("draw", "k", F.length("text").alias("n")).collect()
    fits = within(sorted(rows, key=lambda r: (r["draw"], r["k"])), 2, MAX_TRAIN_CHARS)
    if len(fits) < len(rows):
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted({r["k"] for r in fits})], "k long")), "k", "left_semi")
    pdf = sample.toPandas().sort_values(["doc_id", "text", "lang"])
    pdf = pdf[[has_letter(t) for t in pdf["text"]]]
    return fit(pdf["text"].tolist(), pdf["lang"].tolist(), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; null or letterless texts are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [shared.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double")
