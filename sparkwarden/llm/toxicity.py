"""Toxicity by multiple-instance learning: noisy-or over sentence scores.

A document is a bag of sentences.  A sentence has probability sigmoid(bias +
sum of its word weights); a document is toxic with probability 1 - prod(1 - p),
and that likelihood is trained from document labels alone, so the sentences
that carry a label are found without being marked.  A word's weight is the sum
of the weights of its hashed features (the word, its beginnings, and the inner
parts of a long one or of a run without spaces), so unseen inflections and
compounds score too.  A word that repeats the one before it adds nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import ne
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, within
from .mixing import unit_draw

#: At most so many labelled rows of each label, and so many characters of them together, are fitted on, chosen by a hash of their ids.
MAX_TRAIN, MAX_TRAIN_CHARS = 4000, 60_000_000
BUCKETS = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
BREAK = 1e9
#: A sentence goes on until it has so many words.
LEAST_WORDS = 5
#: Words longer than this, compounds and runs without spaces, count by their inner parts as well.
LONG_WORD = 12
WORDS_KEPT = 200_000


def features(word: str) -> list[int]:
    """Buckets of a word: itself, its beginnings of 3 to 6 bytes, and all its 5-letter parts if it is longer than LONG_WORD."""
    w = word.encode("utf-8", "replace")
    out = [crc32(b"$", crc32(w)) % BUCKETS, *(crc32(w[:n]) % BUCKETS for n in (3, 4, 5, 6) if len(w) >= n)]
    if len(word) > LONG_WORD:
        out += [crc32(b"~" + word[i : i + 5].encode("utf-8", "replace")) % BUCKETS for i in range(1, len(word) - 4)]
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans that end at ``. ! ?`` or line breaks once they have LEAST_WORDS words, and the rest."""
    out, start, words = [], 0, 0
    for m in TOKEN.finditer(text):
        if m[0][0] not in ".!?\n":
            words += 1
        elif words >= LEAST_WORDS:
            out.append((start, m.start()))
            start, words = m.end(), 0
    return [*out, (start, len(text))] if words else out


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer(dict):
    """Word weights as they are met; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.at = model, memoryview(np.ascontiguousarray(model.weights, "float32"))

    def __missing__(self, word: str) -> float:
        if word[0] in ".!?\n":
            value = BREAK
        else:
            at = self.at
            value = sum([at[f] for f in features(word)])
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = value
        return value

    def sentences(self, text: str) -> np.ndarray:
        """Probabilities of the sentences that hold a letter."""
        tokens = TOKEN.findall(text.lower())
        v = np.fromiter(map(self.__getitem__, tokens), "float64", len(tokens))
        is_break = v >= BREAK
        counts = ~is_break  # a word counts, unless it repeats the one before it
        counts[1:] &= np.fromiter(map(ne, tokens[1:], tokens), bool, max(0, len(tokens) - 1))
        v = np.where(counts, v, 0.0)
        words = np.concatenate(([0], np.cumsum(counts)))
        at, done = [], 0
        for i in np.flatnonzero(is_break).tolist():
            if words[i] - done >= LEAST_WORDS:
                at.append(i)
                done = words[i]
        at = np.asarray(at, "int64")
        starts = np.concatenate(([0], at + 1))
        ends = np.concatenate((at, [len(v)]))
        keep = words[ends] > words[starts]
        total = np.concatenate(([0.0], np.cumsum(v)))
        s = total[ends[keep]] - total[starts[keep]] + self.model.bias
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; 0 for a text without any."""
        if not text:
            return 0.0
        return float(-np.expm1(np.log1p(-np.minimum(self.sentences(text), 1 - 1e-12)).sum()))


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0, epochs: int = 12, batch: int = 64, rate: float = 0.3, l2: float = 1e-5, seed: int = 0) -> Model:
    """Adagrad on the noisy-or likelihood of the labels (0 or 1); ``clean_weight`` counts each clean document so many times."""
    vocabulary: dict[str, int] = {}
    docs = []
    for text in texts:
        ids, cuts = [], [0]
        for t in TOKEN.findall((text or "").lower()):
            if t[0] in ".!?\n":
                if len(ids) - cuts[-1] >= LEAST_WORDS:
                    cuts.append(len(ids))
            else:
                word = vocabulary.setdefault(t, len(vocabulary))
                if len(ids) == cuts[-1] or ids[-1] != word:
                    ids.append(word)
        if len(ids) == cuts[-1]:
            cuts.pop()
        docs.append((np.asarray(ids, "int32"), np.asarray(cuts, "int64")))
    buckets, ends = array("i"), array("q", [0])  # of all words, one after the other
    for word in vocabulary:
        buckets.extend(features(word))
        ends.append(len(buckets))
    flat, ptr = np.frombuffer(buckets, "int32") if len(buckets) else np.zeros(0, "int32"), np.frombuffer(ends, "int64")
    usable = [i for i, (ids, _) in enumerate(docs) if len(ids)]
    weights, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    bias, bias_g2 = -8.0, 1e-3
    y = np.asarray(labels, "float64")
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), batch):
            group = usable[at : at + batch]
            ids = np.concatenate([docs[i][0] for i in group])
            sizes = np.asarray([len(docs[i][0]) for i in group])
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            starts = np.concatenate([docs[i][1] + b for i, b in zip(group, base)])
            n_sent = np.asarray([len(docs[i][1]) for i in group])
            words, place = np.unique(ids, return_inverse=True)
            lens = ptr[words + 1] - ptr[words]
            first = np.concatenate(([0], np.cumsum(lens)[:-1]))
            feats = flat[np.repeat(ptr[words] - first, lens) + np.arange(lens.sum())]
            value = np.add.reduceat(weights[feats], first)
            s = np.clip(np.add.reduceat(value[place], starts) + bias, -30, 30)
            p = 1 / (1 + np.exp(-s))
            head = np.concatenate(([0], np.cumsum(n_sent)[:-1]))
            none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), head)
            toxic = np.maximum(-np.expm1(none), 1e-9)
            yy = y[group]
            grad = np.repeat(np.where(yy > 0.5, -(1 - toxic) / toxic, clean_weight), n_sent) * p / len(group)
            per_word = np.bincount(place, np.repeat(grad, np.diff(np.append(starts, len(ids)))), len(words))
            g = np.bincount(feats, np.repeat(per_word, lens), BUCKETS)
            touched = np.unique(feats)
            gt = g[touched] + l2 * weights[touched]
            g2[touched] += gt * gt
            weights[touched] -= rate * gt / np.sqrt(g2[touched])
            bias_g2 += grad.sum() ** 2
            bias -= rate * grad.sum() / bias_g2**0.5
    return Model(weights.astype("float32"), bias)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on a bounded, hash-chosen sample of each label.

    ``labels`` has ``doc_id, toxic``; null labels and ids are ignored, and an id
    labelled twice counts as toxic if either label is.  Texts are learned from
    whole, however long; one that does not fit the sample's characters any more
    is passed over.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = (max(1.0, sizes.get(0, 0) / max_train) / max(1.0, sizes.get(1, 0) / max_train)) ** 0.5  # between the sample's balance and that of all labels
    parts = [known.where(F.col("toxic") == v).orderBy(unit_draw(F.col("doc_id"), 1), "doc_id").limit(max_train) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * max_train rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # a row for each chosen id, however often it is repeated
    sample = cut(texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    sizes = sample.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("n"), unit_draw(F.col("doc_id"), 1).alias("draw")).collect()
    by_label = [within(sorted((r for r in sizes if r["toxic"] == v), key=lambda r: (r["draw"], r["doc_id"])), 2, MAX_TRAIN_CHARS // 2) for v in (0, 1)]
    fits = [(r["doc_id"],) for part in by_label for r in part]
    if len(fits) < len(sizes):
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long")), "doc_id", "left_semi")
    pdf = sample.toPandas().sort_values("doc_id")
    return fit(pdf["text"].tolist(), pdf["toxic"].tolist(), weight)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of ``text``; null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Model(*shared.value).scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) if isinstance(t, str) else 0.0 for t in texts], dtype="float64")

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; repeated rows score alike, an empty table gives no rows."""
    return with_score(docs.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", "score")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, p`` of each sentence of probability ``least`` or more, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Model(*shared.value).scorer()
        for pdf in batches:
            found = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                for a, b in sentence_spans(text) if isinstance(text, str) else ():
                    p = scorer.sentences(text[a:b])
                    if len(p) and p.max() >= least:
                        found.append((doc_id, a, b, float(p.max())))
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "p"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, start int, end int, p double")
