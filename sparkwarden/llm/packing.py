"""Best-fit packing of tokenised documents behind a Martello-Toth reduction.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the
driver, so planning costs the same for any corpus.  The reduction walks the
lengths downwards and permanently fixes bins that provably dominate every
alternative:

* the piece alone, when no remaining piece fits beside it;
* the piece with one other, the largest that fits beside it, when that one fills
  the bin exactly, or no two pieces fit beside the first, or no three do and no
  two that do are longer together;
* the piece with two others, when no three fit beside it, the two are the longest
  together and one of them is the longest alone, and no two pieces longer than
  the other fit.

These are the one-, two- and three-item cases of the dominance criterion: every
set that could fill the piece's bin has its members covered by single members of
the fixed one.  They hold for all equal pieces at once, and are tried until
nothing more is fixed.  What is left is packed by best fit, longest first,
again for all equal pieces at once: the tightest bin that takes a piece stays
the tightest until it takes no more, so whole groups of equal bins move together.

A plan is a list of groups ``(n_bins, [(length, count), ...])``.  Pieces get
their place from their rank among pieces of equal length; the rank comes from
hashed buckets and prefix sums, so one length may hold any share of the rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, unused

#: Distinct words and parts whose ids a worker keeps; beyond it the memory is emptied and filled anew.
WORDS_KEPT = 300_000
#: A word longer than this is encoded each time and not kept.
WORD_CHARS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _dominating(s: int, left: Counter, capacity: int) -> tuple[int, ...] | None:
    """The lengths that belong beside a piece of length s in some best packing; None where that is not certain."""
    room = capacity - s
    left[s] -= 1  # the piece itself is not its own mate
    try:
        present = np.asarray(sorted(k for k, n in left.items() if n and k <= room), "int64")
        if not len(present):
            return ()
        times = np.asarray([left[int(k)] for k in present])
        mate = int(present[-1])
        if mate == room:
            return (mate,)

        def smallest(lengths: np.ndarray, counts: np.ndarray, k: int) -> float:
            """Sum of the k shortest pieces; infinite where there are fewer."""
            some = np.repeat(lengths[:k], np.minimum(counts[:k], k))[:k]
            return float(some.sum()) if len(some) == k else np.inf

        if smallest(present, times, 2) > room:
            return (mate,)
        if smallest(present, times, 3) <= room:
            return None
        other = np.searchsorted(present, room - present, "right") - 1  # the longest that fits beside each
        other = np.where((other >= 0) & (present[other] == present) & (times[other] < 2), other - 1, other)
        pairs = np.where(other >= 0, present + present[other], 0)
        if mate >= pairs.max():
            return (mate,)
        second = int(present[other[-1]]) if other[-1] >= 0 else 0
        above = present > second
        if second and mate + second == pairs.max() and smallest(present[above], times[above], 2) > room:
            return (mate, second)
        return None
    finally:
        left[s] += 1


def fix_dominating(sizes: Counter, capacity: int) -> tuple[list, Counter]:
    """Bins fixed by dominance, and the lengths left over (lengths 1 to capacity)."""
    left, fixed, more = Counter({s: n for s, n in sizes.items() if n}), [], True
    while more:
        more = False
        for s in sorted(left, reverse=True):
            while left[s] and (mates := _dominating(s, left, capacity)) is not None:
                uses = Counter((s, *mates))
                k = min(left[v] // n for v, n in uses.items())  # what holds for one holds while all of them are left
                fixed.append((k, sorted(uses.items(), reverse=True)))
                left.subtract({v: k * n for v, n in uses.items()})
                more = True
        left = Counter({s: n for s, n in left.items() if n})
    return fixed, left


def best_fit(sizes: Counter, capacity: int) -> list:
    """Best fit over the lengths, longest first, in groups of equal bins."""
    open_: dict[int, list] = {}  # room left -> groups [n_bins, pattern]
    for s in sorted(sizes, reverse=True):
        n = sizes[s]
        for room in sorted(r for r in open_ if r >= s):
            k, groups = room // s, open_.pop(room)
            rest = []
            for bins, pattern in groups:
                full = min(bins, n // k)
                if full:
                    open_.setdefault(room - k * s, []).append([full, [*pattern, (s, k)]])
                    n -= full * k
                    bins -= full
                if bins and n:  # fewer than k pieces are left: one bin takes them
                    open_.setdefault(room - n * s, []).append([1, [*pattern, (s, n)]])
                    n, bins = 0, bins - 1
                if bins:
                    rest.append([bins, pattern])
            if rest:
                open_.setdefault(room, []).extend(rest)
            if not n:
                break
        if n:
            k = capacity // s
            if n // k:
                open_.setdefault(capacity - k * s, []).append([n // k, [(s, k)]])
            if n % k:
                open_.setdefault(capacity - (n % k) * s, []).append([1, [(s, n % k)]])
    return [(bins, pattern) for groups in open_.values() for bins, pattern in groups]


def plan(sizes: Counter, capacity: int) -> list:
    fixed, left = fix_dominating(sizes, capacity)
    return fixed + best_fit(left, capacity)


# Latin letters beyond ASCII whose case and composition are plain; an apostrophe may start a contraction.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells those letters: their UTF-8 bytes, unprintable ones moved up."""
    moved = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
    return {c: "".join(chr(moved.get(b, b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder(dict):
    """Ids of whole texts as little-endian 32-bit words; remembers the words between white space and their parts.

    Where ASCII white space always ends a token and yields none, words encode
    alone; words of plain letters, digits and signs are encoded by their parts,
    all others, and those that hold a special token, by the tokenizer itself.
    ``short`` says whether the tokenizer's file behaves so, which is tried on
    ``PROBES``; where it does not, whole texts go to the tokenizer.
    """

    PROBES = ("Hello, World! it's We'll ÉTÉ straße 12345 a1b2 x--y", "tab\tline\nfeed\r two  spaces ", "(foo_bar) e-mail@host.org #1 &amp; 3.14", "ñandú ÀÉ öß ÿ Ø 'quoted' don't", "supercalifragilistic ANTIDISESTABLISHMENT qqqzzzxxx")

    def __init__(self, tokenizer_file: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.model, self.spell = self.tok.model, _byte_letters()
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.short = not any(re.search(r"\s", t) for t in special) and all(self._by_words(p) == self._exact(p) for p in self.PROBES)

    def _exact(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a run of letters, a digit or a run of signs, straight from the vocabulary's merges."""
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.spell))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_words(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: str) -> bytes:
        if len(word) > WORD_CHARS or not _PLAIN.fullmatch(word) or (self.special and self.special.search(word)):
            value = self._exact(word)
        else:
            low = word.lower()
            parts = _PARTS.findall(low)
            if len(parts) != 1:
                value = b"".join([self[p] for p in parts])
            else:
                value = self._part(low) if low == word else self[low]
        if len(word) <= WORD_CHARS:
            if len(self) > WORDS_KEPT:
                self.clear()
            self[word] = value
        return value

    def encode(self, text: str) -> bytes:
        return self._by_words(text) if self.short else self._exact(text)


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> Encoder:
    """One encoder a worker process, so that its memory of words outlives a task."""
    return Encoder(tokenizer_file)


def tokenize(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: ids of the text, then ``end_id``.

    A null text counts as empty and gives the piece ``[end_id]``; repeated rows
    give repeated pieces; an empty table gives no rows.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer_file).encode
        end = np.asarray([end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = (encode(text) if isinstance(text, str) and text else b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces.

    ``pieces`` needs ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``)
    and should be a stored table: it is read twice.  Equal pieces take their
    places in any order; repeated rows are pieces of their own; null ids rank
    first; an empty table gives none.  Input columns named ``sequence_id`` or
    ``offset`` are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    bucket, ahead, rank_ = unused(pieces, "_bucket", "_before", "_rank")
    hist = Counter({int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()})  # at most capacity rows
    total = sum(hist.values())
    slots, base, rank = [], 0, Counter()
    for bins, pattern in plan(hist, capacity):
        at = 0
        for length, k in pattern:
            slots.append((length, rank[length], rank[length] + bins * k, base, k, at))
            rank[length] += bins * k
            at += length * k
        base += bins
    starts: dict[int, np.ndarray] = {}
    by_length: dict[int, np.ndarray] = {}
    for length in hist:
        by_length[length] = np.asarray([s[1:] for s in slots if s[0] == length], "int64")
    starts = {length: rows[:, 0] for length, rows in by_length.items()}
    shared = spark.sparkContext.broadcast((starts, by_length))  # bounded by capacity and the plan, not by the corpus

    # a length gets buckets by its share of the rows: at most capacity + 4 * partitions of them in all
    share = {length: 1 + n * 4 * partitions(spark) // total for length, n in hist.items()}
    buckets = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("length")] if share else F.lit(1)
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    sums = dealt.groupBy("length", bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    within = Window.partitionBy("length", bucket).orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in pieces.columns])
    ranked = dealt.withColumn(rank_, F.row_number().over(within) - 1).join(sums, ["length", bucket])
    ranked = ranked.withColumn(rank_, F.col(rank_) + F.col(ahead)).drop(bucket, ahead)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, rows = shared.value
        for pdf in batches:
            length, r = pdf["length"].to_numpy(), pdf[rank_].to_numpy()
            seq, off = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
            for v in np.unique(length):
                i = np.flatnonzero(length == v)
                hit = rows[v][np.searchsorted(first[v], r[i], "right") - 1]
                within_group, k = r[i] - hit[:, 0], hit[:, 3]
                seq[i] = hit[:, 2] + within_group // k
                off[i] = hit[:, 4] + within_group % k * v
            pdf = pdf.drop(columns=rank_)
            pdf["sequence_id"], pdf["offset"] = seq, off
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], rank_).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenises and packs ``docs``; one row per piece, see :func:`tokenize` and :func:`pack`."""
    return pack(cut(tokenize(docs, tokenizer_file, capacity, end_id), "pieces"), capacity)
