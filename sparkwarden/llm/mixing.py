"""Mixing sources to target weights: floor(rate) copies and one seeded draw.

Sizes are summed per source with map-side combine.  Targets solve a capped
water level: every source gets ``weight * level`` unless that is above
``max_repeat`` times its size, and the level is raised until the shares add up.
The level loop moves a few sums per round to the driver; sources stay in Spark,
and their ranks come from range partitions and prefix counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, unused

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``_rank`` from 0 by code point, null last, without one global task."""
    spread = cut(
        sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offset = spread.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return spread.withColumn("_rank", F.row_number().over(own) - 1).join(offset, "_part").withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source`` and ``size``.

    Weights repeat over the sources in code-point order, null last.  A corpus
    without a word has targets of 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(by_source)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", w.cast("long").alias("weight"), (F.col("source_size") * max_repeat).alias("_most")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > F.col("_most")
        r = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if r["n"] == capped or not r["free"]:
            break
        capped = r["n"]
        level = (share * total - r["fixed"]) / r["free"]
    return ranked.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(level), F.col("_most").cast("double")).alias("target"))


COLUMNS = ("_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, seed: int = 0, names: Sequence[str] = COLUMNS) -> DataFrame:
    """``docs`` with a document's size, its source's size and target, and its copies beside its columns.

    Copies are floor(rate) plus 1 if the draw of the document's id falls below
    the fraction of the rate ``target / source_size``; they never exceed
    ``max_repeat``.  Null texts have size 0; null sources are one source;
    repeated rows draw alike; a source without words has rate 0; an empty table
    gives none.  Columns of ``docs`` that bear one of ``names`` are replaced.
    """
    size, source_size, target, copies = names
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    source, rate = unused(rest, "_source", "_rate")
    sized = rest.withColumn(size, word_count(F.col("text").cast("string")))
    goal = targets(sized.select(F.col("source").cast("string").alias("source"), F.col(size).alias("size")), weights, share, max_repeat)
    goal = goal.select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    # documents are never shuffled here: AQE broadcasts the sources where they are few, and splits hot ones otherwise
    out = sized.join(goal, F.col("source").cast("string").eqNullSafe(F.col(source)), "left").drop(source)
    out = out.withColumn(rate, F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0)))
    whole = F.floor(rate)
    return out.withColumn(copies, (whole + F.when(unit_draw(F.col("doc_id"), seed) < F.col(rate) - whole, 1).otherwise(0)).cast("int")).drop(rate)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as :func:`mix` says, with the columns of ``docs``."""
    names = unused(docs, *COLUMNS, "_copy")
    out = mix(docs, **options, names=names[:4]).where(F.col(names[3]) > 0)
    return out.withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])
