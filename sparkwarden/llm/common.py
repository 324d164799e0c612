"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is set here only where the session leaves it unset, and then only in
    local mode: a cluster has no machine-local folder that all executors see.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = tempfile.mkdtemp(prefix="sparkwarden-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Unlike a cached or locally checkpointed frame, the files outlive executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids kept out of training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` bears, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def within(rows: list, size: int, budget: int) -> list:
    """The rows, in order, that fit a budget together; ``row[size]`` is what a row takes.

    A row that does not fit is passed over and the next ones still count, so a
    sample is bounded by what it holds and not by what a row may hold.
    """
    out, left = [], budget
    for row in rows:
        if row[size] <= left:
            out.append(row)
            left -= row[size]
    return out
