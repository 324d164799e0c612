"""Dataflow: bounded semi-naive fixpoints and store pairing."""

from __future__ import annotations

import atexit
import contextlib
import functools
import itertools
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 20
#: Rounds after which the facts found so far become one table.
COMPACT = 6
#: A driver whose heap may not grow beyond so many bytes gives back what it does not use after every so many stored frames.
SMALL_HEAP, RELIEF = 2 << 30, 1
#: Percent of its heap that it may keep free then; the JVM's own bounds hold again afterwards.
KEPT_FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "20"}
_frames, _relieving = itertools.count(1), threading.Lock()


def _shared(spark: SparkSession) -> str:
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = tempfile.mkdtemp(prefix="sparkwarden-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def relieve(spark: SparkSession) -> bool:
    """Collects a small driver's garbage, plans and their broadcasts, and returns freed heap and native memory to the system; tells whether it did.

    Every plan is compiled and optimized anew as its stages end, which leaves
    much behind in the heap and in the allocator's arenas; both keep it.
    """
    jvm = spark.sparkContext._jvm
    if jvm.Runtime.getRuntime().maxMemory() > SMALL_HEAP:
        return False
    with _relieving:
        old = {}
        with contextlib.suppress(Exception):  # a JVM whose bounds can't be changed only collects its garbage
            old = {name: _option(spark, name) for name in KEPT_FREE}
        try:
            with contextlib.suppress(Exception):
                for name in old:
                    _bean(spark, "HotSpotDiagnostic", "setVMOption", name, KEPT_FREE[name])
            jvm.System.gc()
        finally:
            with contextlib.suppress(Exception):
                for name, value in reversed(old.items()):  # the least is never above the most
                    _bean(spark, "HotSpotDiagnostic", "setVMOption", name, value)
        with contextlib.suppress(Exception):  # only some Java versions on Linux can
            _bean(spark, "DiagnosticCommand", "systemTrimNativeHeap")  # as jcmd PID System.trim_native_heap does
    return True


def _option(spark: SparkSession, name: str) -> str:
    return _bean(spark, "HotSpotDiagnostic", "getVMOption", name).get("value")


def _bean(spark: SparkSession, bean: str, call: str, *given: str):
    """What a management bean says; the server's own class is not open to calls, its interface is."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    asked, kinds = gateway.new_array(jvm.Object, len(given)), gateway.new_array(jvm.String, len(given))
    for i, x in enumerate(given):
        asked[i], kinds[i] = x, "java.lang.String"
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), call
    if given:
        args[2], args[3] = asked, kinds
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def _written(spark: SparkSession) -> None:
    if next(_frames) % RELIEF == 0:
        relieve(spark)


def measuring(spark: SparkSession) -> SparkSession:
    """A session like this one whose joins broadcast only what a shuffle has measured, up to the same bound.

    Facts repeat each other, so their files are a small part of their rows, and
    what is planned by the size of a file is gathered by the driver at any size.
    """
    _shared(spark)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    if own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", own.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def stored(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """A frame written to the shared folder and read back, by another session if one is given: its lineage is cut."""
    path = f"{_shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(df.sparkSession)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def gathered(frames: list[DataFrame], name: str) -> DataFrame:
    """The union of frames, missing columns null, each written by itself: no plan holds more than one of them."""
    whole = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    path = f"{_shared(whole.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for df in frames:
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in whole.dtypes]).write.mode("append").parquet(path)
        _written(whole.sparkSession)
    return whole.sparkSession.read.schema(whole.schema).parquet(path)


def semi_naive(seeds: DataFrame, edges: DataFrame, keys: list[str], labels: list[str] = (), transform=None, max_rounds: int | None = MAX_ROUNDS, edges_stored: bool = False) -> tuple[DataFrame, bool]:
    """Closure of ``seeds`` over ``edges`` (G01); returns the facts and whether the bound was hit.

    ``seeds`` has ``keys``, ``node`` and ``labels``; ``edges`` has ``keys``,
    ``src``, ``dst`` and what ``transform`` needs.  A round joins only the facts
    that the last one found.  Facts are sets: cycles end by themselves, and an
    edge may be repeated.
    """
    identity = [*keys, "node", *labels]
    known = delta = stored(seeds.select(*identity).distinct(), "facts")
    parts, rounds = [known], 0
    if delta.isEmpty():
        return known, False
    edges = edges if edges_stored else stored(edges, "edges")
    while True:
        if max_rounds is not None and rounds == max_rounds:
            return known, True
        moved = delta.withColumnRenamed("node", "src").join(edges, [*keys, "src"])
        if transform is not None:
            moved = transform(moved)
        new = moved.withColumn("node", F.col("dst")).select(*identity).distinct().join(known, identity, "left_anti")
        delta = stored(new, "facts")
        parts.append(delta)
        if len(parts) > COMPACT:  # so that a round reads a few tables, however many came before
            parts = [stored(functools.reduce(DataFrame.unionByName, parts), "known")]
        known = functools.reduce(DataFrame.unionByName, parts)
        rounds += 1
        if delta.isEmpty():
            return known, False


def pair_stores(reads: DataFrame, writes: DataFrame, by: list[str]) -> DataFrame:
    """``by, writer, n_writers``; a read meets the writes of its table with its column or a wildcard.

    Three equi-joins on the distinct keys replace the disjunction: reads of a
    column take its writes and the table's wildcard writes, wildcard reads all.
    """
    per_key = writes.groupBy("table", "column").agg(F.min("writer").alias("w"), F.count("*").alias("n"))
    per_table = writes.groupBy("table").agg(F.min("writer").alias("w"), F.count("*").alias("n"))
    plain, wild = reads.where("column <> '*'"), reads.where("column = '*'")
    own = plain.join(per_key.where("column <> '*'"), ["table", "column"]).select(*by, "w", "n")
    star = plain.join(per_key.where("column = '*'").drop("column"), "table").select(*by, "w", "n")
    every = wild.join(per_table, "table").select(*by, "w", "n")
    return own.unionByName(star).unionByName(every).groupBy(*by).agg(F.min("w").alias("writer"), F.sum("n").cast("long").alias("n_writers"))


def as_of(uses: DataFrame, definitions: DataFrame, by: list[str], at: str) -> DataFrame:
    """The last definition strictly before each use, by one sort of the union."""
    tagged = definitions.select(*by, at, F.col("value"), F.lit(None).cast("long").alias("use_id"), F.lit(1).alias("_k")).unionByName(
        uses.select(*by, at, F.lit(None).cast(dict(definitions.dtypes)["value"]).alias("value"), "use_id", F.lit(0).alias("_k")))
    w = Window.partitionBy(*by).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, -1)
    return tagged.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("use_id is not null").select("use_id", "value")


def walk_back(callers: DataFrame, most: int = 16) -> DataFrame:
    """``to, chain`` for each row of ``to, by``: from ``by`` on back to a start, at most ``most`` steps, no step twice."""
    step = callers.select(F.col("to").alias("_to"), F.col("by").alias("_by"))
    out = callers.select("to", F.array("by").alias("chain"))
    for _ in range(most - 1):
        on = out.join(step, F.element_at("chain", -1) == F.col("_to"), "left")
        fresh = F.col("_by").isNotNull() & ~F.array_contains("chain", F.col("_by")) & (F.col("_by") != F.col("to"))
        longer = stored(on.select("to", F.when(fresh, F.array_append("chain", F.col("_by"))).otherwise(F.col("chain")).alias("chain"), F.coalesce(fresh, F.lit(False)).alias("grown")), "chains")
        out = longer.drop("grown")
        if longer.where("grown").isEmpty():
            break
    return out


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each group up to a bound, with ``overflow`` where there are more, and the groups beyond it."""
    nth = Window.partitionBy(*by).orderBy(*order)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    kept = rows.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= most).drop("_nth").join(sizes, by).withColumn("overflow", F.col("_size") > most).drop("_size")
    return kept, sizes.where(F.col("_size") > most).withColumnRenamed("_size", "n")
