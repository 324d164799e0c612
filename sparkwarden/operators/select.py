"""Suppression and selection: filters, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import dims

SHAPE_ONLY = ("701", "702", "703", "704")
COVERING = ("709", "710", "743")


def cover(findings: DataFrame, weak: tuple[str, ...] = SHAPE_ONLY, strong: tuple[str, ...] = COVERING, at: tuple[str, ...] = ("file", "line", "column")) -> DataFrame:
    """Findings of weak codes go where one of a strong code has the same place."""
    proven = findings.where(F.col("code").isin(*strong)).select(*at).distinct()
    shape = findings.where(F.col("code").isin(*weak)).join(proven, list(at), "left_anti")
    return findings.where(~F.col("code").isin(*weak)).unionByName(shape.select(*findings.columns))


def matches(patterns: list[str], code: Column, name: Column) -> Column:
    """Any ``code[:name]`` pattern; an empty code half means any code."""
    out = F.lit(False)
    for p in patterns:
        half, _, rest = p.partition(":")
        regex = S.code_pattern_regex(half)
        if regex is None:
            raise ValueError(f"unreadable pattern {p!r}")
        test = F.lit(True) if not half else code.rlike(regex)
        if rest:
            test = test & name.rlike(S.glob_regex(rest))
        out = out | test
    return out


def ladder(findings: DataFrame, ignore: list[str] = (), enable: list[str] = (), only: list[str] = (), categories: list[str] = (), severity: str = "info", confidence: str = "low") -> DataFrame:
    """Ignore, enable, only, category, severity, confidence, in this order (E-13).

    Codes that report gaps pass ``only``, categories and the severity floor
    (K08), not the confidence floor.  What the source itself enables is not
    ignored by an option (K04).
    """
    code, name = F.col("code"), F.col("name")
    degraded = code.isin(*dims.DEGRADED)
    keep = ~matches(ignore, code, name) | matches(enable, code, name)
    if "enabled" in findings.columns:
        keep = keep | F.coalesce("enabled", F.lit(False))
    if only:
        keep = keep & (matches(only, code, name) | degraded)
    if categories:
        keep = keep & (S.category(code).isin(*categories) | degraded)
    keep = keep & ((S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(severity)) | degraded)
    return findings.where(keep & (S.confidence_rank(F.col("confidence")) >= S.CONFIDENCES.index(confidence) + 1))


def allow_list(findings: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that no entry allows, and ``entry_no, n`` of every entry, zeros too.

    ``entries`` has ``entry_no, code, file``: the code is equal, and the file is
    equal or a path suffix after a slash; the first entry that fits counts.
    """
    hit = findings.alias("f").join(F.broadcast(entries.alias("e")), (F.col("f.code") == F.col("e.code")) & ((F.col("f.file") == F.col("e.file")) | F.col("f.file").endswith(F.concat(F.lit("/"), F.col("e.file")))), "left")
    first = hit.groupBy(*[F.col(f"f.{c}") for c in findings.columns]).agg(F.min("e.entry_no").alias("_entry"), F.count("*").alias("_n"))
    kept = first.where("_entry is null").drop("_entry", "_n")
    counts = entries.select("entry_no").join(first.where("_entry is not null").groupBy(F.col("_entry").alias("entry_no")).agg(F.count("*").alias("n")), "entry_no", "left")
    return kept, counts.select("entry_no", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def clamped_depth(events: DataFrame, by: list[str], order: list[str], delta: str = "delta", name: str = "depth") -> DataFrame:
    """K03, E-15: running sum of +1 and -1 that never goes below zero, by two window sums."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("_s", F.sum(delta).over(w))
    return summed.withColumn(name, (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("int")).drop("_s")


def apply_directives(findings: DataFrame, directives: DataFrame, mark: bool = False) -> DataFrame:
    """Findings that the in-source directives leave; with ``mark`` and whether one of them enables it.

    ``directives`` has ``file, line, action, pattern, push``: ``ignore`` works
    from its line on; between a ``push`` and its ``pop`` it ends with the
    region; ``enable`` and ``only`` override; 012 is never filtered (E-14).
    """
    depth = clamped_depth(directives.withColumn("delta", F.when(F.col("action") == "push", 1).when(F.col("action") == "pop", -1).otherwise(0)), ["file"], ["line"])
    later = Window.partitionBy("file").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    # a region directive ends at the first later line whose depth falls below its own
    listed = depth.withColumn("_later", F.collect_list(F.struct("line", "depth")).over(later))
    until = F.array_min(F.transform(F.filter("_later", lambda x: x["depth"] < F.col("depth")), lambda x: x["line"]))
    active = listed.where(F.col("action").isin("ignore", "enable", "only")).select("file", F.col("line").alias("_from"), F.when(F.col("depth") > 0, until).alias("_to"), "action", "pattern")
    joined = findings.join(active, "file", "left")
    here = (F.col("line") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("line") < F.col("_to")))
    fits = F.rlike("code", F.col("pattern"))
    flag = lambda a: F.max(F.coalesce(here & (F.col("action") == a) & fits, F.lit(False)))
    seen = F.max(F.coalesce(here & (F.col("action") == "only"), F.lit(False)))
    out = joined.groupBy(*findings.columns).agg(flag("ignore").alias("_i"), flag("enable").alias("_e"), flag("only").alias("_o"), seen.alias("_s"))
    keep = (F.col("code") == "012") | F.col("_e") | F.when(F.col("_s"), F.col("_o")).otherwise(~F.col("_i"))
    return out.where(keep).select(*findings.columns, *([F.col("_e").alias("enabled")] if mark else []))


def in_scope(findings: DataFrame, roots: list[str]) -> DataFrame:
    """Findings under any of the roots."""
    keep = F.lit(False)
    for r in roots:
        keep = keep | F.col("file").startswith(r.rstrip("/") + "/") | (F.col("file") == r)
    return findings.where(keep)
