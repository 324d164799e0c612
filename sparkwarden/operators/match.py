"""Registry matching: wildcard joins with best-match semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from ..sources import dims


def best_match(calls: DataFrame, dim: DataFrame, path: str = "path", take: list[str] = (), how: str = "inner") -> DataFrame:
    """Each call with columns ``take`` of its best declaration.

    Best means the smaller ``scope_rank``, then fewer wildcards, then the
    earlier declaration.  Wildcards are matched against the distinct paths only:
    the nested-loop join sees a vocabulary, the calls themselves join by key.
    """
    paths = calls.select(F.col(path).alias("_path")).distinct()
    exact, wild = (F.broadcast(dim.where(kind)) for kind in ("n_wild = 0", "n_wild > 0"))  # a registry: tens of rows
    exact = paths.join(exact, F.col("_path") == F.col("pattern"))
    loose = paths.join(wild, F.rlike("_path", F.col("regex")))
    cols = ["_path", "scope_rank", "n_wild", "decl_no", *take]
    both = exact.select(*cols).unionByName(loose.select(*cols))
    best = both.groupBy("_path").agg(F.min_by(F.struct(*take), F.struct("scope_rank", "n_wild", "decl_no")).alias("_m"))
    return calls.join(best, F.col(path) == F.col("_path"), how).select(*calls.columns, *[F.col(f"_m.{c}").alias(c) for c in take])


def entry_points(functions: DataFrame, profiles: tuple[str, ...]) -> DataFrame:
    """``entry, arg, channel`` of each ``name, file``; file-scoped declarations go first."""
    rows = [(i, 0 if f else 1, n, glob_regex(n), glob_regex(f) if f else "", a, c, ch) for i, (p, n, f, a, c, ch) in enumerate(dims.ENTRY_POINTS) if p in profiles]
    dim = functions.sparkSession.createDataFrame(rows, "decl_no int, scope int, entry string, name_regex string, file_regex string, arg array<int>, confidence string, channel string")
    names = functions.select("name", "file").distinct()
    hit = names.join(F.broadcast(dim), F.rlike("name", F.col("name_regex")) & ((F.col("file_regex") == "") | F.rlike("file", F.col("file_regex"))))
    best = hit.groupBy("name", "file").agg(F.min_by(F.struct("entry", "arg", "confidence", "channel"), F.struct("scope", "decl_no")).alias("_m"))
    return functions.join(best, ["name", "file"], "left").select(*functions.columns, "_m.*")


def longest_prefix(paths: DataFrame, dim: DataFrame, path: str = "path", key: str = "key") -> DataFrame:
    """The longest declared name that is the path or ends at one of its dots; equi-joins only."""
    parts = F.split(path, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    offered = paths.select("*", F.explode(heads).alias(key))
    return offered.join(dim, key).groupBy(*paths.columns).agg(F.max_by(key, F.length(key)).alias(key))


def module_names(required: DataFrame, name: str = "module") -> DataFrame:
    """What a required module is called."""
    alias = F.create_map(*[F.lit(x) for kv in dims.MODULES.items() for x in kv])
    return required.withColumn("alias", F.coalesce(alias[F.col(name)], F.col(name)))
