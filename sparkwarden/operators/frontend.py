"""Lua sources to relations: one Arrow pass, then plain tables.

``facts`` parses each artifact once and stores the result; every relation is a
column-pruned explode of it, keyed by ``artifact_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lua_facts, lua_syntax
from .flow import stored

MAX_RAW = 50


def facts(artifacts: DataFrame, max_nodes: int = lua_facts.MAX_NODES, session: SparkSession | None = None) -> DataFrame:
    """One row of ``lua_facts.SCHEMA`` per artifact of ``artifact_id, path, body``, read by ``session``; null bodies are empty chunks."""
    columns = [c.split()[0].split(":")[0] for c in lua_facts.SCHEMA.replace("<", " ").split(", ")]
    columns = [c for c in ("artifact_id path status message line node_count nesting calls args edges functions formals reads strings binds spots handlers routes names comments").split() if c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [lua_facts.extract(i, p, b if isinstance(b, str) else "", max_nodes) for i, p, b in zip(pdf["artifact_id"], pdf["path"], pdf["body"])]
            yield pd.DataFrame(rows, columns=columns)

    return stored(artifacts.select("artifact_id", "path", "body").mapInPandas(run, lua_facts.SCHEMA), "facts", session)


def relation(found: DataFrame, name: str) -> DataFrame:
    """``artifact_id, path`` and the columns of one relation; reads only that column of the store."""
    return found.select("artifact_id", F.col("path").alias("file"), F.explode(name).alias("_r")).select("artifact_id", "file", "_r.*")


def tokens(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, tok_no, kind, value, line, col`` of any text, parsable or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, body in zip(pdf["artifact_id"], pdf["body"]):
                for n, t in enumerate(lua_syntax.tokenize(body if isinstance(body, str) else "")[0]):
                    rows.append((i, n, t.kind, t.value, t.line, t.col))
            yield pd.DataFrame(rows, columns=["artifact_id", "tok_no", "kind", "value", "line", "col"])

    return artifacts.select("artifact_id", "body").mapInPandas(run, "artifact_id long, tok_no int, kind string, value string, line int, col int")


def raw_hits(toks: DataFrame, callees: dict[str, str], most: int = MAX_RAW) -> DataFrame:
    """Calls of known names in a token stream whose first argument is not literal.

    The dotted name is rebuilt from five neighbours by one window; a literal
    argument is a single string or number before the closing bracket.  Beyond
    ``most`` hits of an artifact a 901 row tells so.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("artifact_id").orderBy("tok_no")
    v = lambda i: F.lead("value", i).over(w) if i > 0 else F.lag("value", -i).over(w) if i < 0 else F.col("value")
    k = lambda i: F.lead("kind", i).over(w) if i > 0 else F.lag("kind", -i).over(w)
    near = toks.select("*", v(-1).alias("p1"), v(-2).alias("p2"), v(1).alias("n1"), k(1).alias("k1"), v(2).alias("n2"), k(2).alias("k2"), v(3).alias("n3"))
    name = F.when(F.col("p1") == ".", F.concat("p2", F.lit("."), "value")).otherwise(F.col("value"))
    named = near.where((F.col("kind") == "name") & ((F.col("n1") == "(") | (F.col("k1") == "string"))).withColumn("name", name)
    code = F.create_map(*[F.lit(x) for kv in callees.items() for x in kv])
    literal = (F.col("k1") == "string") | (F.col("k2").isin("string", "number") & (F.col("n3") == ")")) | (F.col("n2") == ")")
    hits = named.withColumn("code", code[F.col("name")]).where(F.col("code").isNotNull() & ~literal)
    hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("tok_no")))
    kept = hits.where(F.col("_n") <= most).select("artifact_id", "code", "name", "line", "col")
    over = hits.where(F.col("_n") == most + 1).select("artifact_id", F.lit("901").alias("code"), F.lit("truncated").alias("name"), "line", "col")
    return kept.unionByName(over)


def directives(found: DataFrame, marker: str = "sparkwarden:") -> DataFrame:
    """``file, line, action, pattern, push`` from comments; unreadable ones have action ``unreadable``."""
    text = F.trim(F.col("text"))
    body = relation(found, "comments").where(text.startswith(marker)).select("artifact_id", "file", "line", F.trim(F.substring(text, F.lit(len(marker) + 1), F.length("text"))).alias("b"))
    action = F.regexp_extract("b", r"^(\w+)", 1)
    push = F.col("b").contains("[push]")
    rest = F.trim(F.regexp_replace(F.regexp_replace("b", r"^\w+", ""), r"\[push\]", ""))
    parts = body.select("artifact_id", "file", "line", F.when(action.isin("ignore", "enable", "only", "push", "pop"), action).otherwise("unreadable").alias("action"), push.alias("push"), F.split(rest, r"\s*,\s*").alias("p"))
    return parts.select("artifact_id", "file", "line", "action", "push", F.explode("p").alias("pattern")).withColumn("pattern", F.concat(F.lit("^"), F.replace("pattern", F.lit("*"), F.lit(".*")), F.lit("$")))
