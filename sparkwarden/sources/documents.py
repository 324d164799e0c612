"""Configuration and baseline documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITIES
from . import dims

CONFIG_KEYS = {"std": list, "fail_on": str, "disable": list, "severity": dict, "allow": list}
REPORT_SCHEMA = "report/1"
FINDING = "struct<id:string,fingerprint:string,severity:string,confidence:string,category:string,message:string,location:struct<kind:string,ref:string,line:int,column:int>>"


class DocumentError(ValueError):
    """A document that cannot be used; raised before any work starts."""


def config(text: str) -> dict:
    """Literal JSON settings, checked; nothing in them is run."""
    try:
        out = json.loads(text)
    except json.JSONDecodeError as e:
        raise DocumentError(f"not JSON: {e}") from None
    if not isinstance(out, dict) or set(out) - set(CONFIG_KEYS):
        raise DocumentError(f"unknown setting: {', '.join(sorted(set(out) - set(CONFIG_KEYS))) if isinstance(out, dict) else out!r}")
    for key, value in out.items():
        if not isinstance(value, CONFIG_KEYS[key]):
            raise DocumentError(f"{key} has the wrong type")
    known = {c[0] for c in dims.CODES}
    for code, level in out.get("severity", {}).items():
        if code not in known or level not in SEVERITIES:
            raise DocumentError(f"severity of {code!r}")
    if out.get("fail_on", "low") not in SEVERITIES:
        raise DocumentError(f"fail_on {out['fail_on']!r}")
    for p in out.get("std", []):
        if p not in dims.PROFILES:
            raise DocumentError(f"unknown profile {p!r}")
    for entry in out.get("allow", []):
        if not isinstance(entry, dict) or not {"code", "file", "reason"} <= set(entry) or not entry["reason"]:
            raise DocumentError("an allow entry needs code, file and reason")
    return out


def allow_entries(spark: SparkSession, settings: dict) -> DataFrame:
    """``entry_no, code, file`` of the allow list."""
    rows = [(i, e["code"], e["file"]) for i, e in enumerate(settings.get("allow", []))]
    return spark.createDataFrame(rows, "entry_no int, code string, file string")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """``fingerprint, code, name, file, ...`` of an earlier report; its schema and fingerprints are checked."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema string, findings array<{FINDING}>", {"mode": "FAILFAST"}).alias("d"))
    bad = docs.where(F.coalesce(F.col("d.schema"), F.lit("")) != REPORT_SCHEMA).limit(1).count()
    out = docs.select(F.explode("d.findings").alias("f")).select(F.col("f.fingerprint"), F.col("f.id").alias("code"), F.col("f.severity"), F.col("f.confidence"), F.col("f.message"), F.col("f.location.ref").alias("file"), F.col("f.location.line").alias("line"), F.col("f.location.column").alias("column"))
    if bad or out.where(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-fA-F]{16}$"), F.lit(False))).limit(1).count():
        raise DocumentError("not a baseline: wrong schema or fingerprint")
    return out
