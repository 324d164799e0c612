"""Findings: text detectors, normal form, order, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import dims

ORDER = ("file", "line", "column", "code", "name", "message")
DISTINCT_KEY = ("file", "code", "line", "column", "message", "source", "status")
# How a credential is assigned in text (fixed value): its name, then its value.
CREDENTIAL = r"(?i)\b(password|passwd|pwd|passphrase|secret|token|credential|psk|preshared|apikey|privkey)\s*[=:]\s*\"?([^\s\"#&$*%|]+)"


def quoted(alternatives: list[str]) -> str:
    return "|".join("".join("\\" + c if c in S.REGEX_SPECIAL else c for c in a) for a in alternatives)


def signature_hits(docs: DataFrame, pack: list, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key, keep, sig_id, position, line, column``: the first place of each signature in each text (J23, E-23).

    One pass of a quoted alternation drops texts without a hit; only the others
    meet the alternatives, which are a constant array of the plan.  Line and
    column are taken where the text is at hand, so no text is ever shuffled.
    """
    rows = [(s, a) for s, p in pack for a in p.split("|")]
    alts = F.array(*[F.struct(F.lit(s).alias("sig_id"), F.lit(a).alias("alt")) for s, a in rows])
    some = docs.where(F.col(text).rlike(quoted([a for _, a in rows])))
    found = some.select(key, *keep, F.col(text).alias("_t"), F.explode(alts).alias("s")).select(key, *keep, "_t", "s.sig_id", F.instr(F.col("_t"), F.col("s.alt")).alias("position"))
    found = found.where("position > 0").withColumn("p", F.struct(F.col("position").cast("int").alias("position"), S.line_of(F.col("_t"), F.col("position")).alias("line"), S.column_of(F.col("_t"), F.col("position")).alias("column")))
    return found.groupBy(key, *keep, "sig_id").agg(F.min("p").alias("p")).select(key, *keep, "sig_id", "p.*")


def credential_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key, keep, position, line, column, name, value``: every qualifying assignment of each text (J20, text form).

    Value rejects of the ladder apply: paths, URLs, numbers, all-caps words and
    placeholders are no credentials; four characters are the floor.  Positions
    add up the matches and the pieces between them.
    """
    t = F.col(text)
    some = docs.where(t.rlike(CREDENTIAL)).select(key, *keep, t.alias("_t"), F.regexp_extract_all(t, F.lit(CREDENTIAL), F.lit(0)).alias("_m"), F.split(t, CREDENTIAL, -1).alias("_s"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<m:string,position:int>>").alias("out"))

    def add(acc, x):
        at = acc["at"] + F.length(x["s"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), at.alias("position")))).alias("out"))

    pairs = F.zip_with(F.slice("_s", F.lit(1), F.size("_m")), "_m", lambda a, b: F.struct(a.alias("s"), b.alias("m")))
    each = some.select(key, *keep, "_t", F.explode(F.aggregate(pairs, start, add)["out"]).alias("_x"))
    each = each.select(key, *keep, "_t", F.col("_x.position").alias("position"), F.regexp_extract("_x.m", CREDENTIAL, 1).alias("name"), F.regexp_extract("_x.m", CREDENTIAL, 2).alias("value"))
    each = each.where((F.length("value") >= 4) & ~F.col("value").rlike(r"^/|://|^[0-9.]+$|^[A-Z_]+$|^<|\{|%[sd]"))
    return each.select(key, *keep, "position", S.line_of(F.col("_t"), F.col("position")).alias("line"), S.column_of(F.col("_t"), F.col("position")).alias("column"), "name", "value")


def pem_verdict(text: Column) -> Column:
    """A block with a body is a key, markers alone are silent, a bare body is told apart."""
    body = r"[A-Za-z0-9+/]{20,}"
    key = text.rlike(r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----\s+" + body)
    return F.when(key, "key").when(text.contains("-----BEGIN"), "marker").when(text.rlike("^" + body + "=*$"), "body").otherwise("none")


def redact(value: Column) -> Column:
    """First and last two characters around at most eight stars."""
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.least(F.lit(8), F.length(value) - 4)), F.substring(value, -2, 2))
    )


def file_of(docs: DataFrame) -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def text_findings(docs: DataFrame, pack: list | None = None, keep: list[str] = ()) -> DataFrame:
    """Raw findings of a document table: signatures (750) and credentials (747), with places.

    ``doc_id, keep, file, code, name, line, column, end_column, confidence, source, status``
    joined with the rule catalogue's severity, weakness class and message.
    """
    pack = dims.TEXT_SIGNATURES if pack is None else pack
    docs = docs.select("doc_id", "text", *keep, file_of(docs).alias("file"))
    same = ["doc_id", *keep, "file"]
    hits = signature_hits(docs, pack, keep=same[1:]).select(*same, F.lit("750").alias("code"), F.col("sig_id").alias("name"), F.lit("certain").alias("confidence"), "line", "column", F.lit(1).alias("width"))
    secrets = credential_hits(docs, keep=same[1:]).select(
        *same, F.lit("747").alias("code"), F.lower("name").alias("name"), F.when(F.length("value") >= 20, "high").otherwise("medium").alias("confidence"), "line", "column", F.length("value").alias("width"))
    placed = hits.unionByName(secrets)
    return with_catalogue(placed.withColumn("end_column", (F.col("column") + F.col("width") - 1).cast("int")).drop("width").withColumn("source", F.lit("")).withColumn("status", F.lit(None).cast("string")))


def with_catalogue(raw: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Severity (K06 overrides first), weakness class and rendered message."""
    catalogue = dims.codes(raw.sparkSession).withColumnRenamed("confidence", "_confidence")
    out = raw.join(F.broadcast(catalogue), "code", "left")  # 40 rows
    severity = F.col("severity")
    for code, level in (overrides or {}).items():
        severity = F.when(F.col("code") == code, F.lit(level)).otherwise(severity)
    out = out.withColumn("severity", severity).withColumn("message", S.render_message(F.col("template"), name=F.col("name")))
    return out.withColumn("confidence", F.coalesce("confidence", "_confidence")).drop("template", "_confidence")


def distinct(findings: DataFrame) -> DataFrame:
    """One finding per identity key; the survivor is the first in a total order."""
    rank = Window.partitionBy(*DISTINCT_KEY).orderBy("severity", "confidence", "name")
    return findings.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def file_order(findings: DataFrame) -> DataFrame:
    """Within each file by line, column and code."""
    return findings.orderBy("file", "line", "column", "code")


def report_order(findings: DataFrame) -> DataFrame:
    """No status first, then file, line, column, code, name, message."""
    return findings.orderBy(F.col("status").asc_nulls_first(), *ORDER)


def fingerprint(findings: DataFrame) -> Column:
    """D08 over ``code:name:file``."""
    return S.fnv1a64(F.concat_ws(":", "code", "name", "file"))


def normalise(findings: DataFrame) -> DataFrame:
    """The contract's columns, absent text as empty, distinct."""
    text = ("code", "severity", "confidence", "cwe", "message", "name", "source", "file")
    more = [c for c in ("origin", "trace", "enabled") if c in findings.columns]
    out = findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text], "line", "column", "end_column", "status", *more)
    return distinct(out)


def normalise_trace(trace: Column, sink_file: Column) -> Column:
    """Source steps, then others, the sink last; missing names and files filled in."""
    filled = F.transform(trace, lambda s: F.struct(s["kind"].alias("kind"), s["line"].alias("line"), F.coalesce(s["name"], F.lit("")).alias("name"), F.coalesce(s["file"], sink_file).alias("file")))
    return F.concat(*[F.filter(filled, t) for t in (lambda s: s["kind"] == "source", lambda s: ~s["kind"].isin("source", "sink"), lambda s: s["kind"] == "sink")])
