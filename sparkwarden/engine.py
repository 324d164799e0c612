"""Public interface: scan, score, compare, render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import findings as FI
from .operators import select as SE
from .operators import summary as SU
from .operators.lua_scan import Scan
from .sources import artifacts as A
from .sources import dims, documents

OPTIONS = {"ignore", "enable", "only", "categories", "severity", "confidence"}
FORMATS = ("json", "sarif", "plain", "html")


class Engine:
    """One set of rules over any number of artifact tables."""

    def __init__(self, spark: SparkSession, profiles: tuple[str, ...] = (), rules: dict | None = None, config: str | None = None, **options):
        """``options`` are those of a scan: ``detectors`` (P03) and ``progress``."""
        if set(options) - {"detectors", "progress"}:
            raise ValueError(f"unknown option: {', '.join(sorted(set(options) - {'detectors', 'progress'}))}")
        self.spark, self.options = spark, options
        self.settings = documents.config(config) if config else {}
        self.profiles = tuple(dict.fromkeys([*self.settings.get("std", []), *profiles]))
        self.rules = dims.validate(rules or {})
        for p in self.profiles:
            if p not in dims.PROFILES:
                raise dims.RegistryError(f"unknown profile {p!r}")

    def read(self, roots: list[str]) -> DataFrame:
        """``artifact_id, path, body, route`` of the files under the roots, templates extracted."""
        files = A.read(self.spark, roots).withColumn("body", A.strip_bom(F.decode("raw", "ISO-8859-1")))
        return A.extracted(files.withColumn("route", A.route(F.col("path"), F.col("raw"), F.col("body"))))

    def scan(self, artifacts: DataFrame) -> DataFrame:
        """Findings of ``artifact_id, path, body`` rows, in normal form, with fingerprints.

        With a ``route`` column, chunks of bytecode are triaged and unreadable
        files reported; without one every row is Lua source.
        """
        lua = artifacts.where(F.col("route").isin("analyze", "template", *(["conf"] if "openresty" in self.profiles else []))) if "route" in artifacts.columns else artifacts
        found = Scan(lua, self.profiles, self.rules, **self.options).findings()
        if "route" in artifacts.columns and "openresty" not in self.profiles:
            conf = artifacts.where("route = 'conf'")  # B10: server configurations bring their platform's registry
            if not conf.isEmpty():
                found = found.unionByName(Scan(conf, (*self.profiles, "openresty"), self.rules, **self.options).findings())
        if "route" in artifacts.columns:
            sinks = [s[1] for s in dims.SINKS if "*" not in s[1]]
            chunks = A.triage(artifacts.where("route = 'triage'"), sinks)
            lost = artifacts.where("route = 'unreadable'").select("artifact_id", "path", F.lit("901").alias("code"), F.when(F.col("raw").isNull(), "unreadable").otherwise("binary").alias("name"))
            extra = chunks.unionByName(lost).select(F.col("path").alias("file"), "code", "name", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(1).alias("end_column"), F.lit(None).cast("string").alias("confidence"), F.lit("").alias("source"), F.lit(None).cast("string").alias("status"))
            found = found.unionByName(FI.normalise(FI.with_catalogue(extra)), allowMissingColumns=True)
        return found.withColumn("fingerprint", FI.fingerprint(found))

    def select(self, findings: DataFrame, **options) -> DataFrame:
        """Severity overrides, the ladder, the allow list; unknown options fail at once."""
        if set(options) - OPTIONS:
            raise ValueError(f"unknown option: {', '.join(sorted(set(options) - OPTIONS))}")
        severity = F.col("severity")
        for code, level in self.settings.get("severity", {}).items():
            severity = F.when(F.col("code") == code, F.lit(level)).otherwise(severity)
        options["ignore"] = [*options.get("ignore", []), *self.settings.get("disable", [])]
        out = SE.ladder(findings.withColumn("severity", severity), **options)
        entries = documents.allow_entries(self.spark, self.settings)
        return SE.allow_list(out, entries)[0] if self.settings.get("allow") else out

    def score(self, findings: DataFrame, by: list[str] = ()) -> DataFrame:
        return SU.score(findings, by)

    def compare(self, findings: DataFrame, baseline: DataFrame) -> DataFrame:
        return SU.baseline_diff(findings, baseline)

    def rule_catalogue(self) -> DataFrame:
        return dims.codes(self.spark)

    def render(self, findings: DataFrame, form: str) -> DataFrame:
        """The report as ordered rows of text; written one after the other they are the document."""
        if form not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        if form == "json":
            return SU.envelope(findings)
        return {"sarif": SU.sarif, "plain": lambda f: SU.plain_lines(FI.report_order(f)), "html": SU.html_rows}[form](findings)


def lines_around(findings: DataFrame, artifacts: DataFrame, reach: int = 2) -> DataFrame:
    """The code frame of each finding: its line and those within ``reach``."""
    lines = artifacts.select(F.col("path").alias("file"), F.posexplode(F.split("body", "\n")).alias("n", "text")).withColumn("at", (F.col("n") + 1).cast("int"))
    wanted = findings.select("file", "line", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("at")).distinct()
    return wanted.join(lines, ["file", "at"]).select("file", "line", "at", "text")


def review_order(findings: DataFrame) -> DataFrame:
    """By category, worst first, then file and line."""
    from .functions import scalars as S

    order = F.array_position(F.array(*map(F.lit, dims.CATEGORIES)), S.category(F.col("code")))
    return findings.orderBy(order, F.desc(S.severity_rank(F.col("severity"))), "file", "line")
