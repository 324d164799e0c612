"""Aggregations, diffs and renderings of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import dims


def penalty(severity: Column, confidence: Column) -> Column:
    """M01 in tenths of a point: 25, 10, 4, 1 by severity times 1.0, 1.0, 0.6, 0.3 by confidence (E-7)."""
    weight = F.when(severity == "critical", 25).when(severity == "high", 10).when(severity == "medium", 4).when(severity == "low", 1).otherwise(0)
    return weight * F.when(confidence == "medium", 6).when(confidence == "low", 3).otherwise(10)


def score(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """``value, label, coverage_gaps`` and a count of each category; fixed findings cost nothing."""
    live = F.coalesce(F.col("status") != "fixed", F.lit(True))
    code = F.col("code")
    out = findings.where(live).groupBy(*by).agg(
        F.coalesce(F.sum(penalty(F.col("severity"), F.col("confidence"))), F.lit(0)).alias("_p"),
        F.count(F.when(code.isin(*dims.DEGRADED), 1)).alias("coverage_gaps"),
        *[F.count(F.when(S.category(code) == c, 1)).alias(c) for c in dims.CATEGORIES],
    )
    value = F.greatest(F.lit(0), F.floor((1000 - F.col("_p")) / 10)).cast("int")
    return out.withColumn("value", value).withColumn("label", S.score_label(value, F.col("coverage_gaps"))).drop("_p")


def tally(findings: DataFrame, column: str, ladder: tuple[str, ...]) -> DataFrame:
    """One line ``name n, ...`` from the highest rung down, rungs with findings only."""
    counted = findings.groupBy(column).agg(F.count("*").alias("n")).where(F.col(column).isin(*ladder))
    rank = F.array_position(F.array(*map(F.lit, reversed(ladder))), F.col(column))
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat_ws(" ", column, F.col("n").cast("string")).alias("s"))))
    return counted.agg(F.array_join(F.transform(parts, lambda x: x["s"]), ", ").alias("tally"))


def group_places(findings: DataFrame, groups: int = 6, places: int = 3) -> DataFrame:
    """The worst groups by code, each with its first distinct places and hidden counts."""
    rank = S.severity_rank(F.col("severity"))
    spots = findings.select("code", "file", "line", rank.alias("_rank")).groupBy("code", "file", "line").agg(F.max("_rank").alias("_rank"))
    sizes = findings.groupBy("code").agg(F.max(rank).alias("worst"), F.count("*").alias("size"))
    distinct = spots.groupBy("code").agg(F.count("*").alias("n_places"))
    top = sizes.join(distinct, "code").orderBy(F.desc("worst"), F.desc("size"), "code").limit(groups)
    nth = Window.partitionBy("code").orderBy("file", "line")
    shown = spots.join(F.broadcast(top), "code").withColumn("place_no", F.row_number().over(nth)).where(F.col("place_no") <= places)
    return shown.select("code", "worst", "size", "place_no", "file", "line", F.greatest(F.lit(0), F.col("n_places") - places).cast("long").alias("hidden"))


def top_files(findings: DataFrame, n: int = 10) -> DataFrame:
    """Files with most findings, ties by name."""
    return findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(n)


def counts(findings: DataFrame, by: str = "code") -> DataFrame:
    """Findings and distinct files of each code."""
    return findings.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


def digest(findings: DataFrame) -> DataFrame:
    """``section, name, n``: findings by severity, confidence, category and code, and how many files have any."""
    views = {"severity": F.col("severity"), "confidence": F.col("confidence"), "category": S.category(F.col("code")), "code": F.col("code")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("name")) for k, v in views.items()]))
    out = findings.select(each.alias("e")).groupBy("e.section", "e.name").agg(F.count("*").alias("n"))
    return out.unionByName(findings.agg(F.countDistinct("file").alias("n")).select(F.lit("files").alias("section"), F.lit("all").alias("name"), "n"))


def gap_count(findings: DataFrame, by: list[str], floor: str = "certain") -> DataFrame:
    """Gaps counted before the confidence floor, findings after it, in one pass."""
    kept = S.confidence_rank(F.col("confidence")) >= S.CONFIDENCES.index(floor) + 1
    return findings.groupBy(*by).agg(F.count(F.when(F.col("code").isin(*dims.DEGRADED), 1)).alias("gaps"), F.count(F.when(kept, 1)).alias("selected"))


def with_remedies(findings: DataFrame, remedies: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """The remedy of each code, and location kind ``file`` only where ``opened`` has the artifact."""
    out = findings.join(F.broadcast(remedies), "code", "left").join(opened.select(key, F.lit("file").alias("kind")).distinct(), key, "left")
    return out.withColumn("kind", F.coalesce("kind", F.lit("none")))


def worst_and_common(findings: DataFrame, by: list[str]) -> DataFrame:
    """Worst severity, and commonest confidence with ties to the smaller name."""
    worst = findings.groupBy(*by).agg(F.max_by("severity", S.severity_rank(F.col("severity"))).alias("worst"))
    counted = findings.groupBy(*by, "confidence").agg(F.count("*").alias("n"))
    common = counted.groupBy(*by).agg(F.min_by("confidence", F.struct(-F.col("n"), F.col("confidence"))).alias("common"))
    return worst.join(common, by)


def exit_code(findings: DataFrame, by: list[str], fail_on: str = "low") -> DataFrame:
    """M08 without a baseline: 1 for a gap or a finding at the threshold, else 0."""
    bad = F.col("code").isin(*dims.DEGRADED) | (S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(fail_on))
    return findings.groupBy(*by).agg(F.max(F.when(bad, 1).otherwise(0)).alias("exit_code"))


def exit_code_baseline(compared: DataFrame, fail_on: str = "low") -> DataFrame:
    """M08 with a baseline: 3 for a new finding at the threshold, else 1 for a gap, else 0 (E-11)."""
    new = (F.col("baseline_state") == "new") & ~F.col("code").isin(*dims.DEGRADED) & (S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(fail_on))
    gap = F.col("code").isin(*dims.DEGRADED) & (F.col("baseline_state") != "fixed")
    return compared.agg(F.when(F.max(F.when(new, 1).otherwise(0)) == 1, 3).when(F.max(F.when(gap, 1).otherwise(0)) == 1, 1).otherwise(0).alias("exit_code"))


def verdict(records: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """Exec, process, stop, any, failed, none become rce, escape, timeout, partial, error, benign."""
    has = lambda k: F.max(F.when(F.col(kind) == k, 1).otherwise(0)) == 1
    n = F.count(F.when(F.col(kind).isin("exec", "process", "file", "net"), 1))
    out = F.when(has("exec"), "rce").when(has("process"), "escape").when(has("stop"), "timeout").when(n > 0, "partial").when(has("failed"), "error").otherwise("benign")
    return records.groupBy(*by).agg(out.alias("verdict"), n.alias("sinks_reached"))


def baseline_diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """``baseline_state`` of current findings, and fixed ones from the baseline once each (E-8 to E-10).

    Both have ``fingerprint`` and ``code``.  Gaps are always new.
    """
    base = known.groupBy("fingerprint").agg(F.lit(True).alias("_known"))
    state = F.when(F.col("code").isin(*dims.DEGRADED), "new").when(F.col("_known").isNull(), "new").otherwise("unchanged")
    here = current.join(base, "fingerprint", "left").withColumn("baseline_state", state).drop("_known")
    gone = known.join(current.select("fingerprint").distinct(), "fingerprint", "left_anti").where(~F.col("code").isin(*dims.DEGRADED))
    first = Window.partitionBy("fingerprint").orderBy(*[c for c in gone.columns if c != "fingerprint"])
    gone = gone.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("baseline_state", F.lit("fixed"))
    return here.unionByName(gone, allowMissingColumns=True)


def symmetric_difference(measured: DataFrame, golden: DataFrame) -> DataFrame:
    """Codes whose counts differ between a run and the golden table."""
    both = measured.withColumnRenamed("n", "measured").join(golden.withColumnRenamed("n", "golden"), "code", "full_outer")
    return both.select("code", F.coalesce("measured", F.lit(0)).alias("measured"), F.coalesce("golden", F.lit(0)).alias("golden")).where("measured <> golden")


LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def level(severity: Column) -> Column:
    """The SARIF level of a severity."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), severity), F.lit("none"))


def _item() -> Column:
    return F.struct(
        F.col("code").alias("id"), "fingerprint", "severity", "confidence", S.category(F.col("code")).alias("category"), "message",
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("ref"), "line", "column").alias("location"),
    )


def _result(findings: DataFrame) -> Column:
    """One SARIF result; a finding with a trace has a code flow, a compared one its baseline state."""
    place = lambda file, line, *more: F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine"), *more).alias("region"))
    parts = [
        F.col("code").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(place(F.col("file"), F.col("line"), F.col("column").alias("startColumn")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary/v1")).alias("fingerprints"),
    ]
    if "trace" in findings.columns:
        step = lambda s: F.struct(F.struct(place(s["file"], s["line"]).alias("physicalLocation"), F.struct(F.concat_ws(" ", s["kind"], s["name"]).alias("text")).alias("message")).alias("location"))
        flow = F.array(F.struct(F.array(F.struct(F.transform("trace", step).alias("locations"))).alias("threadFlows")))
        parts.append(F.when(F.col("trace").isNotNull(), flow).alias("codeFlows"))
    if "baseline_state" in findings.columns:
        parts.append(F.when(F.col("baseline_state") == "fixed", "absent").otherwise(F.col("baseline_state")).alias("baselineState"))
    return F.struct(*parts)


def _fragments(findings: DataFrame, head: DataFrame, item: Column, tail: str, order: list) -> DataFrame:
    """``part, json``: a head, each finding's text behind a comma, a tail; in report order, one after the other they are one document.

    Rows are sorted across tasks, so no task holds the report.
    """
    first = findings.select(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("first"))
    rows = findings.select(F.lit(1).alias("part"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("at"), F.to_json(item).alias("json"))
    rows = rows.join(F.broadcast(first)).withColumn("json", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), "json")).drop("first")
    ends = head.select(F.lit(0).alias("part"), "json").unionByName(head.sparkSession.createDataFrame([(2, tail)], "part int, json string"))
    return rows.unionByName(ends, allowMissingColumns=True).orderBy("part", "at").select("part", "json")


def _unique(order: list) -> list:
    return [*order, F.col("file"), F.col("line"), F.col("column"), F.col("message"), F.col("name"), F.col("source"), F.coalesce("status", F.lit(""))]


def envelope(findings: DataFrame) -> DataFrame:
    """The JSON report over normalised findings as ``part, json`` rows in contract order: schema and score, the findings, the end."""
    scored = score(findings).select(F.to_json(F.struct(F.lit("report/1").alias("schema"), F.struct("value", "label", "coverage_gaps").alias("score"))).alias("j"))
    head = scored.select(F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"findings":[')).alias("json"))
    return _fragments(findings, head, _item(), "]}", _unique([4 - S.severity_rank(F.col("severity")), F.col("code"), F.col("fingerprint")]))


def sarif(findings: DataFrame, tool: str = "sparkwarden") -> DataFrame:
    """The SARIF 2.1.0 log over normalised findings as ``part, json`` rows: the tool and its rules, the results, the end."""
    rules = F.array_sort(F.collect_set(F.struct(F.col("code").alias("id"))))  # at most the catalogue's codes
    head = findings.agg(F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver"))).alias("t"))
    head = head.select(F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":'), "t", F.lit(',"results":[')).alias("json"))
    return _fragments(findings, head, _result(findings), "]}]}", _unique([F.col("code")]))


def envelopes(findings: DataFrame, by: list[str]) -> DataFrame:
    """O03 by group: ``by, json`` of groups of bounded size, such as the findings of one file."""
    rank = (4 - S.severity_rank(F.col("severity"))).alias("rank")
    listed = findings.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(rank, _item().alias("item")))).alias("findings"))
    out = listed.join(score(findings, by).select(*by, F.struct("value", "label", "coverage_gaps").alias("score")), by)
    return out.select(*by, F.to_json(F.struct(F.lit("report/1").alias("schema"), "score", F.transform("findings", lambda x: x["item"]).alias("findings"))).alias("json"))


def plain_lines(findings: DataFrame) -> DataFrame:
    """One text line per finding."""
    return findings.select(F.concat_ws("", "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(": "), "severity", F.lit(" "), "code", F.lit(" "), "message").alias("line_text"))


def html_rows(findings: DataFrame) -> DataFrame:
    """A table row per finding under its severity, with the severity's count."""
    counts = Window.partitionBy("severity")
    cell = lambda c: F.concat(F.lit("<td>"), S.html_escape(F.col(c).cast("string")), F.lit("</td>"))
    return findings.select("severity", F.count("*").over(counts).alias("n"), "file", "line", F.concat(F.lit("<tr>"), *[cell(c) for c in ("file", "line", "code", "message")], F.lit("</tr>")).alias("html"))
