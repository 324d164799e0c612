"""More registered queries: the rest of the operator inventory, one or a few operators each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..engine import lines_around, review_order
from ..functions import scalars as S
from ..operators import findings as FI
from ..operators import match as MA
from ..operators import select as SE
from ..operators import summary as SU
from ..sources import artifacts as A
from ..sources import dims
from .text_queries import _CAT, _FNV, _WORST, F_SQL, _findings, lit, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ A: inputs


@query("WITH m(source, floor) AS (VALUES ('src0', 5), ('src1', 1000000), ('nowhere', 1)) SELECT m.source, count(d.doc_id) AS n, count(d.doc_id) >= min(floor) AS ok FROM m LEFT JOIN documents d ON d.source = m.source GROUP BY m.source")
def a_manifest_check(spark, sf_dir):
    """Every manifest entry with its count, and whether it reaches its floor."""
    m = spark.createDataFrame([("src0", 5), ("src1", 1_000_000), ("nowhere", 1)], "source string, floor long")
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return A.manifest_check(m, counted, "source")


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"WITH f AS (SELECT {_HOST} AS root, url AS path FROM pages), c AS (SELECT root, count(*) AS n FROM f GROUP BY root) SELECT root, least(n, 3) AS n_kept, n > 3 AS over FROM c")
def a_walk_limit(spark, sf_dir):
    """Listings of each root up to a bound, the roots beyond it told."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("root"), F.col("url").alias("path"))
    kept, over = A.limited(files, 3)
    return kept.groupBy("root").agg(F.count("*").alias("n_kept")).join(over.select("root", F.lit(True).alias("o")), "root", "left").select("root", "n_kept", F.coalesce("o", F.lit(False)).alias("over"))


@query("SELECT 'r' || (page_id % 3) AS root, count(*) AS n, min('/l' || page_id) AS first FROM pages WHERE page_id % 4 <> 0 GROUP BY 1")
def a_dangling_links(spark, sf_dir):
    """Links that lead nowhere, counted a root, runtime targets aside."""
    n = F.col("page_id").cast("string")
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("root"), F.concat(F.lit("/l"), n).alias("path"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/proc/"), n)).otherwise(F.concat(F.lit("/gone/"), n)).alias("target"))
    return A.dangling(links)


@query(f"SELECT page_id FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id % 50 = 0)")
def a_changed_scope(spark, sf_dir):
    """Artifacts that a table of changed paths names."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("path"))
    return A.changed(p, p.where("page_id % 50 = 0").select("path")).select("page_id")


@query("SELECT page_id, page_id % 5 IN (0, 3) AS is_source FROM pages")
def b_source_test(spark, sf_dir):
    """Which artifacts are source by name, extension, first line or opener."""
    k = F.col("page_id") % 5
    path = F.when(k == 0, "x/a.lua").when(k == 1, "x/a.js").when(k == 2, "README").otherwise("x/run")
    body = F.when(k == 3, "#!/usr/bin/env lua5.1\nprint(1)").otherwise("plain text")
    return table(spark, sf_dir, "pages").select("page_id", A.is_source(path, body).alias("is_source"))


@query("SELECT page_id, ['bytecode', 'elf', 'zip', 'binary', NULL][page_id % 5 + 1] AS kind FROM pages")
def b_binary_kinds(spark, sf_dir):
    """Kinds by leading bytes."""
    raw = F.element_at(F.array(*[F.lit(h) for h in ("1b4c756154", "7f454c460101", "504b030400", "610062", "6c6f63616c")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", A.binary_kind(F.unhex(raw)).alias("kind"))


@query("WITH e(code, name) AS (VALUES ('801', 'lua 5.4'), ('802', 'os.execute')) SELECT page_id, code, name FROM pages, e WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '805', 'unknown version' FROM pages WHERE page_id % 2 = 1")
def b_bytecode_triage(spark, sf_dir):
    """Headers decoded, sinks found in neighbouring constants, unreadable chunks told."""
    good = b"\x1bLua\x54\x00\x19\x93\r\n\x1a\n\x04\x08\x08" + (0x5678).to_bytes(8, "little") + bytes.fromhex("0000000000287740") + b"\x04execute\x00\x04os\x00\x00os.\x00"
    good = good.replace(b"\x04os\x00\x00os.\x00", b"\x00os.execute\x00")
    raw = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit(good.hex()))).otherwise(F.unhex(F.lit("1b4c756160")))
    art = table(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact_id"), F.col("url").alias("path"), raw.alias("raw"))
    return A.triage(art, ["os.execute", "io.popen"]).select(F.col("artifact_id").alias("page_id"), "code", "name")


# ------------------------------------------------------------------ D, E


_CODES = ", ".join(f"({lit(c)}, {lit(s)}, {lit(m)})" for c, s, _, _, m in dims.CODES)


@query(f"WITH c(code, severity, template) AS (VALUES {_CODES}) SELECT code, replace(template, '{{name}}', 'x') AS message, regexp_replace(template, '\\s*\\(\\{{\\w+\\}}\\)|\\s*\\{{\\w+\\}}', '', 'g') AS meaning, {_CAT} AS category, {_WORST} AS rank FROM c")
def d_catalogue(spark, sf_dir):
    """The rule catalogue with messages, meanings, families and ranks."""
    return dims.codes(spark).select("code", S.render_message(F.col("template"), name=F.lit("x")).alias("message"), S.meaning(F.col("template")).alias("meaning"), S.category(F.col("code")).alias("category"), S.severity_rank(F.col("severity")).alias("rank"))


@query("SELECT event_id, ['r', 'w', 'a+', 'r+'][event_id % 4 + 1] AS mode, event_id % 4 <> 0 AS writes, event_id % 4 = 1 AS truncates, CAST(greatest(1, least(7, event_id % 10)) AS INTEGER) AS col, CASE WHEN event_id % 4 = 3 THEN '' ELSE ['medium', 'high', 'low'][event_id % 4 + 1] END AS lowered FROM events")
def d_modes_ranks(spark, sf_dir):
    """File modes, clamped columns, confidence steps."""
    k = (F.col("event_id") % 4).cast("int") + 1
    mode = F.element_at(F.array(*map(F.lit, ("r", "w", "a+", "r+"))), k)
    conf = F.element_at(F.array(*map(F.lit, ("high", "certain", "medium", "low"))), k)
    return table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), S.open_mode(mode)["write"].alias("writes"), S.open_mode(mode)["truncate"].alias("truncates"), S.clamp_column((F.col("event_id") % 10).cast("int"), F.lit(7)).alias("col"), S.confidence_down(conf).alias("lowered"))


@query("SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def d_html_escape(spark, sf_dir):
    """Every page's whole markup made text; none gives an empty text."""
    return table(spark, sf_dir, "pages").select("page_id", S.html_escape(F.coalesce("html", F.lit(""))).alias("safe"))


@query(f"WITH p AS (SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '.') AS path FROM pages), k(key) AS (VALUES ('en'), ('fr'), ('en.1')) SELECT page_id, arg_max(key, length(key)) AS key FROM p JOIN k ON path = key OR starts_with(path, key || '.') GROUP BY page_id")
def e_longest_prefix(spark, sf_dir):
    """The longest declared name at a dot, by equi-join on the name's heads."""
    p = table(spark, sf_dir, "pages").select("page_id", F.array_join(S.segments(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)), ".").alias("path"))
    return MA.longest_prefix(p, spark.createDataFrame([("en",), ("fr",), ("en.1",)], "key string")).select("page_id", "key")


@query("SELECT event_id, ['json', 'luci.util', 'my.mod'][event_id % 3 + 1] AS alias FROM events")
def e_module_names(spark, sf_dir):
    """What required modules are called."""
    mod = F.element_at(F.array(*map(F.lit, ("luci.json", "luci.util", "my.mod"))), (F.col("event_id") % 3 + 1).cast("int"))
    return MA.module_names(table(spark, sf_dir, "events").select("event_id", mod.alias("module"))).select("event_id", "alias")


# ------------------------------------------------------------------ K, L: selection and order


@query(f"WITH {F_SQL} SELECT doc_id, code, name FROM findings WHERE file LIKE 'src1/%' OR file LIKE 'src2/%'")
def k_scope(spark, sf_dir):
    """Findings under given roots."""
    return SE.in_scope(_findings(spark, sf_dir), ["src1", "src2/"]).select("doc_id", "code", "name")


@query(f"WITH {F_SQL} SELECT doc_id, code, name, CASE code WHEN '750' THEN 'low' ELSE severity END AS severity FROM findings")
def k_severity_override(spark, sf_dir):
    """Severities overridden by code, ahead of any filter."""
    raw = _findings(spark, sf_dir).drop("severity", "cwe", "message")
    return FI.with_catalogue(raw, {"750": "low"}).select("doc_id", "code", "name", "severity")


@query(f"WITH {F_SQL} SELECT origin, count(*) FILTER (WHERE code IN ('901', '904')) AS gaps, count(*) FILTER (WHERE confidence = 'certain') AS selected FROM findings GROUP BY origin")
def k_gap_count(spark, sf_dir):
    """Gaps counted before the filter, findings after it, in one pass."""
    return SU.gap_count(_findings(spark, sf_dir), ["origin"])


@query(f"WITH {F_SQL} SELECT doc_id, code, name, row_number() OVER (ORDER BY 4 - {_WORST}, code, {_FNV('''(code || ':' || name || ':' || file)''')}, file, line, col, message) AS place FROM findings")
def l_envelope_order(spark, sf_dir):
    """Each finding's place in the JSON report."""
    f = _findings(spark, sf_dir)
    f = f.withColumn("fingerprint", FI.fingerprint(f))
    # a place in one report needs one order over its findings, which are few beside the corpus
    w = Window.orderBy(4 - S.severity_rank(F.col("severity")), "code", "fingerprint", "file", "line", "column", "message")
    return f.select("doc_id", "code", "name", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {F_SQL} SELECT doc_id, code, name, {_CAT} AS category FROM findings")
def l_review_order(spark, sf_dir):
    """By family, worst first, then place."""
    return review_order(_findings(spark, sf_dir)).select("doc_id", "code", "name", S.category(F.col("code")).alias("category"))


@query(f"""
  WITH {F_SQL}, w AS (SELECT DISTINCT doc_id, line, line + d AS pos FROM findings, (VALUES (-2), (-1), (0), (1), (2)) t(d)), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
  SELECT doc_id, line, CAST(pos AS INTEGER) AS "at", md5(ls[pos]) AS text FROM w JOIN l USING (doc_id) WHERE pos BETWEEN 1 AND len(ls)""")
def l_code_frames(spark, sf_dir):
    """The lines around every finding, by equi-join on the file and line."""
    docs = table(spark, sf_dir, "documents")
    art = docs.select(FI.file_of(docs).alias("path"), F.col("text").alias("body"))
    got = lines_around(_findings(spark, sf_dir), art)
    return got.select(F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), "line", "at", F.md5(F.col("text").cast("binary")).alias("text")).distinct()


# ------------------------------------------------------------------ M to O


@query(f"WITH {F_SQL} SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def m_html_groups(spark, sf_dir):
    """Counts of the severity groups of the HTML report."""
    return SU.html_rows(_findings(spark, sf_dir)).select("severity", "n").distinct()


@query(f"WITH {F_SQL} SELECT coalesce(origin, 'all') AS origin, coalesce(code, 'all') AS code, count(*) AS n FROM findings GROUP BY CUBE (origin, code)")
def m_cube(spark, sf_dir):
    """2.R: findings by source and rule with all subtotals."""
    return _findings(spark, sf_dir).cube("origin", "code").agg(F.count("*").alias("n")).select(F.coalesce("origin", F.lit("all")).alias("origin"), F.coalesce("code", F.lit("all")).alias("code"), "n")


@query(f"WITH {F_SQL} SELECT doc_id, code, name FROM findings UNION ALL SELECT page_id, '901', 'unreadable' FROM pages WHERE page_id % 10 = 0")
def n_union(spark, sf_dir):
    """Finding streams of different columns in one."""
    gaps = table(spark, sf_dir, "pages").where("page_id % 10 = 0").select(F.col("page_id").alias("doc_id"), F.lit("901").alias("code"), F.lit("unreadable").alias("name"))
    return _findings(spark, sf_dir).unionByName(gaps, allowMissingColumns=True).select("doc_id", "code", "name")


_PACK = ", ".join(f"({lit(s)}, {lit(a)})" for s, p in dims.SIGNATURES for a in p.split("|"))


@query(f"SELECT sig_id, alt FROM (VALUES {_PACK}) t(sig_id, alt) WHERE sig_id = 'miner-stratum-pool'")
def n_pack_drift(spark, sf_dir):
    """Alternatives that only one of two packs has, both ways."""
    full = dims.signatures(spark)
    other = dims.signatures(spark, [s for s in dims.SIGNATURES if s[0] != "miner-stratum-pool"])
    return dims.pack_drift(full, other)


def _traces(lines):
    step = lambda k, n: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("line"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"))
    t = FI.normalise_trace(F.array(step("sink", 9), step("step", 2), step("source", 1), step("step", 3)), F.lit("f.lua"))
    return lines.select("l_orderkey", "l_linenumber", F.array_join(F.transform(t, lambda s: s["kind"]), ",").alias("kinds"), F.element_at(t, -1)["file"].alias("sink_file"))


@query("SELECT l_orderkey, l_linenumber, 'source,step,step,sink' AS kinds, 'f.lua' AS sink_file FROM lineitem")
def o_trace(spark, sf_dir):
    """Traces in contract order with missing files filled in, one for every line of an order (``lua_traces`` has real ones)."""
    return _traces(table(spark, sf_dir, "lineitem"))


@query(f"WITH {F_SQL}, r(code, remedy) AS (VALUES ('747', 'Read the credential at run time.')) SELECT doc_id, f.code, name, r.remedy, CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'none' END AS kind FROM findings f LEFT JOIN r ON r.code = f.code")
def o_remedies(spark, sf_dir):
    """Remedies by code, and a location only where the file can be opened."""
    remedies = spark.createDataFrame([("747", "Read the credential at run time.")], "code string, remedy string")
    opened = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    return SU.with_remedies(_findings(spark, sf_dir), remedies, opened, "doc_id").select("doc_id", "code", "name", "remedy", "kind")


@query(f"""WITH {F_SQL} SELECT 'severity' AS section, severity AS name, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'confidence', confidence, count(*) FROM findings GROUP BY confidence
  UNION ALL SELECT 'category', {_CAT}, count(*) FROM findings GROUP BY {_CAT} UNION ALL SELECT 'code', code, count(*) FROM findings GROUP BY code UNION ALL SELECT 'files', 'all', count(DISTINCT file) FROM findings""")
def o_digest(spark, sf_dir):
    """The digest of a report in one pass over its findings."""
    return SU.digest(_findings(spark, sf_dir))


@query()
def o_sarif(spark, sf_dir):
    """The whole SARIF log in rows; its parts are compared in ``o_sarif_levels`` and tests."""
    f = FI.normalise(_findings(spark, sf_dir))
    return SU.sarif(f.withColumn("fingerprint", FI.fingerprint(f)))


@query()
def o_envelope_rows(spark, sf_dir):
    """The whole JSON report in rows, in contract order; tests read it back."""
    f = FI.normalise(_findings(spark, sf_dir))
    return SU.envelope(f.withColumn("fingerprint", FI.fingerprint(f)))


@query(f"WITH {F_SQL} SELECT file, code, line, col AS \"column\" FROM (SELECT DISTINCT file, code, line, col, message FROM findings)")
def l_file_order(spark, sf_dir):
    """The findings of each file by line, column and code."""
    return FI.file_order(FI.normalise(_findings(spark, sf_dir))).select("file", "code", "line", "column")


@query("SELECT epoch_ms(CAST(floor(epoch(ts) / 300) * 300000 AS BIGINT)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t_stream_counts(spark, sf_dir):
    """2.R: the events as a stream, counted by type and window behind a watermark."""
    from ..streaming.scan import windowed_counts

    schema = table(spark, sf_dir, "events").schema
    name = f"counts_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
