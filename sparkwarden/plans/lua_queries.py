"""Registered queries over synthesised Lua sources, with the expected findings as SQL.

The driver's tables hold no Lua, so each document id picks one of a few small
programs; what a program must yield is a fixed table, and the SQL joins it on
the id.  Names and literals come from the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontend
from ..operators.lua_scan import Scan

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# Programs by family: (source with %d for the id, [(code, line, confidence, name), ...])
PROGRAMS: dict[str, list[tuple[str, list[tuple[str, int, str, str]]]]] = {
    "taint": [
        ('os.execute("ls -l")\n', []),
        ('local v%d = unknown\nos.execute(v%d)\n', [("701", 2, "low", "os.execute")]),
        ('local q%d = http.formvalue("x")\nos.execute("ls " .. q%d)\n', [("709", 2, "certain", "os.execute")]),
        ('local f = loadstring(http.formvalue("code"))\n', [("710", 1, "certain", "loadstring")]),
        ('local function run(c)\n  io.popen(c)\nend\nrun(os.getenv("X%d"))\n', [("709", 2, "medium", "io.popen")]),
        ('local function id(x) return x end\nlocal a = id(http.formvalue("q"))\nlocal b = id("safe%d")\nos.execute(a)\nos.execute(b)\n', [("709", 4, "certain", "os.execute"), ("701", 5, "low", "os.execute")]),
        ('local t = {cmd = http.formvalue("q"), n%d = 1}\nos.execute(t.cmd)\n', [("709", 2, "certain", "os.execute")]),
        ('local s = "a"\nfor k, v in pairs(http.formvalue("all")) do\n  s = s .. v\nend\nos.execute(s)\n', [("709", 5, "certain", "os.execute")]),
        ('local c = "ls"\nif x%d then c = http.formvalue("c") end\nos.execute(c)\n', [("709", 3, "certain", "os.execute")]),
        ('local h = io.open("/x%d")\nlocal d = h:read("*a")\nload(d:gsub("a", "b"))\n', [("710", 3, "medium", "load")]),
    ],
    "quote": [
        ('local u = require "luci.util"\nlocal q = luci.http.formvalue("x%d")\nos.execute(u.shellquote(q))\n', [("709", 3, "high", "os.execute")]),
        ('local u = require "luci.util"\nlocal q = luci.http.formvalue("x%d")\nos.execute(u.shellquote(q) .. q)\n', [("709", 3, "certain", "os.execute"), ("712", 3, "certain", "os.execute")]),
        ('luci.sys.call("reboot%d")\n', []),
    ],
    "shape": [
        ('require("mod%d")\n', []),
        ('local m = pick%d()\nrequire(m)\n', [("705", 2, "low", "require")]),
        ('local ffi = require("ffi")\nffi.cdef("int x%d;")\n', [("707", 2, "high", "ffi.cdef")]),
        ('function M%d(cmd)\n  os.execute(cmd)\nend\n', [("701", 2, "low", "os.execute"), ("708", 2, "low", "os.execute")]),
    ],
    "firmware": [
        ('local f = io.open("/etc/config/net%d", "w")\n', [("721", 1, "high", "/etc/config/net%d")]),
        ('local f = io.open("/etc/shadow")\n', [("723", 1, "medium", "/etc/shadow")]),
        ('os.remove("/usr/bin/x%d")\n', [("726", 1, "medium", "/usr/bin/x%d")]),
        ('setfenv(1, {})\nlocal v%d = 1\n', [("725", 1, "medium", "setfenv")]),
        ('local s = ""\nwhile true do\n  s = s .. "x%d"\nend\n', [("727", 2, "medium", "While")]),
        ('local n = string.find("a%d", http.formvalue("p"))\n', [("728", 1, "high", "string.find")]),
        ('local f = io.open("/tmp/x%d", "w")\n', []),
    ],
    "payload": [
        ('load(base64.decode("cHJpbnQ="))\nlocal v%d = 1\n', [("703", 1, "low", "load"), ("741", 1, "high", "load")]),
        ('debug.sethook(f%d, "l")\n', [("745", 1, "high", "debug.sethook")]),
        ('local b = string.char(144,144,144,144,144,144,144,144,144,144,144,144)\nlocal v%d = b\n', [("746", 1, "high", "nop-sled")]),
        ('local password = "hunter%d"\n', [("747", 1, "high", "password")]),
        ('while true do\n  c%d:connect(h)\n  c%d:receive()\n  c%d:send("root")\nend\n', [("748", 2, "medium", "connect")]),
        ('os.execute("echo x%d > /etc/rc.local")\n', [("749", 1, "high", "echo x%d > /etc/rc.local")]),
        ('local pool = "stratum+tcp://p%d"\n', [("750", 1, "certain", "miner-stratum-pool")]),
    ],
    "config": [
        ('local uci = require("luci.model.uci")\nlocal c = uci.cursor()\nc:set("system", "@system[0]", "host%d", luci.http.formvalue("h"))\n', [("722", 3, "certain", "uci:set")]),
        ('local c = require("uci").cursor()\nlocal v = luci.http.formvalue("v%d")\nc:section("firewall", "rule", nil, {src = v})\nc:tset("firewall", "cfg1", {dest = v})\n', [("722", 3, "certain", "uci:section"), ("722", 4, "certain", "uci:tset")]),
        ('local function open() return require("uci").cursor() end\nlocal c = open()\nc:set("a", "b", "c%d", luci.http.formvalue("x"))\n', [("722", 3, "certain", "uci:set")]),
        ('local c = require("uci").cursor()\nc:set("system", "@system[0]", "hostname", "router%d")\nc:section("firewall", "rule", nil, {src = "lan"})\n', []),
        ('local c = require("uci").cursor()\nlocal stamp = "t%d" .. tostring(os.time())\nc:set("system", "@system[0]", "note", stamp)\nc:section("firewall", "rule", nil, {name = stamp})\n', []),
        ('local db = open_database%d()\ndb:set("a", "b", "c", luci.http.formvalue("x"))\n', []),
        ('local c = require("uci").cursor()\nc:section("firewall", "rule%d", luci.http.formvalue("name"), {src = "lan"})\n', []),
        ('uci.set("network", "lan", "opt%d", luci.http.formvalue("p"))\n', [("722", 1, "medium", "uci.set")]),
        ('uci.set("network", "lan", value%d)\nuci.set("network", "lan", "proto", "static")\n', [("722", 1, "medium", "uci.set")]),
        ('local self = {}\nself.uci = require("uci").cursor()\nself.uci:set("a", "b", "c%d", luci.http.formvalue("x"))\n', [("722", 3, "certain", "uci:set")]),
    ],
    "handlers": [
        ('local ubus = require "ubus"\nlocal object = ubus.add("luci.x%d")\nlocal function doApply(self, data)\n  os.execute(data.command)\nend\nobject.doApply = doApply\nobject.ping = function(self, data)\n  io.popen(data.target)\nend\nreturn object\n', [("701", 4, "low", "os.execute"), ("702", 8, "low", "io.popen"), ("708", 8, "low", "io.popen"), ("724", 6, "medium", "doApply"), ("724", 7, "medium", "ping")]),
        ('module("luci.controller.x%d", package.seeall)\nfunction index()\n  entry({"admin", "x"}, call("action_run"), nil, 1)\n  entry({"admin", "y"}, call("action_status"), nil, 3)\nend\nfunction action_run()\n  os.execute("/etc/init.d/x restart")\nend\nfunction action_status()\n  return {a = 1}\nend\n', [("724", 3, "low", "action_run")]),
        ('local function call(name) return name end\nfunction action_run%d()\n  os.execute("x")\nend\nentry({"admin"}, call("action_run%d"))\n', []),
        ('m = Map("example%d", translate("Example"))\nm.on_after_commit = function()\n  os.execute("/etc/init.d/x restart")\nend\nm.read = function(self)\n  os.execute("/bin/true")\nend\nreturn m\n', [("724", 2, "low", "on_after_commit")]),
        ('local M = {}\nfunction M.helper%d()\n  os.execute("ls")\nend\nreturn M\n', []),
        ('local dsp = require "luci.dispatcher"\ndsp.entry({"a%d"}, dsp.call("action_run"), nil, 1)\nfunction action_run()\n  os.execute(luci.http.formvalue("cmd"))\nend\n', [("709", 4, "certain", "os.execute")]),
        ('ubus.add("x%d", {reboot = function() os.execute("reboot") end})\n', [("724", 1, "low", "reboot")]),
    ],
    "watchdog": [
        ('while true do end\nlocal v%d = 1\n', [("745", 1, "medium", "infinite loop")]),
        ('pcall(os.execute("rm x%d"))\n', [("745", 1, "high", "pcall(os.execute)")]),
        ('local function go()\n  local f = load("x%d")\n  os.exit(0)\nend\n', [("745", 3, "high", "os.exit")]),
        ('local function go()\n  local f = load("x%d")\n  if not f then os.exit(2) end\nend\n', []),
        ('debug.sethook(f%d)\ndebug.sethook(f%d, "")\ndebug.sethook(f%d, mask%d)\n', [("745", 3, "low", "debug.sethook")]),
        ('debug.setmetatable(_G, {})\nlocal v%d = 1\n', [("725", 1, "medium", "debug.setmetatable")]),
        ('setfenv(form%d, getfenv(1))\nsetfenv(chunk, {io = io})\n', [("725", 2, "medium", "setfenv")]),
        ('package.cpath[1] = "x%d"\n_G.own = 1\npackage.loaded["m"] = 1\n_G = {}\n', [("725", 1, "medium", "package.cpath"), ("725", 4, "medium", "_G")]),
        ('local s = string.rep("x%d", http.formvalue("n"))\nlocal t = string.rep("y", n)\n', [("727", 1, "medium", "string.rep")]),
        ('local a = string.find(s%d, p, 1, true)\nlocal b = string.find(s%d, p)\n', [("728", 2, "medium", "string.find")]),
        ('local s = ""\nfor i = 1, 10 do s = s .. "x%d" end\nwhile #s < 9 do s = s .. "y" end\nwhile go() do s = s .. "y" if s then break end end\nfor k in next_one() do s = s .. k end\n', [("727", 5, "medium", "Forin")]),
        ('local s = "a%d"\nfor i = 1, 30 do s = s .. s end\n', [("727", 2, "medium", "Fornum")]),
    ],
    "calls": [
        ('local M = {}\nfunction M:go(c)\n  os.execute(c)\nend\nM:go(http.formvalue("x%d"))\n', [("709", 3, "certain", "os.execute")]),
        ('local function run(c)\n  os.execute(c)\nend\nlocal routes = {a%d = run, b = print}\nroutes[key](http.formvalue("x"))\n', [("709", 2, "certain", "os.execute")]),
        ('local function run(c)\n  os.execute(c)\nend\nlocal routes = {a = {handler = run}}\nroutes[key].handler(http.formvalue("x%d"))\n', [("709", 2, "certain", "os.execute")]),
        ('local function run(c)\n  os.execute(c)\nend\nlocal routes = {a = run}\nroutes[key]("fixed%d")\n', [("701", 2, "low", "os.execute")]),
    ],
    "meta": [
        ('local = %d\n', [("901", 1, "medium", "name expected near '='")]),
        ('local x = 7 // %d\n', []),
        ('os.execute(v%d) -- sparkwarden: ignore 701\n', []),
        ('-- sparkwarden: ignore 70*\nos.execute(v%d)\nrequire(v%d)\n', []),
        ('-- sparkwarden: frobnicate 701\nlocal v = %d\n', [("012", 1, "medium", "directive")]),
        ('local x = `ls%d`\n', [("711", 1, "high", "ls%d")]),
    ],
}


def bodies(docs: DataFrame, family: str) -> DataFrame:
    """``doc_id, artifact_id, path, body``: the program of each id."""
    programs = [p for p, _ in PROGRAMS[family]]
    n = F.col("doc_id").cast("string")
    picked = F.element_at(F.array(*map(F.lit, programs)), (F.col("doc_id") % len(programs) + 1).cast("int"))
    path = F.concat(F.lit("src/m"), n, F.lit(".lua"))
    return docs.select("doc_id", F.col("doc_id").alias("artifact_id"), path.alias("path"), F.replace(picked, F.lit("%d"), n).alias("body"))


def expected_sql(family: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({k}, {q(c)}, {line}, {q(conf)}, {q(name)})" for k, (_, found) in enumerate(PROGRAMS[family]) for c, line, conf, name in found]
    return (
        f"WITH e(k, code, line, confidence, name) AS (VALUES {', '.join(rows)}) "
        f"SELECT doc_id, code, CAST(line AS INTEGER) AS line, confidence, replace(name, '%d', CAST(doc_id AS VARCHAR)) AS name FROM documents JOIN e ON doc_id % {len(PROGRAMS[family])} = k"
    )


def _family(family: str, profiles: tuple[str, ...] = (), ids: str = ""):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
        found = Scan(bodies(docs, family), profiles).findings()
        return found.select(F.regexp_extract("file", r"m(\d+)\.lua$", 1).cast("long").alias("doc_id"), "code", "line", "confidence", "name")

    run.__name__ = f"lua_{family}"
    run.__doc__ = f"{ids}: findings of the {family} programs, one program a document."
    QUERIES[run.__name__] = run
    ORACLE_SQL[run.__name__] = expected_sql(family)


_family("taint", ids="C03, C04, F01 to F06, G01 to G11, H01 to H03, I02, J04")
_family("quote", ("luci",), "G08, I03, I04, E-28")
_family("shape", ids="H04, I01, J01 to J03, E-27")
_family("firmware", ids="D16, D17, F07, J06, J08, J10 to J13")
_family("payload", ids="D24, D25, F11, J16, J18 to J23")
_family("config", ("openwrt", "luci"), ids="F09, J07, I02")
_family("handlers", ("openwrt", "luci"), ids="J09, J03")
_family("watchdog", ids="J10, J12, J13, J18")
_family("calls", ids="H01, H10")
_family("meta", ids="C09, C10, J05, J25, K03")


# One function of a module, ten lines (J the number): a loop, a branch, a table joined and returned, its call and what is done with the result.
FUNCTION = (
    "local function fJ(a, b)\n  local t, n = {}, 0\n  for i = 1, 10 do t[i] = a .. i end\n  if b then n = #t else n = 1 end\n  while n > 0 do n = n - 1 end\n"
    "  local s = table.concat(t, \",\")\n  return s .. \"wJ\"\nend\n"
)


def modules(ids: DataFrame, functions) -> DataFrame:
    """``doc_id, artifact_id, path, body``: sources of ``functions`` times ten lines; every third function gets request data and runs its result."""
    j = lambda text, n: F.replace(F.lit(text), F.lit("J"), n.cast("string"))
    arg = lambda n: F.when(n % 3 == 0, j('http.formvalue("pJ")', n)).otherwise(F.lit('"fixed"'))
    use = lambda n: F.when(n % 3 == 2, j("print(rJ)", n)).otherwise(j('os.execute("echo " .. rJ)', n))
    one = lambda n: F.concat(j(FUNCTION, n), j("local rJ = fJ(", n), arg(n), F.lit(", true)\n"), use(n), F.lit("\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), functions.cast("int")), one), "")
    return ids.select("doc_id", F.col("doc_id").alias("artifact_id"), F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".lua")).alias("path"), body.alias("body"))


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@register("SELECT doc_id, CAST(1 AS BIGINT) AS ok FROM documents")
def lua_tokens(spark, sf_dir):
    """Token numbers of every source are gapless and end with the end mark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    toks = frontend.tokens(bodies(docs, "taint"))
    agg = toks.groupBy(F.col("artifact_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max("tok_no").alias("m"), F.count(F.when(F.col("kind") == "eof", 1)).alias("e"))
    return agg.select("doc_id", F.when((F.col("n") == F.col("m") + 1) & (F.col("e") == 1), 1).otherwise(0).cast("long").alias("ok"))


@register("WITH e(k, code, line) AS (VALUES (1, '701', 2), (2, '701', 2), (3, '703', 1), (4, '702', 2), (5, '701', 4), (5, '701', 5), (6, '701', 2), (7, '701', 5), (8, '701', 3), (9, '703', 3)) SELECT doc_id, code, CAST(line AS INTEGER) AS line FROM documents JOIN e ON doc_id % 10 = k")
def lua_raw_hits(spark, sf_dir):
    """The lexical scan of the taint programs, by one window over the tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    callees = {"os.execute": "701", "io.popen": "702", "loadstring": "703", "load": "703"}
    return frontend.raw_hits(frontend.tokens(bodies(docs, "taint")), callees).select(F.col("artifact_id").alias("doc_id"), "code", "line")


@register("SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS n_calls, doc_id % 4 = 3 AS exports FROM documents")
def lua_relations(spark, sf_dir):
    """Calls and exported functions of every source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    found = frontend.facts(bodies(docs, "shape"))
    return found.select(F.col("artifact_id").alias("doc_id"), F.size("calls").cast("long").alias("n_calls"), F.exists("functions", lambda f: f["exported"].isNotNull()).alias("exports"))


@register("SELECT doc_id, '709' AS code, CAST(3 AS INTEGER) AS line FROM documents")
def lua_whole_program(spark, sf_dir):
    """Each document is two files; request data of one reaches the other's sink through ``require``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.col("doc_id").cast("string")
    util = docs.select((F.col("doc_id") * 2).alias("artifact_id"), F.concat(F.lit("lib/util"), n, F.lit(".lua")).alias("path"), F.lit("local M = {}\nfunction M.run(c)\n  os.execute(c)\nend\nreturn M\n").alias("body"))
    main = docs.select((F.col("doc_id") * 2 + 1).alias("artifact_id"), F.concat(F.lit("app/main"), n, F.lit(".lua")).alias("path"), F.concat(F.lit('local u = require "util'), n, F.lit('"\nu.run(http.formvalue("c"))\n')).alias("body"))
    # the exporting file's own 708 gives way to the flow, so one finding a pair is left
    found = Scan(util.unionByName(main)).findings().where("code = '709'")
    return found.select(F.regexp_extract("file", r"util(\d+)\.lua$", 1).cast("long").alias("doc_id"), "code", "line")


@register("SELECT doc_id, '729' AS code, CAST(2 AS INTEGER) AS line FROM documents WHERE doc_id % 2 = 0")
def lua_store_hop(spark, sf_dir):
    """Request data stored under a table and column, read back into a command elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.col("doc_id").cast("string")
    writer = docs.where("doc_id % 2 = 0").select((F.col("doc_id") * 2).alias("artifact_id"), F.concat(F.lit("w"), n, F.lit(".lua")).alias("path"), F.concat(F.lit('db.setAttribute("T'), n, F.lit('", "_ROWID_", "1", "Host", web.cgiSearch("h"))\n')).alias("body"))
    reader = docs.select((F.col("doc_id") * 2 + 1).alias("artifact_id"), F.concat(F.lit("r"), n, F.lit(".lua")).alias("path"), F.concat(F.lit('local h = db.getAttribute("T'), n, F.lit('", "_ROWID_", "1", "Host")\nos.execute("ping " .. h)\n')).alias("body"))
    found = Scan(writer.unionByName(reader), ("cgilua",)).findings().where("code = '729'")
    return found.select(F.regexp_extract("file", r"r(\d+)\.lua$", 1).cast("long").alias("doc_id"), "code", "line")


@register("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'analyze' WHEN 1 THEN 'template' WHEN 2 THEN 'conf' ELSE 'skip' END AS route,
  CASE page_id % 4 WHEN 0 THEN 'local a = 1' WHEN 1 THEN '         x = ' || page_id || '  ;' WHEN 2 THEN repeat(' ', 24) || 'do  y = ' || page_id || '  end' ELSE '#!/bin/sh' END AS body FROM pages""")
def b_routes(spark, sf_dir):
    """Routes of artifacts, and what templates and configurations keep."""
    from ..sources import artifacts as A

    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.when(k == 0, "a").when(k == 1, "b.html").when(k == 2, "nginx.conf").otherwise("run").alias("path"),
        F.when(k == 0, F.lit("local a = 1")).when(k == 1, F.concat(F.lit("<p><?lua x = "), n, F.lit(" ?>\n")))
        .when(k == 2, F.concat(F.lit("content_by_lua_block      { y = "), n, F.lit(" }"))).otherwise(F.lit("#!/bin/sh")).alias("body"))
    routed = rows.withColumn("route", A.route(F.col("path"), F.encode("body", "UTF-8"), F.col("body")))
    return A.extracted(routed).select("page_id", "route", F.regexp_replace("body", "\n$", "").alias("body"))


@register("""WITH f AS (SELECT doc_id, unnest(range(1, doc_id % 6 + 2)) AS j FROM documents)
  SELECT doc_id, CASE j % 3 WHEN 0 THEN '709' ELSE '701' END AS code, CAST(10 * j AS INTEGER) AS line, CASE j % 3 WHEN 0 THEN 'certain' ELSE 'low' END AS confidence FROM f WHERE j % 3 <> 2""")
def lua_modules(spark, sf_dir):
    """Modules of ten to sixty lines, a document each; ``bench.py`` runs larger ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    found = Scan(modules(docs, F.col("doc_id") % 6 + 1)).findings()
    return found.select(F.regexp_extract("file", r"m(\d+)\.lua$", 1).cast("long").alias("doc_id"), "code", "line", "confidence")


@register("""SELECT doc_id, 'app/main' || doc_id || '.lua' AS origin, 'source:2:app/main' || doc_id || '.lua,call:2:app/main' || doc_id || '.lua,sink:3:lib/util' || doc_id || '.lua' AS steps FROM documents""")
def lua_traces(spark, sf_dir):
    """Where the data of a finding comes from, the call that brings it into the file, and the sink."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.col("doc_id").cast("string")
    util = docs.select((F.col("doc_id") * 2).alias("artifact_id"), F.concat(F.lit("lib/util"), n, F.lit(".lua")).alias("path"), F.lit("local M = {}\nfunction M.run(c)\n  os.execute(c)\nend\nreturn M\n").alias("body"))
    main = docs.select((F.col("doc_id") * 2 + 1).alias("artifact_id"), F.concat(F.lit("app/main"), n, F.lit(".lua")).alias("path"), F.concat(F.lit('local u = require "util'), n, F.lit('"\nu.run(http.formvalue("c"))\n')).alias("body"))
    found = Scan(util.unionByName(main)).findings().where("code = '709'")
    step = F.transform("trace", lambda s: F.concat_ws(":", s["kind"], s["line"].cast("string"), s["file"]))
    return found.select(F.regexp_extract("file", r"util(\d+)\.lua$", 1).cast("long").alias("doc_id"), "origin", F.array_join(step, ",").alias("steps"))


@register("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 6 = 0) AS bad FROM documents)
  SELECT unnest(['artifacts', 'unparsed', 'degraded', 'files_with_cut_sites', 'fixpoint_bound']) AS counter, unnest([n, bad, 0, 0, 0]) AS n FROM n""")
def lua_diagnostics(spark, sf_dir):
    """Counters of a scan and the bounds it hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    got = Scan(bodies(docs, "meta")).diagnostics()
    return got.where(F.col("counter").isin("artifacts", "unparsed", "degraded", "files_with_cut_sites", "fixpoint_bound"))
