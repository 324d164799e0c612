"""Registry dimensions: rule catalogue, sources, sinks, signatures.

All are small, fixed tables; profiles are rows with a ``profile`` column, so
choosing profiles is a filter and nothing needs to be reset between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CONFIDENCES, glob_regex, wildcards

# Rule catalogue (fixed values): code, severity, confidence, weakness class, message template.
CODES = [
    ("012", "low", "medium", "CWE-0", "a suppression directive could not be read ({name})"),
    ("701", "high", "medium", "CWE-78", "command execution with a non-constant argument ({name})"),
    ("702", "high", "medium", "CWE-78", "pipe opened with a non-constant command ({name})"),
    ("703", "high", "medium", "CWE-94", "dynamic code evaluation with a non-constant argument ({name})"),
    ("704", "high", "medium", "CWE-94", "code or script loaded from a non-constant path ({name})"),
    ("705", "high", "medium", "CWE-94", "module name computed at runtime ({name})"),
    ("706", "high", "medium", "CWE-94", "native library loaded from a non-constant path ({name})"),
    ("707", "high", "medium", "CWE-94", "LuaJIT FFI escape hatch used ({name})"),
    ("708", "high", "medium", "CWE-78", "exported execution sink whose argument nothing in this file feeds ({name})"),
    ("709", "critical", "high", "CWE-78", "untrusted data reaches command execution ({name})"),
    ("710", "critical", "high", "CWE-94", "untrusted data reaches dynamic code evaluation ({name})"),
    ("711", "high", "medium", "CWE-78", "shell command written as a backtick literal"),
    ("712", "high", "high", "CWE-78", "shell metacharacters from untrusted data are not quoted ({name})"),
    ("721", "high", "medium", "CWE-1236", "write to flash or firmware configuration with untrusted data ({name})"),
    ("722", "high", "medium", "CWE-78", "configuration value set from untrusted data, which a service may later execute ({name})"),
    ("723", "medium", "medium", "CWE-538", "sensitive file read by path literal ({name})"),
    ("724", "high", "medium", "CWE-78", "function containing an execution sink is exposed as an RPC handler ({name}){note}"),
    ("725", "high", "medium", "CWE-693", "sandbox or global environment manipulated ({name})"),
    ("726", "medium", "medium", "CWE-732", "self-modifying or destructive operation ({name})"),
    ("727", "medium", "medium", "CWE-400", "unbounded string growth can exhaust memory ({name})"),
    ("728", "medium", "medium", "CWE-1333", "untrusted data used as a search pattern ({name})"),
    ("729", "high", "medium", "CWE-78", "untrusted data stored in {store} is read back into command execution ({name})"),
    ("730", "high", "high", "CWE-93", "untrusted data written into an HTTP header or URI ({name})"),
    ("731", "high", "high", "CWE-444", "untrusted data written into an HTTP subrequest ({name})"),
    ("741", "critical", "medium", "CWE-94", "obfuscated code loader ({name})"),
    ("743", "critical", "medium", "CWE-94", "decoded data fed to an execution sink ({name})"),
    ("745", "medium", "medium", "CWE-693", "anti-analysis or watchdog behaviour ({name})"),
    ("746", "critical", "medium", "CWE-506", "embedded machine-code blob ({name})"),
    ("747", "high", "medium", "CWE-798", "hardcoded credential ({name})"),
    ("748", "critical", "medium", "CWE-307", "scanner or credential brute-force loop ({name})"),
    ("749", "high", "medium", "CWE-506", "persistence installed by the script ({name})"),
    ("750", "critical", "certain", "CWE-1203", "matches a known exploit or malware signature: {name}"),
    ("801", "medium", "medium", "CWE-0", "Lua bytecode file, source cannot be analyzed ({name})"),
    ("802", "high", "medium", "CWE-94", "bytecode references an execution sink ({name})"),
    ("803", "low", "medium", "CWE-0", "bytecode format does not match the assumed interpreter ({name})"),
    ("805", "low", "medium", "CWE-0", "file is not parseable Lua despite its name ({name})"),
    ("901", "low", "medium", "CWE-0", "source could not be parsed; lexical scan only"),
    ("902", "low", "medium", "CWE-0", "source uses a Lua construct the parser does not support ({name})"),
    ("903", "low", "medium", "CWE-0", "API seen that is not available in the configured Lua standard ({name})"),
    ("904", "medium", "certain", "CWE-0", "flow-sensitive analysis skipped for a large file ({name}); results are approximate"),
]
#: Codes that report a gap in coverage; no selection hides them.
DEGRADED = ("012", "801", "803", "805", "901", "902", "904")
CATEGORIES = ("exec", "firmware", "payload", "artifact", "meta")

# Source patterns (fixed values): profile, pattern, id, confidence.
SOURCES = [
    ("base", "http.formvalue", "http.formvalue", "certain"), ("base", "http.formvalue.*", "http.formvalue", "certain"),
    ("base", "luci.http.formvalue", "luci.http.formvalue", "certain"), ("base", "luci.http.formvalue.*", "luci.http.formvalue", "certain"),
    ("base", "os.getenv", "os.getenv", "medium"), ("base", "os.getenv.*", "os.getenv", "medium"), ("base", "io.input", "io.input", "medium"),
    ("base", "io.lines", "io.lines", "medium"), ("base", "io.open:read", "io.open:read", "medium"), ("base", "file:read", "file:read", "medium"),
    ("base", "json.decode", "json.decode", "high"), ("base", "jsonc.parse", "jsonc.parse", "high"), ("base", "cjson.decode", "cjson.decode", "high"),
    ("luci", "luci.http.formvalue", "luci.http.formvalue", "certain"), ("luci", "luci.http.formvalue.*", "luci.http.formvalue", "certain"),
    ("luci", "luci.dispatcher.context.formvalue", "luci.dispatcher.context.formvalue", "certain"), ("luci", "luci.dispatcher.context.formvalue.*", "luci.dispatcher.context.formvalue", "certain"),
    ("luci", "luci.dispatcher.createtree", "luci.dispatcher.createtree", "low"), ("luci", "luci.ip.*", "luci.ip", "low"),
    ("luci", "luci.http.getenv", "luci.http.getenv", "certain"), ("luci", "luci.http.getenv.*", "luci.http.getenv", "certain"), ("luci", "luci.time.now", "luci.time.now", "low"),
    ("openwrt", "uci.get", "uci.get", "high"), ("openwrt", "uci.get.*", "uci.get", "high"), ("openwrt", "uci.get_all", "uci.get_all", "high"),
    ("openwrt", "uci.get_bool", "uci.get_bool", "high"), ("openwrt", "uci.get_first", "uci.get_first", "high"), ("openwrt", "luci.model.uci.get", "luci.model.uci.get", "high"),
    ("openwrt", "luci.model.uci.get_all", "luci.model.uci.get", "high"), ("openwrt", "ubus.call", "ubus.call", "medium"), ("openwrt", "ubus.call.*", "ubus.call", "medium"),
    ("openwrt", "ubus.connect", "ubus.connect", "medium"), ("openwrt", "nixio.getenv", "nixio.getenv", "medium"),
    ("openresty", "ngx.var.*", "ngx.var", "medium"), ("openresty", "ngx.req.get_uri_arg", "ngx.req.get_uri_arg", "certain"), ("openresty", "ngx.req.get_uri_arg.*", "ngx.req.get_uri_arg", "certain"),
    ("openresty", "ngx.req.get_uri_args", "ngx.req.get_uri_args", "certain"), ("openresty", "ngx.req.get_post_args", "ngx.req.get_post_args", "certain"),
    ("openresty", "ngx.req.get_headers", "ngx.req.get_headers", "certain"), ("openresty", "ngx.req.get_body_data", "ngx.req.get_body_data", "certain"),
    ("cgilua", "web.cgiToLuaTable", "web.cgiToLuaTable", "certain"), ("cgilua", "web.cgiSearch", "web.cgiSearch", "high"), ("cgilua", "web.cgiFindButton", "web.cgiFindButton", "high"),
    ("cgilua", "web.cgiFindToken", "web.cgiFindToken", "high"), ("cgilua", "SAPI.Request.servervariable", "SAPI.Request.servervariable", "high"), ("cgilua", "cgilua.cookies.get", "cgilua.cookies.get", "medium"),
    ("espressif", "node.getArgument", "node.getArgument", "certain"), ("espressif", "httpServerRequest*", "http.request", "high"), ("espressif", "mqtt.getMessage", "mqtt.getMessage", "high"),
    ("hisi", "hi_mpi.*", "hi_mpi", "low"), ("hisi", "isp.*", "isp", "low"), ("hisi", "net.*", "net", "low"),
]
# Method and global sources (fixed values): profile, name, id, confidence.
METHOD_SOURCES = [
    ("base", "read", "file:read", "medium"), ("base", "readline", "file:read", "medium"), ("base", "readall", "file:read", "medium"),
    ("luci", "formvalue", "luci.cbi.formvalue", "high"), ("luci", "formvaluetable", "luci.cbi.formvalue", "high"),
]
GLOBAL_SOURCES = [("cgilua", "cgi", "cgi", "certain"), ("cgilua", "RowId", "RowId", "high"), ("cgilua", "DBTable", "DBTable", "high"), ("cgilua", "NextPage", "NextPage", "high")]
# Sinks (fixed values): profile, pattern, code, kind, argument numbers, filtered metacharacters.
SINKS = [
    ("base", "os.execute", "701", "exec", [1], ""), ("base", "os.execute.*", "701", "exec", [1], ""), ("base", "io.popen", "702", "exec", [1], ""), ("base", "io.popen.*", "702", "exec", [1], ""),
    ("base", "loadstring", "703", "dyncode", [1], ""), ("base", "load", "703", "dyncode", [1], ""), ("base", "dofile", "704", "dyncode", [1], ""), ("base", "loadfile", "704", "dyncode", [1], ""),
    ("base", "package.loadlib", "706", "dyncode", [1], ""), ("base", "package.loadlib.*", "706", "dyncode", [1], ""), ("base", "ffi.load", "706", "dyncode", [1], ""),
    ("luci", "luci.sys.call", "701", "exec", [1], ""), ("luci", "luci.dispatcher.createtree", "724", "expose", [], ""),
    ("openwrt", "nixio.execp", "701", "exec", [1], ""), ("openwrt", "nixio.exece", "701", "exec", [1], ""), ("openwrt", "nixio.exec", "701", "exec", [1, 3], ""), ("openwrt", "posix.exec", "701", "exec", [1, 2, 3], ""),
    ("openwrt", "posix.execp", "701", "exec", [1, 2, 3], ""), ("openwrt", "posix.unistd.exec", "701", "exec", [1, 2], ""), ("openwrt", "posix.unistd.execp", "701", "exec", [1, 2], ""),
    ("openwrt", "posix.execx", "701", "exec", [1], ""), ("openwrt", "posix.spawn", "701", "exec", [1], ""), ("openwrt", "posix.popen", "701", "exec", [1], ""), ("openwrt", "posix.popen_pipeline", "701", "exec", [1], ""),
    ("openwrt", "luci.sys.call", "701", "exec", [1], ""), ("openwrt", "uci.set", "722", "config", [4], ""), ("openwrt", "uci.add", "722", "config", [4], ""), ("openwrt", "uci.sets", "722", "config", [2], ""),
    ("openwrt", "uci:set", "722", "cursor", [3, 4], ""), ("openwrt", "uci:add_list", "722", "cursor", [4], ""), ("openwrt", "uci:set_list", "722", "cursor", [4], ""), ("openwrt", "uci:setlist", "722", "cursor", [4], ""),
    ("openwrt", "uci:section", "722", "cursor", [4], ""), ("openwrt", "uci:tset", "722", "cursor", [3], ""), ("openwrt", "uci:add", "722", "cursor", [3], ""),
    ("openresty", "ngx.exec", "701", "exec", [1], ""), ("openresty", "ngx.pty.spawn", "701", "exec", [1], ""), ("openresty", "ngx.resp.set_header", "730", "header", [2], ""), ("openresty", "ngx.req.set_header", "730", "header", [2], ""),
    ("openresty", "ngx.req.set_uri", "730", "header", [1], ""), ("openresty", "ngx.req.set_uri_args", "730", "header", [1], ""), ("openresty", "ngx.redirect", "730", "header", [1], ""),
    ("openresty", "ngx.location.capture", "731", "subrequest", [2], ""), ("openresty", "ngx.header", "730", "assign", [1], ""),
    ("cgilua", "util.runShellCmd", "701", "exec", [1, 4], ";`$&|<>"), ("cgilua", "util.shellCmdOutput", "701", "exec", [1, 2], ";`$&|<>"),
    ("espressif", "node.exec", "701", "exec", [1], ""), ("espressif", "file.remove", "726", "destructive", [1], ""), ("espressif", "file.open", "721", "flash", [1], ""),
    ("hisi", "hi_system.exec", "701", "exec", [1], ""), ("hisi", "hi_mpi.exec", "701", "exec", [1], ""), ("hisi", "os.system", "701", "exec", [1], ""),
    ("luajit", "ffi.load", "706", "dyncode", [1], ""), ("luajit", "ffi.cdef", "707", "ffi", [1], ""), ("luajit", "ffi.C.system", "701", "exec", [1], ""), ("luajit", "ffi.C.execve", "701", "exec", [1], ""),
    ("luajit", "ffi.C.popen", "702", "exec", [1], ""), ("luajit", "ffi.C.fork", "701", "exec", [], ""), ("luajit", "ffi.string", "707", "ffi", [], ""),
]
# Shapes (fixed values): pattern, code.
SHAPES = [("ffi.cdef", "707"), ("ffi.C.*", "707"), ("ffi.load", "706"), ("package.loadlib", "706"), ("package.loadlib.*", "706"), ("require", "705")]
# Propagators (fixed values): profile, pattern, argument numbers.
PROPAGATORS = [
    ("base", "tostring", [1]), ("base", "string.*", [1]), ("base", "table.concat", [1]), ("base", "table.unpack", [1]), ("base", "unpack", [1]), ("base", "ipairs", [1]), ("base", "pairs", [1]),
    ("base", "string.format", [1, 2]), ("base", "ngx.re.gsub", [1]), ("base", "ngx.re.find", [1]), ("luci", "luci.util.shellquote", [1]), ("luci", "luci.util.trim", [1]), ("luci", "luci.http.urldecode", [1]),
    ("openwrt", "luci.util.pcdata", [1]), ("openwrt", "luci.sys.uniqueid", []), ("openwrt", "jsonc.parse", [1]), ("openwrt", "json.decode", [1]), ("openwrt", "cjson.decode", [1]), ("openwrt", "nixio.fs.readfile", [1]),
    ("openresty", "ngx.re.gsub", [1]), ("openresty", "ngx.decode_args", [1]),
]
# Sanitizers and validators (fixed values): profile, kind, pattern; profile, pattern.
SANITIZERS = [("luci", "shell", "luci.util.shellquote"), ("openwrt", "shell", "luci.util.shellquote")]
# Entry points (fixed values): profile, function pattern, file pattern, argument numbers (0: all), confidence, channel.
ENTRY_POINTS = [
    ("luci", "*", "*/controller/*.lua", [0], "medium", "web"), ("luci", "validate", "*/model/cbi/*.lua", [2], "medium", "web"), ("luci", "write", "*/model/cbi/*.lua", [3], "medium", "web"),
    ("cgilua", "*Handler", "", [1], "medium", "web"), ("cgilua", "*DiagnosticsHandler", "*Tr*.lua", [1], "medium", "acs"), ("cgilua", "*CLIPing", "*CLI.lua", [1], "medium", "cli"),
]
# Stores (fixed values): profile, direction, pattern, table argument, column argument, value or row argument.
STORES = [
    ("cgilua", "write", "db.setAttribute", 1, 4, 5), ("cgilua", "write", "db.insert", 1, 0, 2), ("cgilua", "write", "db.update", 1, 0, 2), ("cgilua", "read", "db.getAttribute", 1, 4, 0), ("cgilua", "read", "db.getRow", 1, 0, 0),
    ("cgilua", "read", "db.getRowWhere", 1, 0, 0), ("cgilua", "read", "db.getRows", 1, 0, 0), ("cgilua", "read", "db.getRowsWhere", 1, 0, 0), ("cgilua", "read", "db.getTable", 1, 0, 0),
]
VALIDATORS = [("cgilua", "validations.is_ipv4_address"), ("cgilua", "validations.is_ipv6_address"), ("cgilua", "validations.is_fqdn_address")]
# Module names and what they are called once required (fixed values).
MODULES = {
    "ffi": "ffi", "posix": "posix", "nixio": "nixio", "cjson": "cjson", "json": "json", "jsonc": "jsonc", "luci": "luci", "uci": "uci", "luci.json": "json", "luci.jsonc": "jsonc",
    "luci.util": "luci.util", "ngx": "ngx", "ltn12": "ltn12", "luaposix": "posix",
}
# Signature pack (fixed values): id, alternatives separated by "|".
SIGNATURES = [
    ("mirai-default-credentials", "vizxv|xc3511|Zte521|hi3518|juantech|jvbzd|anko|7ujMko0admin|xmhdipc"),
    ("mirai-user-agent", "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/51.0.2704.103 Safari/537.36"),
    ("mirai-loader-paths", "/bin/busybox MIRAI|/tmp/.mirai|/var/run/mirai.pid"),
    ("shellshock-cgi-environment", "() { :; };|BASH_FUNC_|HTTP_PROXY=|HTTP_USER_AGENT="),
    ("cve-2017-17215-huawei-hg532", "/ctrlt/DeviceUpgrade_1|setNewpwd"),
    ("cve-2018-10561-dlink-gpon", "NewStatusURL|AddPortMapping|urn:dslforum-org:service:WANCommonInterfaceConfig:1"),
    ("dvr-cgi-path-traversal", "/language/../../../../../../../etc/passwd|POST /language/"),
    ("miner-stratum-pool", "stratum+tcp://|cryptonight|cryptonight-lite"),
    ("cobalt-strike-default-uri", "/submit.php?id=|/pixel.gif|Microsoft-CIS"),
]
#: Strings that occur in ordinary text collections, for scans of prose.
TEXT_SIGNATURES = [("license-notice", "License|Licence"), ("address-mark", "@mail"), ("junk-marks", "###|&&&|$$$")]
PROFILES = ("luci", "openwrt", "openresty", "cgilua", "espressif", "hisi", "luajit")


class RegistryError(ValueError):
    """A declaration that cannot be used; raised before any work starts."""


def validate(rules: dict) -> dict:
    """Checks extra declarations ``{sources, sinks, propagators, sanitizers}``."""
    unknown = set(rules) - {"sources", "sinks", "propagators", "sanitizers"}
    if unknown:
        raise RegistryError(f"unknown section: {', '.join(sorted(unknown))}")
    for section, rows in rules.items():
        for row in rows:
            if not isinstance(row.get("pattern"), str) or not row["pattern"]:
                raise RegistryError(f"{section}: a row needs a pattern")
            if section == "sources" and row.get("confidence", "medium") not in CONFIDENCES:
                raise RegistryError(f"{section}: unknown confidence {row['confidence']!r}")
            if section == "sinks" and (row.get("code") not in {c[0] for c in CODES} or not all(isinstance(a, int) and a > 0 for a in row.get("arg", [1]))):
                raise RegistryError(f"{section}: a sink needs a known code and positive argument numbers")
    return rules


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, severity string, confidence string, cwe string, template string")


def _active(rows: list, profiles: tuple[str, ...]) -> list:
    for p in profiles:
        if p not in PROFILES:
            raise RegistryError(f"unknown profile {p!r}")
    return [(i, 0 if r[0] != "base" else 1, r) for i, r in enumerate(rows) if r[0] == "base" or r[0] in profiles]


def sources(spark: SparkSession, profiles: tuple[str, ...] = (), extra: dict | None = None) -> DataFrame:
    """``decl_no, scope_rank, pattern, regex, n_wild, id, confidence``; profile rows rank before base rows."""
    rows = [(n, s, p, glob_regex(p), wildcards(p), i, c) for n, s, (_, p, i, c) in _active(SOURCES, profiles)]
    rows += [(10_000 + n, 0, r["pattern"], glob_regex(r["pattern"]), wildcards(r["pattern"]), r.get("id", r["pattern"]), r.get("confidence", "medium")) for n, r in enumerate(validate(extra or {}).get("sources", []))]
    return spark.createDataFrame(rows, "decl_no int, scope_rank int, pattern string, regex string, n_wild int, id string, confidence string")


def sinks(spark: SparkSession, profiles: tuple[str, ...] = (), extra: dict | None = None) -> DataFrame:
    """``decl_no, scope_rank, pattern, regex, n_wild, code, kind, arg, filters``."""
    rows = [(n, 0, p, glob_regex(p), wildcards(p), c, k, a, f) for n, _, (_, p, c, k, a, f) in _active(SINKS, profiles)]
    rows += [(10_000 + n, 0, r["pattern"], glob_regex(r["pattern"]), wildcards(r["pattern"]), r["code"], r.get("kind", "exec"), r.get("arg", [1]), "") for n, r in enumerate(validate(extra or {}).get("sinks", []))]
    return spark.createDataFrame(rows, "decl_no int, scope_rank int, pattern string, regex string, n_wild int, code string, kind string, arg array<int>, filters string")


def signatures(spark: SparkSession, pack: list = SIGNATURES) -> DataFrame:
    """``sig_id, alt``: one row per alternative; ids are unique and no alternative is empty."""
    ids = [s for s, _ in pack]
    if len(set(ids)) != len(ids) or any(not a for _, p in pack for a in p.split("|")):
        raise RegistryError("signature ids must be unique and alternatives not empty")
    return spark.createDataFrame(pack, "sig_id string, pattern string").select("sig_id", F.explode(F.split("pattern", r"\|")).alias("alt"))


def pack_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """``sig_id, alt`` rows that only one of two packs has, both ways."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
