"""The scan of Lua sources: taint, sinks and rule detectors over the relations.

Taint facts are rows ``(node, taint id, source line, confidence, quoted, ctx)``;
``ctx`` is the call site a fact was bound at, so what a function returns goes
back to that site only.  Nodes are ``artifact:node``, so calls across files are
edges like any other.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import dims
from . import findings as FI
from .detect import blob_shape
from .flow import capped, gathered, measuring, semi_naive, stored, walk_back
from .frontend import directives, facts, relation
from .match import best_match, entry_points
from .select import apply_directives, cover

LABELS = ["tid", "src_line", "confidence", "quoted", "ctx", "origin", "channel"]
#: Sinks that only a proven flow makes a finding, under their own code.
TAINT_ONLY = ("header", "assign", "subrequest", "cursor")
#: Calls into other files that one file may make, and functions of a file beyond which calls are not followed.
MAX_SITES, MAX_FUNCTIONS = 4096, 4000
# Paths whose writing, reading or removal is a finding, boot files and loaders (fixed values).
FLASH = dict(prefixes=["/dev/mtd", "/dev/ubi", "/proc/sys/", "/etc/config/", "/etc/init.d/", "/etc/uci-defaults/"], exact=["/dev/nvram", "/etc/rc.local"])
SENSITIVE = dict(exact=["/etc/shadow", "/proc/self/environ"], prefixes=["/etc/ssl/private/"], name_prefixes=["id_rsa"], name_suffixes=[".pem", ".key", ".p12"])
PROTECTED = dict(prefixes=["/etc/init.d/", "/usr/bin/"], exact=["/etc/rc.local"])
BOOT = dict(
    exact=["/etc/rc.local", "/etc/rc.d/rc.local", "/etc/inittab", "/etc/profile"],
    prefixes=[
        "/etc/init.d/", "/etc/rc.d/", "/etc/rcS.d/", "/etc/rc0.d/", "/etc/rc1.d/", "/etc/rc2.d/", "/etc/rc3.d/", "/etc/rc4.d/", "/etc/rc5.d/", "/etc/rc6.d/", "/etc/uci-defaults/",
        "/etc/systemd/system/", "/lib/systemd/system/", "/usr/lib/systemd/system/", "/run/systemd/system/", "/etc/cron.d/", "/etc/cron.daily/", "/etc/cron.hourly/", "/etc/cron.weekly/", "/etc/cron.monthly/",
    ],
)
LOADERS = ("loadstring", "load", "loadfile", "dofile")
EXEC_SINKS = ("os.execute", "io.popen", "dofile", "package.loadlib", "ffi.load")
# Pattern functions and the argument that is the pattern; names of credentials, sure and bare (fixed values).
PATTERN_APIS = {"string.find": 2, "string.match": 2, "string.gmatch": 2, "string.gsub": 2, "ngx.re.find": 2, "ngx.re.gsub": 2}
QUALIFYING = r"(?i)(?:^|[._])(?:\w*_)?(?:password|passwd|pwd|passphrase|secret|token|credential|psk|preshared|apikey|privkey|api_key|private_key)s?$"
BARE = r"(?i)(?:^|[._])(?:key|auth|pass|seed|licence|license)$"


def gid(node: str | Column) -> Column:
    return F.concat(F.col("artifact_id").cast("string"), F.lit(":"), (F.col(node) if isinstance(node, str) else node).cast("string"))


class Scan:
    """Relations and taint of a set of artifacts, each computed once and stored."""

    def __init__(self, artifacts: DataFrame, profiles: tuple[str, ...] = (), extra: dict | None = None, detectors: Sequence[Callable[[Scan], DataFrame]] = (), progress: Callable[[str], object] | None = None):
        """``detectors`` take the scan and return findings as its own do (P03); ``progress`` is told of each stage."""
        self.spark: SparkSession = measuring(artifacts.sparkSession)
        self.detectors, self.progress = tuple(detectors), progress
        self._tell("parse")
        self.profiles, self.extra = profiles, dims.validate(extra or {})
        self.facts = facts(artifacts, session=self.spark)
        r = lambda n: relation(self.facts, n)
        self.calls, self.args, self.edges, self.functions, self.formals = r("calls"), r("args"), r("edges"), r("functions"), r("formals")
        self.reads, self.strings, self.binds, self.spots, self.names = r("reads"), r("strings"), r("binds"), r("spots"), r("names")
        self.registered, self.routes = r("handlers"), r("routes")

    def _tell(self, stage: str) -> None:
        if self.progress is not None:
            with contextlib.suppress(Exception):  # a listener that fails is no failure of the scan
                self.progress(stage)

    # ---- G: seeds and edges
    def seeds(self) -> DataFrame:
        """Dotted, method, value and global sources, and entry points."""
        dim = dims.sources(self.spark, self.profiles, self.extra)
        calls = best_match(self.calls.select("artifact_id", "node", "path", "method", "line"), dim, "path", ["id", "confidence"], how="left")
        on = ("base", *self.profiles)
        methods = {m: (i, c) for p, m, i, c in dims.METHOD_SOURCES if p in on}
        by_method = F.create_map(*[F.lit(x) for m, (i, c) in methods.items() for x in (m, i)])[F.col("method")]
        conf = F.create_map(*[F.lit(x) for m, (i, c) in methods.items() for x in (m, c)])[F.col("method")]
        called = calls.select("artifact_id", "node", "line", F.coalesce("id", by_method).alias("tid"), F.when(F.col("id").isNotNull(), F.col("confidence")).otherwise(conf).alias("confidence")).where("tid is not null")
        read = best_match(self.reads.select("artifact_id", "node", "path", "line"), dim.where("pattern like '%.*'"), "path", ["id", "confidence"])
        out = [called.withColumn("channel", F.lit("")), read.select("artifact_id", "node", "line", F.col("id").alias("tid"), "confidence", F.lit("").alias("channel"))]
        names = {g: (i, c) for p, g, i, c in dims.GLOBAL_SOURCES if p in on}
        if names:
            glob = self.reads.where(F.col("path").isin(*names))
            out.append(glob.select("artifact_id", "node", "line", F.col("path").alias("tid"), F.create_map(*[F.lit(x) for g, (i, c) in names.items() for x in (g, c)])[F.col("path")].alias("confidence"), F.lit("").alias("channel")))
        if any(p in self.profiles for p, *_ in dims.ENTRY_POINTS):
            fns = entry_points(self.functions.where("name <> ''").select("artifact_id", "fn", "file", "line", F.element_at(F.split("name", "[.:]"), -1).alias("name")), self.profiles).where("entry is not null")
            formal = fns.join(self.formals.select("artifact_id", "fn", "pos", "node"), ["artifact_id", "fn"]).where(F.array_contains("arg", 0) | F.array_contains("arg", F.col("pos")))
            out.append(formal.select("artifact_id", "node", "line", F.col("entry").alias("tid"), "confidence", "channel"))
        return gathered([df.select(gid("node").alias("node"), "tid", F.col("line").alias("src_line"), "confidence", F.lit(False).alias("quoted"), F.lit("").alias("ctx"), F.col("artifact_id").cast("string").alias("origin"), "channel") for df in out], "seeds")

    def flow_edges(self) -> DataFrame:
        """``src, dst, label, site`` with labels copy, quote, bind and ret; made once."""
        if not hasattr(self, "_edges"):
            self._edges = gathered(self._flow_edges(), "edges")
        return self._edges

    def _flow_edges(self) -> list[DataFrame]:
        plain = self.edges.where("label = 'copy'").select(gid("src").alias("src"), gid("dst").alias("dst"), F.lit("copy").alias("label"), F.lit("").alias("site"))
        rows = [(i, 0, p, S.glob_regex(p), S.wildcards(p), a) for i, (pr, p, a) in enumerate(dims.PROPAGATORS) if pr == "base" or pr in self.profiles]
        rows += [(10_000 + i, 0, r["pattern"], S.glob_regex(r["pattern"]), S.wildcards(r["pattern"]), r.get("arg", [1])) for i, r in enumerate(self.extra.get("propagators", []))]
        dim = self.spark.createDataFrame(rows, "decl_no int, scope_rank int, pattern string, regex string, n_wild int, take array<int>")
        quoting = [p for pr, k, p in dims.SANITIZERS if pr in self.profiles] + [r["pattern"] for r in self.extra.get("sanitizers", [])]
        carried = best_match(self.calls.select("artifact_id", F.col("node").alias("call"), "path"), dim, "path", ["take"])
        args = self.args.select("artifact_id", "call", "pos", "node")
        propagated = carried.join(args, ["artifact_id", "call"]).where(F.array_contains("take", F.col("pos")))
        passed = propagated.select(gid("node").alias("src"), gid("call").alias("dst"), F.when(F.col("path").isin(*quoting) if quoting else F.lit(False), "quote").otherwise("copy").alias("label"), F.lit("").alias("site"))
        return [plain, passed, *self.bindings()]

    def sites(self) -> DataFrame:
        """``artifact_id, call, to, fn, shift`` of calls whose function is known.

        A function is known in its own file, as a module's export that one file
        alone provides, as a global that one file alone defines, or as a target
        of a literal table that a computed key picks from.  Of calls into other
        files a file makes MAX_SITES at most; files with more than MAX_FUNCTIONS
        functions bind none, nor are theirs bound (B15).
        """
        if not hasattr(self, "_sites"):
            own = self.calls.where("target is not null").select("artifact_id", F.col("node").alias("call"), F.col("artifact_id").alias("to"), F.col("target").alias("fn"), "shift")
            routed = self.routes.where("fn is not null").select("artifact_id", "call", F.col("artifact_id").alias("to"), "fn", F.lit(0).alias("shift"))
            exports = self.functions.where("exported is not null").select(F.col("artifact_id").alias("to"), "file", "fn", F.col("exported").alias("member"))
            offered = exports.select("to", "fn", F.explode(S.module_candidates(F.col("file"))).alias("m"), "member").select("to", "fn", F.concat_ws(".", "m", "member").alias("path"))
            only = lambda df: df.groupBy("path").agg(F.count("*").alias("n"), F.first("to").alias("to"), F.first("fn").alias("fn")).where("n = 1").drop("n")
            unique = only(self.functions.where("global is not null").select(F.col("artifact_id").alias("to"), "fn", F.col("global").alias("path")))
            calls = self.calls.where("target is null").select("artifact_id", F.col("node").alias("call"), "path")
            named = self.routes.where("fn is null").select("artifact_id", "call", F.col("name").alias("path"))
            ways = [calls.where("path like '%.%'").join(only(offered), "path"), calls.join(unique, "path"), named.join(unique, "path")]
            ways = gathered([w.where("to <> artifact_id").select("artifact_id", "call", "to", "fn", F.lit(0).alias("shift")) for w in ways], "ways")
            far, self._cut_sites = capped(stored(ways.distinct(), "far"), ["artifact_id"], ["call", "to", "fn"], MAX_SITES)  # the calls of one file; its count and its rows are both asked for
            large = stored(self.functions.groupBy("artifact_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_FUNCTIONS).select("artifact_id"), "large")
            self._sites = gathered([found.join(large, "artifact_id", "left_anti").join(large.toDF("to"), "to", "left_anti") for found in (own, routed, far.drop("overflow"))], "sites")
        return self._sites

    def bindings(self) -> list[DataFrame]:
        """Arguments to formals, the rest to the vararg, returns back to their site; a method's first formal is its object."""
        there = lambda n: F.concat(F.col("to").cast("string"), F.lit(":"), F.col(n).cast("string"))
        sites = self.sites().select("artifact_id", "call", "to", "fn", "shift", gid("call").alias("site"))
        formals = self.formals.select(F.col("artifact_id").alias("to"), "fn", F.col("pos").alias("fpos"), F.col("node").alias("fnode"))
        n_named = formals.groupBy("to", "fn").agg(F.max("fpos").alias("named"))
        given = sites.join(self.args.select("artifact_id", "call", "pos", "node"), ["artifact_id", "call"]).join(n_named, ["to", "fn"])
        at = F.col("pos") + F.col("shift")
        bound = given.withColumn("fpos", F.when(at <= F.col("named"), at).otherwise(-1)).join(formals, ["to", "fn", "fpos"])
        bind = bound.select(gid("node").alias("src"), there("fnode").alias("dst"), F.lit("bind").alias("label"), "site")
        rets = self.functions.select(F.col("artifact_id").alias("to"), "fn", "ret")
        ret = sites.join(rets, ["to", "fn"]).select(there("ret").alias("src"), F.col("site").alias("dst"), F.lit("ret").alias("label"), "site")
        return [bind, ret]

    def chains(self, most: int = 16) -> DataFrame:
        """``artifact_id, chain``: the files from each file back to where its calls come from, first caller first, without cycles."""
        callers = self.sites().where("to <> artifact_id").groupBy("to").agg(F.min("artifact_id").alias("by"))
        return walk_back(callers, most).withColumnRenamed("to", "artifact_id")

    def lines_by_function(self) -> DataFrame:
        """``artifact_id, fn, lines`` of the calls that each function itself makes."""
        return self.calls.groupBy("artifact_id", "fn").agg(F.array_sort(F.collect_set("line")).alias("lines"))

    def taint(self) -> DataFrame:
        """The closure of the seeds; ``node`` and LABELS."""
        if not hasattr(self, "_taint"):

            def move(m: DataFrame) -> DataFrame:
                m = m.where((F.col("label") != "ret") | (F.col("ctx") == "") | (F.col("ctx") == F.col("site")))
                m = m.withColumn("quoted", F.col("quoted") | (F.col("label") == "quote"))
                return m.withColumn("ctx", F.when(F.col("label") == "bind", F.col("site")).when(F.col("label") == "ret", F.lit("")).otherwise(F.col("ctx")))

            known, self.hit_bound = semi_naive(self.seeds(), self.flow_edges(), [], LABELS, move, max_rounds=160, edges_stored=True)
            first = F.min(F.struct("src_line", "origin", "ctx", "confidence", "channel")).alias("f")
            self._taint = stored(known.groupBy("node", "tid", "quoted").agg(first).select("node", "tid", "quoted", "f.*"), "taint")
        return self._taint

    # ---- I: sinks
    def sink_args(self) -> DataFrame:
        """Calls and assignments of sinks with each argument that matters; made once."""
        if not hasattr(self, "_sink_args"):
            self._sink_args = gathered(self._find_sink_args(), "sinks")
        return self._sink_args

    def _find_sink_args(self) -> list[DataFrame]:
        dim = dims.sinks(self.spark, self.profiles, self.extra)
        calls = best_match(self.calls.select("artifact_id", "file", F.col("node").alias("call"), "path", "fn", "line", "col"), dim.where("kind <> 'assign'"), "path", ["pattern", "code", "kind", "arg", "filters"])
        args = self.args.select("artifact_id", "call", "pos", "node", "is_const")
        out = calls.join(args, ["artifact_id", "call"]).where(F.array_contains("arg", F.col("pos"))).drop("arg")
        target = best_match(self.binds.select("artifact_id", "file", F.col("node").alias("call"), F.regexp_replace("name", r"\.[^.]*$", "").alias("path"), F.lit(-1).alias("fn"), "line", "col", F.lit(1).alias("pos"), "node", "is_const"), dim.where("kind = 'assign'"), "path", ["pattern", "code", "kind", "filters"])
        return [out, target.select(*out.columns)]

    def validated(self) -> DataFrame:
        """``origin, tid, src_line, guard`` of sources that a validator was asked about."""
        names = [p for pr, p in dims.VALIDATORS if pr in self.profiles]
        asked = self.calls.where(F.col("path").isin(*names) if names else F.lit(False)).select("artifact_id", F.col("node").alias("call"), "path")
        nodes = asked.join(self.args, ["artifact_id", "call"]).select(gid("node").alias("node"), "path")
        return nodes.join(self.taint(), "node").groupBy("origin", "tid", "src_line").agg(F.min("path").alias("guard"))

    def proven(self) -> DataFrame:
        """The arguments of sinks that a source reaches, with the first source, its channels and its guard."""
        if not hasattr(self, "_proven"):
            args = self.sink_args().where("kind not in ('config', 'expose')").withColumn("g", gid("node"))
            hit = args.join(self.taint().withColumnRenamed("node", "g"), "g").join(self.validated(), ["origin", "tid", "src_line"], "left")
            first = F.min(F.struct("src_line", "tid", "confidence", "origin", "ctx")).alias("s")
            channels = F.array_sort(F.collect_set(F.when(F.col("channel") != "", F.col("channel")))).alias("channels")
            self._proven = stored(hit.groupBy(*args.columns).agg(F.bool_and("quoted").alias("all_q"), F.bool_or("quoted").alias("any_q"), first, channels, F.min("guard").alias("guard")), "proven")
        return self._proven

    def sinks(self) -> DataFrame:
        """Proven flows, else non-constant arguments at low confidence, and exposing calls."""
        args, proven = self.sink_args().withColumn("g", gid("node")), self.proven()
        execish = F.col("kind") == "exec"
        one = lambda c: F.when(c, 1).otherwise(0)
        steps = one(execish & F.col("all_q")) + one(execish & (F.col("filters") != "") & (F.col("pos") == 1)) + one(F.col("guard").isNotNull())
        lowered = F.when(S.confidence_rank(F.col("s.confidence")) - steps < 1, F.col("s.confidence")).otherwise(S.confidence_down(F.col("s.confidence"), steps))
        code = F.when(F.col("kind") == "dyncode", "710").when(F.col("kind").isin(*TAINT_ONLY), F.col("code")).otherwise("709")
        place = ["artifact_id", "file", F.col("path").alias("name"), "line", F.col("col").alias("column")]
        flow = lambda df, code, conf: df.select(*place, code.alias("code"), conf.alias("confidence"), F.col("s.tid").alias("source"), F.col("s.src_line").alias("src_line"), F.col("s.origin").alias("origin"), F.col("s.ctx").alias("ctx"), "channels", "guard")
        flows = flow(proven, code, lowered)
        mixed = flow(proven.where(execish & F.col("any_q") & ~F.col("all_q")), F.lit("712"), F.col("s.confidence"))
        open_ = args.where("not is_const").where(~F.col("kind").isin(*TAINT_ONLY, "config", "expose")).join(proven.select("artifact_id", "call").distinct(), ["artifact_id", "call"], "left_anti")
        shape = self._out(open_, F.col("code"), F.col("path"), F.lit("low"))
        return flows.unionByName(mixed).unionByName(shape.unionByName(self.exposing()), allowMissingColumns=True).distinct()

    def matched(self, kind: str) -> DataFrame:
        dim = dims.sinks(self.spark, self.profiles, self.extra).where(F.col("kind") == kind)
        return best_match(self.calls, dim, "path", ["code", "arg"])

    def exposing(self) -> DataFrame:
        """Calls that expose a whole tree of handlers are findings by themselves."""
        return self._out(self.matched("expose"), F.col("code"), F.col("path"), F.lit(None).cast("string"))

    def config_writes(self) -> DataFrame:
        """Writes into the configuration by name with a value the source does not state.

        The value is the declared argument; where the call has fewer, its last.
        """
        arg = F.array_sort(F.collect_list(F.struct("pos", "is_const"))).alias("given")
        calls = self.matched("config").join(self.args.groupBy("artifact_id", F.col("call").alias("node")).agg(arg), ["artifact_id", "node"])
        open_at = lambda i: F.exists("given", lambda a: (a["pos"] == i) & ~a["is_const"])
        value = F.exists("arg", open_at) | (F.exists("arg", lambda i: i > F.col("n_args")) & open_at(F.col("n_args")))
        return self._out(calls.where(value), F.col("code"), F.col("path"), F.lit(None).cast("string"))

    def shapes(self) -> DataFrame:
        """705 and 706 with a computed argument, 707 always (E-27)."""
        rows = [(i, 0, p, S.glob_regex(p), S.wildcards(p), c) for i, (p, c) in enumerate(dims.SHAPES)]
        dim = self.spark.createDataFrame(rows, "decl_no int, scope_rank int, pattern string, regex string, n_wild int, code string")
        calls = best_match(self.calls, dim, "path", ["code"])
        first = self.args.where("pos = 1").select("artifact_id", F.col("call").alias("node"), "is_const")
        hit = calls.join(first, ["artifact_id", "node"], "left").where((F.col("code") == "707") | ~F.coalesce("is_const", F.lit(True)))
        return self._out(hit, "code", F.col("path"), F.when(F.col("code") == "707", "high").otherwise("low"))

    def exposed(self) -> DataFrame:
        """Sinks in exported functions whose argument comes from a formal that no call in the file feeds."""
        fns = self.functions.where("exported is not null").select("artifact_id", "fn")
        fed = self.calls.where("target is not null").select("artifact_id", F.col("target").alias("fn")).distinct()
        unfed = fns.join(fed, ["artifact_id", "fn"], "left_anti")
        args = self.sink_args().where(~F.col("kind").isin(*TAINT_ONLY, "config", "expose")).where("not is_const").join(unfed, ["artifact_id", "fn"], "left_semi").withColumn("g", gid("node"))
        seeds = self.formals.join(unfed, ["artifact_id", "fn"], "left_semi").select(gid("node").alias("node"))
        copies = self.flow_edges().where("label in ('copy', 'quote')").select("src", "dst")
        reached = semi_naive(seeds, copies, [])[0].withColumnRenamed("node", "g")
        live = args.join(reached, "g", "left_semi").join(self.taint().select(F.col("node").alias("g")), "g", "left_anti")
        return self._out(live, F.lit("708"), F.col("path"), F.lit("low"))

    def _out(self, df: DataFrame, code, name: Column, confidence: Column, source: Column | None = None) -> DataFrame:
        code = F.col(code) if isinstance(code, str) else code
        return df.select("artifact_id", "file", code.alias("code"), name.alias("name"), "line", F.col("col").alias("column"), confidence.alias("confidence"), (source if source is not None else F.lit("")).alias("source"))

    # ---- J: detectors
    def _first_args(self) -> DataFrame:
        """Every call with what is known of its first two arguments; made once."""
        if not hasattr(self, "_firsts"):
            a = self.args.where("pos <= 2").groupBy("artifact_id", F.col("call").alias("node")).agg(*[F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("value", "lead", "is_const")])
            wanted = self.calls.where(F.col("path").isin("io.open", "os.remove", "os.rename", "os.execute", "io.popen", "io.lines") | F.col("path").endswith("sethook"))
            self._firsts = stored(wanted.join(a, ["artifact_id", "node"], "left"), "firsts")
        return self._firsts

    def files(self) -> DataFrame:
        """Opens, removals and shell writes of protected paths."""
        c = self._first_args().where(F.col("path").isin("io.open", "os.remove", "os.rename", "os.execute", "io.popen", "io.lines"))
        mode, lead = F.coalesce("value2", F.lit("r")), F.coalesce("lead1", F.lit(""))
        opens = F.col("path") == "io.open"
        writes = opens & mode.rlike("[wa+]")
        flash = self._out(c.where(writes & S.in_path_set(lead, **FLASH)), F.lit("721"), lead, F.when(F.coalesce("is_const1", F.lit(False)), "high").otherwise("medium"))
        reads = self._out(c.where((opens & ~mode.rlike("[wa+]") | (F.col("path") == "io.lines")) & S.in_path_set(lead, **SENSITIVE)), F.lit("723"), lead, F.lit("medium"))
        gone = self._out(c.where(F.col("path").isin("os.remove", "os.rename") & S.in_path_set(lead, **PROTECTED)), F.lit("726"), lead, F.lit("medium"))
        boot = c.where(opens & mode.rlike("[wa]") & S.in_path_set(lead, **BOOT))
        cmd = F.coalesce("value1", F.lit(""))
        shell = c.where(F.col("path").isin("os.execute", "io.popen")).withColumn("_t", S.redirect_targets(cmd))
        shell = shell.where(S.installs_crontab(cmd) | S.opens_port(cmd) | F.exists("_t", lambda t: S.in_path_set(t, **BOOT)) | cmd.rlike(r"\b(?:systemctl|rc-update)\s+(?:enable|add)\b"))
        persist = self._out(boot, F.lit("749"), lead, F.lit("high")).unionByName(self._out(shell, F.lit("749"), F.substring(cmd, 1, 80), F.lit("high")))
        return flash.unionByName(reads).unionByName(gone).unionByName(persist)

    def behaviour(self) -> DataFrame:
        """Backticks, environments, growth, patterns, hooks and evasion."""
        codes = {"backtick": "711", "growth": "727", "environment": "725", "evasion": "745"}
        spots = self.spots.where(F.col("kind").isin(*codes)).withColumn("code", F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("kind")])
        out = self._out(spots, F.col("code"), F.col("name"), F.col("confidence"))
        tainted = self.taint().groupBy(F.col("node").alias("g")).agg(F.min("tid").alias("tid"))
        at = self.args.select("artifact_id", F.col("call").alias("node"), "pos", F.col("node").alias("argn"), "is_const")
        pos = F.create_map(*[F.lit(x) for kv in PATTERN_APIS.items() for x in kv])
        plain = self.args.where("pos = 4 and tag = 'True'").select("artifact_id", F.col("call").alias("node"))
        searches = self.calls.where(F.col("path").isin(*PATTERN_APIS)).withColumn("pos", pos[F.col("path")]).join(at, ["artifact_id", "node", "pos"]).where("not is_const")
        finds = searches.where("path = 'string.find'").join(plain, ["artifact_id", "node"], "left_anti").unionByName(searches.where("path <> 'string.find'"))
        asked = finds.withColumn("g", gid("argn")).join(tainted, "g", "left")
        out = out.unionByName(self._out(asked, F.lit("728"), F.col("path"), F.when(F.col("tid").isNotNull(), "high").otherwise("medium"), F.coalesce("tid", F.lit(""))))
        counts = self.calls.where("path = 'string.rep'").withColumn("pos", F.lit(2)).join(at, ["artifact_id", "node", "pos"]).where("not is_const").withColumn("g", gid("argn")).join(tainted, "g")
        out = out.unionByName(self._out(counts, F.lit("727"), F.col("path"), F.lit("medium"), F.col("tid")))
        hooks = self._first_args().where((S.last_segment(F.coalesce("path", F.lit(""))) == "sethook") & F.lower(F.try_element_at(F.split("path", r"\."), F.lit(-2))).contains("debug") & F.col("is_const2").isNotNull())
        seen = F.when(~F.col("is_const2"), "low").when(F.coalesce("value2", F.lit("")).rlike("[lcr]"), "high")
        return out.unionByName(self._out(hooks.withColumn("seen", seen).where("seen is not null"), F.lit("745"), F.lit("debug.sethook"), F.col("seen")))

    def payloads(self) -> DataFrame:
        """Decoders into loaders and commands, machine code in strings."""
        by_name = S.decoder_name(F.coalesce("path", "method", F.lit(""))) | F.col("path").isin("string.char", "string.unpack", "bit.bxor", "bit32.bxor")
        seeds = self.calls.where(by_name).select(gid("node").alias("node"))
        moved = self.edges.where(F.col("label").isin("copy", "receiver") | F.col("label").startswith("arg")).select(gid("src").alias("src"), gid("dst").alias("dst"))
        decoded = semi_naive(seeds, moved, [], max_rounds=24)[0].withColumnRenamed("node", "g")
        first = self.args.where("pos = 1").select("artifact_id", F.col("call").alias("node"), gid("node").alias("g"))
        fed = self.calls.where(F.col("path").isin(*LOADERS, *EXEC_SINKS)).join(first, ["artifact_id", "node"]).join(decoded, "g", "left_semi")
        chains = self._out(fed, F.when(F.col("path").isin("os.execute", "io.popen", "package.loadlib", "ffi.load"), "743").otherwise("741"), F.col("path"), F.lit("high"))
        chars = self.calls.where(F.col("path") == "string.char").join(self.args.groupBy("artifact_id", F.col("call").alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "value", "is_const"))).alias("a")), ["artifact_id", "node"])
        number = lambda v: F.coalesce(v.try_cast("int"), F.conv(F.regexp_replace(v, "^0[xX]", ""), 16, 10).try_cast("int"), F.lit(0))
        made = chars.where(F.forall("a", lambda x: x["is_const"])).withColumn("b", F.unhex(F.array_join(F.transform("a", lambda x: F.lpad(F.hex(number(x["value"]).cast("long")), 2, "0")), "")))
        blobs = made.select("artifact_id", "file", "line", "col", "b").unionByName(self.strings.select("artifact_id", "file", "line", "col", F.encode("value", "ISO-8859-1").alias("b")).where(F.length("b") >= 12))
        shaped = blobs.withColumn("shape", blob_shape(F.col("b"))).where("shape <> 'none'")
        return chains.unionByName(self._out(shaped, F.lit("746"), F.col("shape"), F.lit("high")))

    def secrets(self) -> DataFrame:
        """J20 by the documented ladder: name tiers, value rejects, test files demoted."""
        v = F.col("value")
        reject = v.rlike(r"^/|://|%[sdx]|^[\d.]+$|^[A-Z_]+$|[\s()\[\]{}<>]|^(?:x+|changeme|example|none|null|nil|todo)$")
        tiered = self.binds.where("value is not null and is_const").withColumn("q", F.col("name").rlike(QUALIFYING)).withColumn("bare", F.col("name").rlike(BARE))
        qualified = tiered.where(F.col("q") & ~reject & (F.length(v) >= 4))
        bare = tiered.where(~F.col("q") & F.col("bare") & ~reject & (F.length(v) >= 12) & v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
        conf = F.when(S.is_test_path(F.col("file")) | v.rlike(r"(?i)^(?:anonymous|anon|ftp|guest|nobody)@"), "low").otherwise("high")
        pem = self.strings.where(FI.pem_verdict(F.col("value")) == "key")
        return self._out(qualified, F.lit("747"), F.col("name"), conf).unionByName(self._out(bare, F.lit("747"), F.col("name"), F.lit("low"))).unionByName(self._out(pem, F.lit("747"), F.lit("PEM private key"), F.lit("high")))

    def brute_force(self) -> DataFrame:
        """A loop that connects, receives and sends, one row per function."""
        last = S.last_segment(F.coalesce("method", "path", F.lit("")))
        looped = self.calls.where("loops > 0").withColumn("v", last)
        agg = looped.groupBy("artifact_id", "file", "fn").agg(F.bool_or(F.col("v") == "connect").alias("c"), F.bool_or(F.col("v").isin("receive", "read", "recv")).alias("r"), F.bool_or(F.col("v").isin("send", "write")).alias("s"), F.min(F.struct("line", "col")).alias("p"))
        return self._out(agg.where("c and r and s").select("artifact_id", "file", "p.line", "p.col"), F.lit("748"), F.lit("connect"), F.lit("medium"))

    def handlers(self) -> DataFrame:
        """Registered functions that hold an execution sink without a proven flow, one finding a registration.

        A sink with a computed argument comes before a foreign-function escape,
        and that before a command all of whose arguments are fixed, which is an
        exposure and no injection.
        """
        dim = dims.sinks(self.spark, self.profiles, self.extra).where("kind in ('exec', 'dyncode')")
        shapes = [p for p, c in dims.SHAPES if c == "707"]
        fixed = self.args.groupBy("artifact_id", F.col("call").alias("node")).agg(F.bool_and("is_const").alias("fixed"))
        told = self.proven().where("kind in ('exec', 'dyncode')").select("artifact_id", F.col("call").alias("node")).distinct()
        sinks = best_match(self.calls, dim, "path", ["kind"]).join(fixed, ["artifact_id", "node"], "left").withColumn("rank", F.when(F.coalesce("fixed", F.lit(False)), 2).otherwise(0))
        escapes = self.calls.where(F.coalesce(F.col("path"), F.lit("")).rlike("|".join(S.glob_regex(p) for p in shapes))).withColumn("rank", F.lit(1))
        keep = ["artifact_id", "node", "fn", "line", "col", "path", "rank"]
        every = gathered([df.select(*keep).join(told, ["artifact_id", "node"], "left_anti") for df in (sinks, escapes)], "held")
        first = every.groupBy("artifact_id", "fn").agg(F.min(F.struct("rank", "line", "col", "path")).alias("p"))
        names = self.functions.select("artifact_id", "fn", F.col("name").alias("given"))
        hit = self.registered.join(first, ["artifact_id", "fn"]).join(names, ["artifact_id", "fn"])
        name = F.when(F.col("given") != "", F.regexp_extract("given", r"([^.:]*)$", 1)).otherwise(F.col("key"))
        return self._out(hit, F.lit("724"), name, F.when(F.col("p.rank") == 2, "low"), F.col("p.path"))

    def signatures(self, pack: list = dims.SIGNATURES) -> DataFrame:
        """J23, E-23: once per file and signature, literals before names and comments."""
        dim = dims.signatures(self.spark, pack)
        comments = relation(self.facts, "comments").select("artifact_id", "file", F.col("text").alias("value"), "line", F.lit(1).alias("col"), F.lit(1).alias("pass"))
        names = self.names.select("artifact_id", "file", F.col("name").alias("value"), "line", F.lit(1).alias("col"), F.lit(1).alias("pass"))
        texts = self.strings.select("artifact_id", "file", "value", "line", "col", F.lit(0).alias("pass")).unionByName(names).unionByName(comments)
        some = texts.where(F.col("value").rlike(FI.quoted([a for _, p in pack for a in p.split("|")])))
        hit = some.join(F.broadcast(dim), F.contains("value", F.col("alt")))  # a pack: tens of rows
        first = hit.groupBy("artifact_id", "file", "sig_id").agg(F.min(F.struct("pass", "line", "col")).alias("p"))
        return self._out(first.select("artifact_id", "file", "sig_id", "p.line", "p.col"), F.lit("750"), F.col("sig_id"), F.lit("certain"))

    def capabilities(self, standard: str = "lua54") -> DataFrame:
        """Syntax and modules that the standard lacks, once per capability."""
        # Which standard has which capability (fixed values).
        has = {"integer_division": "lua53 lua54", "shift_left": "lua53 lua54", "shift_right": "lua53 lua54", "bitwise_not": "lua53 lua54", "ffi": "luajit", "jit": "luajit", "bit32": "lua52 lua53"}
        lacking = [c for c, s in has.items() if standard not in s.split()]
        uses = self.spots.where("kind = 'syntax'").select("artifact_id", "file", "name", "line", "col").unionByName(self.reads.where(F.col("path").isin("ffi", "jit", "bit32")).select("artifact_id", "file", F.col("path").alias("name"), "line", F.lit(1).alias("col")))
        first = uses.where(F.col("name").isin(*lacking)).groupBy("artifact_id", "file", "name").agg(F.min(F.struct("line", "col")).alias("p"))
        return self._out(first.select("artifact_id", "file", "name", "p.line", "p.col"), F.lit("903"), F.col("name"), F.lit("medium"))

    def store_hops(self) -> DataFrame:
        """I06, J15, E-16: request data written to a store and read back into a command."""
        pats = {p: (d, t, c, v) for pr, d, p, t, c, v in dims.STORES if pr in self.profiles}
        if not pats:
            return self._out(self.calls.where("false"), F.lit("729"), F.col("path"), F.lit("low"))
        from .flow import pair_stores

        arg = self.args.select("artifact_id", F.col("call").alias("node"), "pos", "value", F.col("node").alias("argn"))
        take = lambda i: F.create_map(*[F.lit(x) for p, s in pats.items() for x in (p, s[i])])[F.col("path")]
        calls = self.calls.where(F.col("path").isin(*pats)).withColumn("dir", take(0)).withColumn("tp", take(1)).withColumn("cp", take(2)).withColumn("vp", take(3))
        wide = calls.join(arg, ["artifact_id", "node"]).groupBy("artifact_id", "file", "node", "line", "col", "path", "dir").agg(
            F.max(F.when(F.col("pos") == F.col("tp"), F.col("value"))).alias("table"), F.max(F.when(F.col("pos") == F.col("cp"), F.col("value"))).alias("column"), F.max(F.when(F.col("pos") == F.col("vp"), F.col("argn"))).alias("vnode"))
        wide = wide.where("table is not null").withColumn("column", F.coalesce("column", F.lit("*")))
        tainted = self.taint().select(F.col("node").alias("g")).distinct()
        writes = wide.where("dir = 'write'").withColumn("g", gid("vnode")).join(tainted, "g", "left_semi").select("table", "column", F.format_string("%s:%09d", "file", "line").alias("writer"))
        reads = wide.where("dir = 'read'").select(gid("node").alias("node"), "table", "column")
        reached, _ = semi_naive(reads.select("node", F.concat_ws(".", "table", "column").alias("tid")), self.flow_edges().select("src", "dst"), [], ["tid"])
        args = self.sink_args().where("kind = 'exec'").withColumn("g", gid("node"))
        pending = args.join(reached.withColumnRenamed("node", "g"), "g").select("artifact_id", "file", "line", "col", "path", F.substring_index("tid", ".", 1).alias("table"), F.substring_index("tid", ".", -1).alias("column"))
        paired = pair_stores(pending, writes, ["artifact_id", "file", "line", "col", "path"])
        return self._out(paired, F.lit("729"), F.col("path"), F.lit("medium"), F.col("writer"))

    def gaps(self) -> DataFrame:
        """901 for what does not parse, 904 for what is too large, 012 for unreadable directives."""
        at = self.facts.select("artifact_id", F.col("path").alias("file"), "status", "message", "line", F.lit(1).alias("col"), "node_count")
        bad = self._out(at.where("status = 'unparsed'"), F.lit("901"), F.col("message"), F.lit("medium"))
        big = self._out(at.where("status = 'degraded'"), F.lit("904"), F.col("node_count").cast("string"), F.lit("certain"))
        many = self.functions.groupBy("artifact_id", "file").agg(F.count("*").alias("n")).where(F.col("n") > MAX_FUNCTIONS).select("*", F.lit(1).alias("line"), F.lit(1).alias("col"))
        big = big.unionByName(self._out(many, F.lit("904"), F.concat(F.col("n").cast("string"), F.lit(" functions")), F.lit("certain")))
        unread = directives(self.facts).where("action = 'unreadable'").withColumn("col", F.lit(1))
        return bad.unionByName(big).unionByName(self._out(unread, F.lit("012"), F.lit("directive"), F.lit("medium")))

    def raw_findings(self) -> DataFrame:
        """All detectors together, one after the other: a plan of them all is too large for a small driver."""
        own = (self.sinks, self.shapes, self.exposed, self.config_writes, self.files, self.behaviour, self.payloads, self.secrets, self.brute_force, self.handlers, self.signatures, self.capabilities, self.store_hops, self.gaps)
        return gathered([*(part() for part in own), *(detector(self) for detector in self.detectors)], "raw")

    def diagnostics(self) -> DataFrame:
        """``counter, n`` of the scan; a bound that was hit is a row above zero."""
        self.taint()
        count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        crossing = self.sites().where("to <> artifact_id")
        parts = [("artifacts", self.facts), ("unparsed", self.facts.where("status = 'unparsed'")), ("degraded", self.facts.where("status = 'degraded'")), ("calls", self.calls), ("sites", self.sites()), ("crossing_sites", crossing), ("files_with_cut_sites", self._cut_sites), ("taint_facts", self.taint())]
        out = self.spark.createDataFrame([("fixpoint_bound", int(self.hit_bound))], "counter string, n long")
        for name, df in parts:
            out = out.unionByName(count(df, name))
        return out

    def traced(self, found: DataFrame) -> DataFrame:
        """Proven flows with the file of their source, and ``trace``: source, the call it came in by, sink."""
        names = self.facts.select(F.col("artifact_id").cast("string").alias("_a"), F.col("path").alias("_file"))
        sites = self.calls.select(gid("node").alias("_s"), F.col("line").alias("_line"), F.coalesce("path", "method").alias("_path"), F.col("file").alias("_by"))
        out = found.join(names, F.col("origin") == F.col("_a"), "left").join(sites, F.col("ctx") == F.col("_s"), "left")
        step = lambda kind, line, name, file: F.struct(F.lit(kind).alias("kind"), line.alias("line"), name.alias("name"), file.alias("file"))
        steps = F.array(step("source", F.col("src_line"), F.col("source"), F.col("_file")), F.when(F.col("_s").isNotNull(), step("call", F.col("_line"), F.col("_path"), F.col("_by"))), step("sink", F.col("line"), F.col("name"), F.col("file")))
        trace = F.when(F.col("origin").isNotNull(), F.array_compact(steps))
        return out.withColumn("trace", trace).withColumn("origin", F.when(F.col("origin").isNotNull(), F.coalesce("_file", F.lit("")))).drop("_a", "_file", "_s", "_line", "_path", "_by", "src_line", "ctx")

    def findings(self) -> DataFrame:
        """The report: coverage, store pairing, directives, catalogue, normal form (section 3 order)."""
        self._tell("flow")
        self.taint()
        self._tell("detect")
        raw = self.raw_findings()
        self._tell("report")
        shaped = cover(raw)
        hop = raw.where("code = '729'").select("file", "line", "column").distinct()
        kept = shaped.where("code not in ('701', '702')").unionByName(shaped.where("code in ('701', '702')").join(hop, ["file", "line", "column"], "left_anti"))
        flagged = apply_directives(stored(kept, "kept"), directives(self.facts).where("action <> 'unreadable'").select("file", "line", "action", "pattern", "push"), mark=True)
        full = FI.with_catalogue(stored(flagged, "flagged").withColumn("end_column", F.col("column")).withColumn("status", F.lit(None).cast("string")))
        literal = (F.col("code") == "724") & (F.col("confidence") == "low")  # a fixed command is an exposure, not an injection
        note = F.concat(F.when(literal, " - the command is a literal, so this is an exposure, not an injection").otherwise(""),
            F.when(F.size("channels") > 0, F.concat(F.lit(" [reachable from: "), F.array_join("channels", ", "), F.lit("]"))).otherwise(""),
            F.when(F.col("guard").isNotNull(), F.concat(F.lit(" (guarded by "), F.col("guard"), F.lit("; verify it rejects shell metacharacters)"))).otherwise(""))
        full = full.withColumn("severity", F.when(literal, "medium").otherwise(F.col("severity"))).withColumn("message", F.concat(F.replace("message", F.lit("{note}"), F.lit("")), note))
        return FI.normalise(self.traced(full.drop("channels", "guard")))


def scan(artifacts: DataFrame, profiles: tuple[str, ...] = (), extra: dict | None = None, **options) -> DataFrame:
    """Findings of ``artifact_id, path, body`` rows; ``options`` as :class:`Scan` takes them."""
    return Scan(artifacts, profiles, extra, **options).findings()
