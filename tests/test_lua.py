"""Lua front end and scan: programs, silence, metamorphic pairs, growth, artifacts."""

import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.lua_facts import extract
from sparkwarden.functions.lua_syntax import LuaError, parse, tokenize
from sparkwarden.operators.flow import as_of, pair_stores, semi_naive
from sparkwarden.operators.lua_scan import Scan, scan
from sparkwarden.operators.match import best_match, longest_prefix
from sparkwarden.plans.lua_queries import PROGRAMS
from sparkwarden.sources import artifacts as A


def findings(spark, bodies, profiles=()):
    rows = [(i, f"src/m{i}.lua", b) for i, b in enumerate(bodies)]
    got = scan(spark.createDataFrame(rows, "artifact_id long, path string, body string"), profiles).collect()
    out = [[] for _ in bodies]
    for r in got:
        out[int(r["file"][5:-4])].append((r["code"], r["line"], r["confidence"]))
    return [sorted(x) for x in out]


@pytest.mark.parametrize("text", ["x = ", "local function (", "for in", "a.b", "((((", "x = 'a", "f(", "goto 1", "{" * 500, "a" + ".b" * 10 + "=", "return return"])
def test_bad_sources_are_values(text):
    with pytest.raises(LuaError):
        parse(text)
    assert extract(1, "a", text)["status"] == "unparsed"


def test_grammar_of_all_versions():
    root, comments, _ = parse(
        '#!/usr/bin/lua\nlocal x <const>, y = 0x1F, 1e-3 -- c\n::top:: goto top\nfor i = 1, 2, 3 do if i then break elseif y then else end end\nrepeat local z = [==[a]]b]==] until z\n'
        'local t = {1; ["k"] = 2, k = 3, f = function(a, ...) return ... end}\nt.f"s" t:f{} (t).k = not -#x ^ 2 // 3 << 1 & 2 | 3 ~ 4 .. "\\x41\\u{42}\\67\\z\n  d"\n--[[ long\n]] return t')
    assert root.tag == "Block" and [c[0] for c in comments] == [2, 9]
    strings = [n for n in tokenize('"\\x41\\u{42}\\67\\z  d\\q"')[0] if n.kind == "string"]
    assert strings[0].value == "ABCdq"


def test_precedence():
    e = parse("x = 1 + 2 * 3 ^ 4 ^ 5 .. 'a' .. 'b' == 6 and 7 or not 8")[0].kids[0].kids[1]
    show = lambda n: str(n.value) if not n.kids else f"({show(n.kids[0])}{n.value}{show(n.kids[1])})" if len(n.kids) == 2 else f"({n.value[1:]} {show(n.kids[0])})"
    assert show(e) == "((((1+(2*(3^(4^5))))..(a..b))==6)and7)or(not 8))".replace("((((1", "(((((1", 1)


@pytest.mark.parametrize("family,profiles", [("taint", ()), ("quote", ("luci",)), ("payload", ()), ("firmware", ()), ("config", ("openwrt", "luci")), ("handlers", ("openwrt", "luci")), ("watchdog", ()), ("calls", ())])
def test_programs(spark, family, profiles):
    bodies = [p.replace("%d", "7") for p, _ in PROGRAMS[family]]
    want = [sorted((c, line, conf) for c, line, conf, _ in found) for _, found in PROGRAMS[family]]
    assert findings(spark, bodies, profiles) == want


def test_metamorphic_pairs(spark):
    base = 'local a = http.formvalue("x")\nlocal b = "ls " .. a\nos.execute(b)\n'
    same = [base, base.replace("local a", "local q").replace(".. a", ".. q"), base.replace("os.execute(b)", "   os.execute( ((b)) )"), base.replace("os.execute", "local e = os.execute e")]
    got = findings(spark, same)
    assert all(x == got[0] for x in got) and got[0] == [("709", 3, "certain")]


def test_silent_sources(spark):
    bodies = ["", "-- nothing", 'local t = {}\nt[1] = "x"\nprint(#t)', 'local n = tonumber("5")\nfor i = 1, n do print(i) end', 'os.execute("true" .. " && " .. "false")', 'local password = os.getenv\nlocal pwd_file = "/etc/passwd"', 'for k in pairs(t) do s = s .. k end']
    assert findings(spark, bodies) == [[] for _ in bodies]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")] + [(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    got, bound = semi_naive(spark.createDataFrame([("a",), ("n0",)], "node string"), edges, [])
    assert sorted(r["node"] for r in got.collect()) == sorted(["a", "b", "c", "d"] + [f"n{i}" for i in range(13)]) and not bound
    got, bound = semi_naive(spark.createDataFrame([("n0",)], "node string"), edges, [], max_rounds=3)
    assert got.count() == 4 and bound


def test_store_keys(spark):
    reads = spark.createDataFrame([(1, "T", "a"), (2, "T", "*"), (3, "T", "z"), (4, "U", "a")], "id long, table string, column string")
    writes = spark.createDataFrame([("T", "a", 10), ("T", "*", 20), ("T", "b", 5)], "table string, column string, writer long")
    got = {r["id"]: (r["writer"], r["n_writers"]) for r in pair_stores(reads, writes, ["id"]).collect()}
    assert got == {1: (10, 2), 2: (5, 3), 3: (20, 1)}


def test_as_of_and_prefixes(spark):
    d = spark.createDataFrame([("f", 1, "x"), ("f", 5, "y")], "fn string, at int, value string")
    u = spark.createDataFrame([("f", 1, 0), ("f", 5, 1), ("f", 6, 2)], "fn string, at int, use_id long")
    assert {r["use_id"]: r["value"] for r in as_of(u, d, ["fn"], "at").collect()} == {0: None, 1: "x", 2: "y"}
    p = spark.createDataFrame([("a.b.c",), ("a.bc",), ("x",)], "path string")
    k = spark.createDataFrame([("a",), ("a.b",)], "key string")
    assert {r["path"]: r["key"] for r in longest_prefix(p, k).collect()} == {"a.b.c": "a.b", "a.bc": "a"}


def test_best_match_takes_the_first_declared(spark):
    dim = spark.createDataFrame([(0, 1, "a.*", "^a\\..*$", 1, "x"), (1, 0, "a.*b", "^a\\..*b$", 1, "y"), (2, 1, "a.b", "a.b", 0, "z")], "decl_no int, scope_rank int, pattern string, regex string, n_wild int, id string")
    calls = spark.createDataFrame([("a.b",), ("a.c",), ("q",)], "path string")
    assert {r["path"]: r["id"] for r in best_match(calls, dim, "path", ["id"], how="left").collect()} == {"a.b": "y", "a.c": "x", "q": None}


@pytest.mark.parametrize("shape", ["local a{i} = x\nf(a{i} .. 'y')\n", "function g{i}(p) return p end\ng{i}(1)\n", "if a then b = {i} else b = c end\n", "t.k{i} = t.j{i}\n"])
def test_facts_grow_with_the_source(shape):
    def seconds(n):
        text = "".join(shape.replace("{i}", str(i)) for i in range(n))
        began = time.process_time()
        extract(1, "a", text, max_nodes=10**9)
        return time.process_time() - began

    seconds(50)
    assert seconds(1600) / max(seconds(400), 0.005) < 8


def test_large_and_deep_sources_are_told(spark):
    assert extract(1, "a", "f(1)\n" * 8000)["status"] == "degraded"
    assert extract(1, "a", "x = " + "(" * 150 + "1" + ")" * 150)["status"] == "ok"
    assert findings(spark, ["f(1)\n" * 8000])[0] == [("904", 1, "certain")]


# ---------------------------------------------------------------- artifacts


def test_reading_a_tree(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / ".git" / "x.lua").write_text("a")
    (tmp_path / "d" / "a.lua").write_text("os.execute(x)")
    (tmp_path / "b.luac").write_bytes(b"\x1bLua\x54\x00\x19\x93\r\n\x1a\n\x04\x08\x08" + (0x5678).to_bytes(8, "little") + b"\x00\x00\x00\x00\x00\x28\x77\x40" + b"..os.\x00execute")
    (tmp_path / "p.html").write_text("<p>\n<?lua os.execute(y) ?>\n")
    (tmp_path / "e").symlink_to("/nowhere/x")
    from sparkwarden.engine import Engine

    e = Engine(spark)
    got = e.read([str(tmp_path / "d"), str(tmp_path / "b.luac"), str(tmp_path / "p.html")])
    assert {r["path"].rsplit("/", 1)[1]: r["route"] for r in got.collect()} == {"a.lua": "analyze", "b.luac": "triage", "p.html": "template"}
    found = {(r["file"].rsplit("/", 1)[1], r["code"], r["line"]) for r in e.scan(got).collect()}
    assert {("a.lua", "701", 1), ("p.html", "701", 2), ("b.luac", "801", 1)} <= found
    kinds = {(k, p.rsplit("/", 1)[1]) for k, p, _ in A.listing(str(tmp_path))}
    assert kinds == {("f", "a.lua"), ("f", "b.luac"), ("f", "p.html"), ("l", "e")}


@pytest.mark.parametrize("raw,kind", [(b"\x1bLua\x51", "bytecode"), (b"\x1bLJ\x02", "luajit-bytecode"), (b"\x7fELF...", "elf"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"), (b"ab\x00", "binary"), (b"local a", None), (b"", None), (b"x" * 257 + b"ustar", "tar")])
def test_binary_kinds(spark, raw, kind):
    assert spark.createDataFrame([(bytearray(raw),)], "raw binary").select(A.binary_kind(F.col("raw"))).first()[0] == kind


@pytest.mark.parametrize("path,body,lua", [("a.lua", "", True), ("a.js", "local x", False), ("README.md", "local x", False), ("x", "#!/usr/bin/env -S lua5.1\n", True), ("x", "#!/bin/sh\nlua", False), ("x", "# c", False), ("x", "local a = 1", True), ("x", "hello", False), ("x", "---- a", False), ("x", "-- a", True), ("Makefile.lua", "", False), ("x.lp", "<% a %>", True), ("nginx.conf", "content_by_lua_block {}", True), ("nginx.conf", "server {}", False)])
def test_is_source(spark, path, body, lua):
    assert spark.createDataFrame([(path, body)], "p string, b string").select(A.is_source(F.col("p"), F.col("b"))).first()[0] is lua


def test_extraction_keeps_places():
    text = "<p>é\r\n<?lua local a = '}' ?>\n<%= b %> x"
    for path in ("a.html", "a.lp"):
        out = A.extract_template(text, path)
        assert len(out) == len(text) and [i for i, c in enumerate(out) if c in "\r\n"] == [i for i, c in enumerate(text) if c in "\r\n"]
    assert "_ =" in A.extract_template(text, "a.lp") and "b" not in A.extract_template(text, "a.html").split("\n")[2]
    conf = 'a "x_by_lua_block {";\ncontent_by_lua_block {\n  local s = "}" -- }\n  f{1}\n}\n# access_by_lua_block { no }\n'
    got = A.extract_conf(conf)
    assert got.count("\n") == conf.count("\n") and parse(got)[0].kids and "no" not in got


@pytest.mark.parametrize("raw,flavor,problem", [(b"\x1bLua\x51\x00\x01\x04\x08\x04\x08\x00", "lua", ""), (b"\x1bLua\x54\x00", "lua", "truncated"), (b"\x1bLua\x60", "lua", "unknown version"), (b"\x1bLJ\x02\x00", "luajit", ""), (b"xx", "", "no signature")])
def test_headers(raw, flavor, problem):
    h = A.bytecode_header(raw)
    assert (h["flavor"], h["problem"]) == (flavor, problem)


def chunk(version, strings, children=()):
    """A compiled chunk of one function with string constants and child functions, written by hand."""
    if version == 0x51:
        head = b"\x1bLua\x51\x00\x01\x04\x08\x04\x08\x00"
        num = lambda n: n.to_bytes(4, "little")
        text = lambda t: (len(t) + 1).to_bytes(8, "little") + t + b"\0"
        none, fixed, pair, tail = (0).to_bytes(8, "little"), bytes(4), None, num(0) * 3
    else:
        head = b"\x1bLua\x54\x00\x19\x93\r\n\x1a\n\x04\x08\x08" + (0x5678).to_bytes(8, "little") + bytes.fromhex("0000000000287740") + b"\x01"
        num = lambda n: bytes([n | 0x80]) if n < 128 else bytes([n >> 7, n & 0x7F | 0x80])
        text = lambda t: num(len(t) + 1) + t
        none, fixed, pair, tail = num(0), bytes(3), num(0), num(0) * 4

    def function(strings, children=()):
        kids = b"".join(function(*x) for x in children)
        return none + num(0) + num(0) + fixed + num(1) + bytes(4) + num(len(strings) + 1) + b"".join(b"\x04" + text(t) for t in strings) + b"\x00" + (pair or b"") + num(len(children)) + kids + tail

    return head + function(strings, children)


@pytest.mark.parametrize("version", [0x51, 0x54])
def test_prototypes_of_chunks(spark, version):
    raw = chunk(version, [b"os", b"execute"], [([b"io", b"popen"], ()), ([b"x" * 200], [([b"deep"], ())])])
    got = [(p, v) for p, _, kind, v in A.prototypes(raw) if kind == "string"]
    assert got == [(0, "os"), (0, "execute"), (1, "io"), (1, "popen"), (2, "x" * 200), (3, "deep")]
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:-9])), (3, None)], "artifact_id long, raw binary")
    rows = A.bytecode_constants(df).collect()
    assert {r["artifact_id"] for r in rows} == {1} and sum(r["kind"] == "nil" for r in rows) == 4
    for n in range(12, len(raw)):
        with pytest.raises(ValueError):
            A.prototypes(raw[:n])
    deep = ([b"a"], ())
    for _ in range(80):
        deep = ([b"a"], [deep])
    with pytest.raises(ValueError):
        A.prototypes(chunk(version, *deep))


def test_chains_and_unreadable_files(spark):
    from sparkwarden.operators.flow import walk_back

    callers = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (7, 8), (8, 7)] + [(100 + i, 99 + i) for i in range(1, 30)], "to long, by long")
    got = {r["to"]: list(r["chain"]) for r in walk_back(callers).collect()}
    assert got[4] == [3, 2, 1] and got[7] == [8] and got[8] == [7] and len(got[129]) == 16
    listed = spark.createDataFrame([("a", 1), ("b", 2)], "path string, length long")
    read = A.with_unreadable(listed, spark.createDataFrame([("a", bytearray(b"x"))], "path string, raw binary"))
    assert {r["path"]: r["raw"] for r in read.collect()} == {"a": b"x", "b": None}


def test_bounds_of_sites_and_traces(spark, monkeypatch):
    from sparkwarden.operators import lua_scan
    from sparkwarden.operators.lua_scan import Scan

    util = [(i, f"lib/u{i}.lua", f"local M = {{}}\nfunction M.run(c)\n  os.execute(c)\nend\nreturn M\n") for i in range(3)]
    main = (9, "app/main.lua", "".join(f'require("u{i}").run(http.formvalue("c"))\n' for i in range(3)))
    rows = spark.createDataFrame([*util, main], "artifact_id long, path string, body string")
    found = Scan(rows).findings().where("code = '709'").collect()
    assert sorted((r["file"], r["origin"]) for r in found) == [(f"lib/u{i}.lua", "app/main.lua") for i in range(3)]
    assert all([s["kind"] for s in r["trace"]] == ["source", "call", "sink"] for r in found)
    monkeypatch.setattr(lua_scan, "MAX_SITES", 2)
    cut = Scan(rows)
    assert cut.findings().where("code = '709'").count() == 2
    assert {r["counter"]: r["n"] for r in cut.diagnostics().collect()}["files_with_cut_sites"] == 1
    assert {r["artifact_id"]: list(r["chain"]) for r in cut.chains().collect()} == {0: [9], 1: [9]}
    monkeypatch.setattr(lua_scan, "MAX_FUNCTIONS", 1)
    large = Scan(rows)
    assert {r["code"] for r in large.findings().collect()} >= {"904"} and large.findings().where("code = '709'").count() == 0


def test_validators_channels_and_guards(spark):
    body = 'function PingHandler(host)\n  if validations.is_ipv4_address(host) then\n    os.execute("ping " .. host)\n  end\nend\n'
    got = scan(spark.createDataFrame([(1, "a.lua", body)], "artifact_id long, path string, body string"), ("cgilua",)).where("code = '709'").collect()
    assert [(r["line"], r["confidence"]) for r in got] == [(3, "low")]
    assert "[reachable from: web]" in got[0]["message"] and "guarded by validations.is_ipv4_address" in got[0]["message"]


def test_one_source_that_fails_does_not_end_the_scan(spark, monkeypatch):
    from sparkwarden.functions import lua_shapes

    def broken(f):
        raise KeyError("x")

    monkeypatch.setattr(lua_shapes, "growth", broken)
    got = extract(1, "a", "local x = 1\n")
    assert got["status"] == "unparsed" and got["message"] == "analysis failed: KeyError" and got["calls"] == []


def test_custom_detectors_progress_and_source_enabled_findings(spark):
    from sparkwarden.engine import Engine

    stages = []

    def listener(stage):
        stages.append(stage)
        raise RuntimeError("ignored")

    def shouting(s):
        return s.calls.where("path = 'print'").select("artifact_id", "file", F.lit("726").alias("code"), F.col("path").alias("name"), "line", F.col("col").alias("column"), F.lit("high").alias("confidence"), F.lit("").alias("source"))

    body = "print(1)\nos.execute(x)\n-- sparkwarden: enable 702\nio.popen(y)\n"
    rows = spark.createDataFrame([(1, "a.lua", body)], "artifact_id long, path string, body string")
    e = Engine(spark, detectors=[shouting], progress=listener)
    got = e.scan(rows)
    assert sorted((r["code"], r["line"]) for r in got.collect()) == [("701", 2), ("702", 4), ("726", 1)] and stages == ["parse", "flow", "detect", "report"]
    assert [r["code"] for r in e.select(got, ignore=["70%d"]).where("code <> '726'").collect()] == ["702"]
    with pytest.raises(ValueError):
        Engine(spark, colour=True)


def test_server_configurations_bring_their_registry(spark):
    from sparkwarden.engine import Engine

    conf = "content_by_lua_block {\n  ngx.exec(ngx.var.arg_x)\n}\n"
    rows = A.extracted(A.from_rows(spark.createDataFrame([("nginx.conf", conf), ("a.lua", "ngx.exec(x)\n")], "path string, body string")).withColumn("body", F.decode("raw", "UTF-8")).withColumn("route", A.route(F.col("path"), F.col("raw"), F.decode("raw", "UTF-8"))))
    got = {(r["file"], r["code"]) for r in Engine(spark).scan(rows).collect()}
    assert {f for f, c in got if c in ("701", "709")} == {"nginx.conf"}


def test_no_plan_holds_all_detectors(spark):
    """The driver's memory follows the largest plan; one of all detectors had 878 nodes."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.range(1).collect()
    seen = store.executionsCount()
    rows = [(i, f"src/m{i}.lua", body) for i, (body, _) in enumerate(PROGRAMS["handlers"] + PROGRAMS["firmware"])]
    got = scan(spark.createDataFrame(rows, "artifact_id long, path string, body string"), ("openwrt", "luci")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(got) > 10
    ran = store.executionsList()
    sizes = [store.planGraph(ran.apply(i).executionId()).allNodes().size() for i in range(seen, ran.size())]
    assert sizes and max(sizes) < 400


def test_calls_into_other_files_are_found_once(spark):
    """The plan of the sites held the search for them twice, for their rows and for their count."""
    util, main = "local M = {}\nfunction M.run(c)\n  os.execute(c)\nend\nreturn M\n", 'local u = require "util"\nu.run(http.formvalue("c"))\n'
    s = Scan(spark.createDataFrame([(1, "lib/util.lua", util), (2, "app/main.lua", main)], "artifact_id long, path string, body string"))
    assert [(r["artifact_id"], r["to"]) for r in s.sites().collect()] == [(2, 1)]
    assert s._cut_sites.collect() == []
    read = s._cut_sites.inputFiles()
    assert read and all("/far-" in f for f in read)  # what was found, not the facts again


def test_a_small_driver_gives_memory_back(spark, monkeypatch):
    from sparkwarden.operators import flow

    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and b.getName() != "Copy")
    for most, least in ((0, 0), (1 << 50, 2)):
        monkeypatch.setattr(flow, "SMALL_HEAP", most)
        before = whole()
        for i in range(2 * flow.RELIEF):
            assert flow.stored(spark.range(i), "few").count() == i
        assert (whole() - before >= least) if least else (flow.relieve(spark) is False)
    assert flow.relieve(spark) is True


def test_rounds_ask_once_whether_they_found_anything(spark):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    seeds, edges = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    bus.waitUntilEmpty(30_000)
    seen = store.executionsCount()
    got, hit = semi_naive(seeds, edges, [])
    bus.waitUntilEmpty(30_000)
    assert store.executionsCount() - seen == 7  # seeds, edges and two rounds written, three times asked
    assert not hit and sorted(r["node"] for r in got.collect()) == ["a", "b"]


@pytest.mark.parametrize("family, profiles", [("config", ("openwrt", "luci")), ("taint", ())])
def test_parts_of_a_scan_are_planned_one_by_one(spark, family, profiles):
    """Edges, sites, seeds, sinks and the report were plans of several searches each; the driver's memory follows the largest."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    rows = [(i, f"src/m{i}.lua", body.replace("%d", str(i))) for i, (body, _) in enumerate(PROGRAMS[family])]
    bus.waitUntilEmpty(30_000)
    seen = store.executionsCount()
    got = scan(spark.createDataFrame(rows, "artifact_id long, path string, body string"), profiles).collect()
    assert sorted((int(r["file"][5:-4]), r["code"], r["line"], r["confidence"]) for r in got) == sorted((i, c, line, conf) for i, (_, found) in enumerate(PROGRAMS[family]) for c, line, conf, _ in found)
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    sizes = [store.planGraph(ran.apply(i).executionId()).allNodes().size() for i in range(seen, ran.size())]
    assert sizes and max(sizes) < 100  # up to 127 before


def test_a_small_driver_keeps_little_of_its_heap_free(spark, monkeypatch):
    import gc

    from sparkwarden.operators import flow

    monkeypatch.setattr(flow, "SMALL_HEAP", 1 << 50)
    jvm = spark.sparkContext._jvm
    heap = lambda: jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    held = [spark.sparkContext._gateway.new_array(jvm.byte, 8 << 20) for _ in range(40)]
    del held
    gc.collect()
    assert flow.relieve(spark)
    assert heap().getCommitted() < 1.6 * heap().getUsed()
    assert [flow._option(spark, name) for name in flow.KEPT_FREE] == ["40", "70"]  # as they were


def test_no_relation_is_broadcast_by_the_size_of_its_file(spark):
    """Facts that repeat each other have small files: their rows were gathered by the driver however many there were."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    programs = PROGRAMS["config"]
    n = 300 * len(programs)
    rows = [(i, f"src/m{i}.lua", programs[i % len(programs)][0].replace("%d", str(i))) for i in range(n)]
    artifacts = spark.createDataFrame(rows, "artifact_id long, path string, body string").repartition(2)
    bus.waitUntilEmpty(30_000)
    seen = store.executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = scan(artifacts, ("openwrt", "luci")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(found) == 300 * sum(len(f) for _, f in programs)
    bus.waitUntilEmpty(30_000)
    ran, sent = store.executionsList(), {}
    for i in range(seen, ran.size()):
        at = ran.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                ids = [node.metrics().apply(k) for k in range(node.metrics().size())]
                sent |= {m.accumulatorId(): int(values.apply(m.accumulatorId()).replace(",", "")) for m in ids if m.name() == "number of output rows" and values.contains(m.accumulatorId())}
    assert sent and max(sent.values()) < 2000  # 64 kB are at most some 1,600 rows
