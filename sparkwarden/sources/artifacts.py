"""Artifacts: reading, listing, classifying and extracting.

Listing and byte-level decoding run in Python where a path or a byte string is
opened; everything about the resulting table is Column expressions.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WALK_LIMIT = 50_000
SNIFF, HEAD = 8192, 512
# Extensions and names that decide without a look inside (fixed values).
NOT_SOURCE = tuple(".c .h .cc .cpp .hpp .o .a .so .ko .py .pl .sh .js .css .md .txt .rst .json .xml .yml .yaml .ini .png .jpg .gif .svg .pdf .zip .gz .bz2 .xz .tar .patch .diff .po .pc .mk .rules .list .in .spec .t .stp".split())
SOURCE = (".lua", ".luac", ".rockspec")
NOT_SOURCE_NAMES = ("license", "copying", "authors", "changes", "news", "configure", "install", "todo")
NOT_SOURCE_FAMILIES = ("makefile", "gnumakefile", "kbuild", "kconfig", "readme", "changelog")
OPENERS = r"^(?:--|local\s|require\s*\(|function\s|module\s*\(|return\s|[A-Za-z]+\s*=\s*function|do$)"
NOT_SOURCE_HEADS = r"^(?:diff -- |---- |\+\+\+ |@@ |-----BEGIN|-------BEGIN)"
INTERPRETER = r"^lua[jt]?[A-Za-z0-9.\-]*$"
CONTROL = "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]"
TEMPLATES = (".html", ".htm", ".lp")


def read(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``artifact_id, path, raw, length`` of every file under the roots, once per path.

    Reads with Spark's own binary reader, so any store it can open will do; a
    ``.git`` component is skipped.  A file that is listed and cannot be read has
    a null ``raw`` (A09).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(roots)
    files = files.where(~F.col("path").rlike(r"(^|/)\.git(/|$)")).dropDuplicates(["path"])
    return with_unreadable(files.select("path", "length"), files.select("path", F.col("content").alias("raw")))


def with_unreadable(listed: DataFrame, contents: DataFrame) -> DataFrame:
    """Every listed file, with its bytes where there are any."""
    return listed.join(contents, "path", "left").select(F.xxhash64("path").alias("artifact_id"), "path", "raw", "length")


def manifest_check(manifest: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``key, n, ok`` of every manifest entry: what was found for it, and whether that reaches its ``floor``."""
    n = F.coalesce("n", F.lit(0))
    return manifest.join(counted, key, "left").select(key, n.alias("n"), (n >= F.col("floor")).alias("ok"))


def from_rows(df: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """A10: rows of text as artifacts."""
    return df.select(F.xxhash64(path).alias("artifact_id"), F.col(path).alias("path"), F.encode(body, "UTF-8").alias("raw"), F.octet_length(body).cast("long").alias("length"))


def listing(root: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, path, target)`` of a local tree in sorted order; kinds f, l, u.

    Absolute links are looked up inside the root first.
    """
    queue = [root]
    while queue:
        top = queue.pop(0)
        try:
            entries = sorted(os.scandir(top), key=lambda e: e.name)
        except OSError:
            yield "u", top, ""
            continue
        for e in entries:
            if e.name == ".git":
                continue
            if e.is_symlink():
                target = os.readlink(e.path)
                inside = os.path.join(root, target.lstrip("/")) if target.startswith("/") else os.path.join(top, target)
                yield ("f" if os.path.isfile(inside) else "l"), e.path, inside
            elif e.is_dir():
                queue.append(e.path)
            elif e.is_file():
                yield "f", e.path, ""


def limited(files: DataFrame, limit: int = WALK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Files of each root up to the limit, and a problem row for each root beyond it."""
    w = Window.partitionBy("root").orderBy("path")
    kept = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    over = files.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return kept, over.select(F.lit("901").alias("code"), "root", F.format_string("%d of %d paths were listed", F.lit(limit), F.col("n")).alias("message"))


def dangling(links: DataFrame, runtime: tuple[str, ...] = ("/proc", "/sys", "/dev", "/run", "/tmp", "/var/run")) -> DataFrame:
    """One row per root about links that lead nowhere, runtime targets aside."""
    test = F.lit(False)
    for r in runtime:
        test = test | F.col("target").startswith(r + "/") | (F.col("target") == r)
    return links.where(~test).groupBy("root").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def changed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files that a table of changed paths names."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def binary_kind(raw: Column) -> Column:
    """Container or bytecode by leading bytes; null for text."""
    head = F.hex(F.substring(raw, 1, 4))
    return (
        F.when(head == "1B4C7561", "bytecode").when(F.hex(F.substring(raw, 1, 3)) == "1B4C4A", "luajit-bytecode").when(head.isin("68737173", "73717368"), "squashfs").when(head == "55424923", "ubi")
        .when(head == "7F454C46", "elf").when(head == "504B0304", "zip").when(F.hex(F.substring(raw, 1, 2)) == "1F8B", "gzip").when(F.substring(raw, 258, 5) == F.lit(b"ustar"), "tar")
        .when(F.hex(F.substring(raw, 1, SNIFF)).rlike("^(?:..)*?00"), "binary")
    )


def text_kind(body: Column) -> Column:
    """B04, B07 for rows that are text already: binary, markup, control or text."""
    low = F.lower(F.substring(body, 1, 16))
    return F.when(F.substring(body, 1, SNIFF).contains("\x00"), "binary").when(low.startswith("<!doctype") | low.startswith("<html"), "markup").when(F.substring(body, 1, HEAD).rlike(CONTROL), "control").otherwise("text")


def names_interpreter(first_line: Column) -> Column:
    """A ``#!`` line whose program, after ``env`` with its options and assignments, is a Lua."""
    words = F.filter(F.split(F.substring(first_line, F.lit(3), F.length(first_line)), r"\s+"), lambda w: w != "")
    base = F.transform(words, lambda w: F.element_at(F.split(w, "/"), -1))
    rest = F.filter(F.slice(base, F.lit(2), F.size(base)), lambda w: ~w.startswith("-") & ~w.contains("="))
    program = F.when(F.element_at(F.concat(base, F.array(F.lit(""))), 1) == "env", F.element_at(F.concat(rest, F.array(F.lit(""))), 1)).otherwise(F.element_at(F.concat(base, F.array(F.lit(""))), 1))
    return first_line.startswith("#!") & program.rlike(INTERPRETER)


def is_source(path: Column, body: Column) -> Column:
    """Name lists, then extensions (denials first), then the first 512 characters."""
    base, head = F.element_at(F.split(F.lower(path), "/"), -1), F.substring(body, 1, HEAD)
    denied, allowed, family = F.lit(False), F.lit(False), F.lit(False)
    for e in NOT_SOURCE:
        denied = denied | base.endswith(e)
    for e in SOURCE:
        allowed = allowed | base.endswith(e)
    for n in NOT_SOURCE_FAMILIES:
        family = family | base.startswith(n)
    template = F.lit(False)
    for e in TEMPLATES:
        template = template | base.endswith(e)
    line = F.element_at(F.split(head, "\n"), 1)
    return (
        F.when(base.isin(*NOT_SOURCE_NAMES) | family, False).when(template, body.contains("<?lua") | (base.endswith(".lp") & body.contains("<%"))).when(base.endswith(".conf"), body.rlike("_by_lua_block"))
        .when(denied, False).when(allowed, True).when(head.rlike(CONTROL), False).when(line.startswith("#!"), names_interpreter(line)).when(head.startswith("#"), False).when(head.rlike(NOT_SOURCE_HEADS), False)
        .otherwise(head.rlike("(?m)" + OPENERS))
    )


def route(path: Column, raw: Column, body: Column) -> Column:
    """What happens to an artifact: triage, unreadable, template, conf, analyze or skip."""
    kind, low = binary_kind(raw), F.lower(path)
    return (
        F.when(raw.isNull(), "unreadable").when(kind.isin("bytecode", "luajit-bytecode"), "triage").when(kind.isNotNull(), "unreadable").when(~is_source(path, body), "skip")
        .when(low.endswith(".conf"), "conf").when(low.rlike(r"\.(?:html|htm|lp)$"), "template").otherwise("analyze")
    )


def strip_bom(body: Column) -> Column:
    """B12."""
    return F.regexp_replace(body, "^\ufeff", "")


def blank(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def extract_template(text: str, path: str) -> str:
    """Code blocks kept in place, everything else blanked; line and column stay (E-26)."""
    pattern = r"<\?lua(?=\s)(.*?)(\?>|\Z)" + (r"|<%(=?)(.*?)(%>|\Z)" if path.lower().endswith(".lp") else "")
    out, at = [], 0
    for m in re.finditer(pattern, text, re.S):
        out.append(blank(text[at : m.start()]))
        body, closer = (m[1], m[2]) if m[1] is not None else (m[4], m[5])
        opener = m.end() - m.start() - len(body) - len(closer)
        out.append(("_ =" if m[0].startswith("<%=") else "").ljust(opener) + body + (" ;" if closer else ""))
        at = m.end()
    out.append(blank(text[at:]))
    return "".join(out)


_CONF = re.compile(r"#[^\n]*|[A-Za-z_]*_by_lua_block\s*\{|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
_LUA_SKIP = re.compile(r"--\[(=*)\[.*?(?:\]\1\]|\Z)|--[^\n]*|\[(=*)\[.*?(?:\]\2\]|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{}]", re.S)


def extract_conf(text: str) -> str:
    """Bodies of ``*_by_lua_block`` as ``do ... end`` in place, braces matched outside strings and comments."""
    out, at, pos = [], 0, 0
    while m := _CONF.search(text, pos):
        pos = m.end()
        if not m[0].endswith("{"):
            continue
        depth, end = 1, len(text)
        for b in _LUA_SKIP.finditer(text, pos):
            depth += {"{": 1, "}": -1}.get(b[0], 0)
            if not depth:
                end = b.start()
                break
        lead = blank(text[at : pos])
        out.append(lead[:-3] + "do " if len(lead) >= 3 else lead)
        out.append(text[pos:end])
        if end < len(text):
            out.append(" end")
        at = pos = min(len(text), end + 1)
    out.append(blank(text[at:]))
    return "".join(out)


def extracted(artifacts: DataFrame) -> DataFrame:
    """``body`` of templates and configurations replaced by what ``route`` says of them."""

    @F.pandas_udf("string")
    def pull(path: pd.Series, how: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([extract_template(b, p) if h == "template" else extract_conf(b) if h == "conf" else b for p, h, b in zip(path, how, body)])

    out = artifacts.withColumn("body", F.when(F.col("route").isin("template", "conf"), pull("path", "route", "body")).otherwise(F.col("body")))
    return out.withColumn("profile_extra", F.when(F.col("route") == "conf", "openresty"))


MAX_CONSTANTS, MAX_DEPTH = 100_000, 64


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("truncated")
        self.at += n
        return self.raw[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]


def bytecode_header(raw: bytes) -> dict:
    """Flavour, version and layout of a compiled chunk; ``problem`` where it does not fit."""
    out = {"flavor": "", "version": 0, "little_endian": True, "size_int": 0, "size_t": 0, "problem": ""}
    b = _Bytes(raw)
    try:
        if raw[:3] == b"\x1bLJ":
            b.take(3)
            return out | {"flavor": "luajit", "version": b.byte(), "little_endian": not b.byte() & 1}
        if raw[:4] != b"\x1bLua":
            return out | {"problem": "no signature"}
        b.take(4)
        version = b.byte()
        out |= {"flavor": "lua", "version": version}
        if version not in (0x51, 0x52, 0x53, 0x54):
            return out | {"problem": "unknown version"}
        if b.byte() != 0:
            return out | {"problem": "unofficial format"}
        if version in (0x51, 0x52):
            out |= {"little_endian": b.byte() == 1, "size_int": b.byte(), "size_t": b.byte()}
            b.take(3)
            if version == 0x52 and b.take(6) != b"\x19\x93\r\n\x1a\n":
                return out | {"problem": "damaged in transfer"}
            return out
        if b.take(6) != b"\x19\x93\r\n\x1a\n":
            return out | {"problem": "damaged in transfer"}
        if version == 0x53:
            out |= {"size_int": b.byte(), "size_t": b.byte()}
        b.byte()
        n_int, n_num = b.byte(), b.byte()
        mark = b.take(n_int)
        out["little_endian"] = int.from_bytes(mark, "little") == 0x5678
        if 0x5678 not in (int.from_bytes(mark, "little"), int.from_bytes(mark, "big")):
            return out | {"problem": "integer marker"}
        number = struct.unpack(("<" if out["little_endian"] else ">") + "d", b.take(n_num))[0] if n_num == 8 else 370.5
        return out if number == 370.5 else out | {"problem": "number marker"}
    except ValueError as e:
        return out | {"problem": str(e)}


class _Chunk(_Bytes):
    """Integers and strings of a compiled chunk, as its version writes them."""

    def __init__(self, raw: bytes, head: dict):
        super().__init__(raw)
        self.version, self.order = head["version"], "little" if head["little_endian"] else "big"
        self.size_int, self.size_t = head["size_int"] or 4, head["size_t"] or 8

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), self.order)

    def integer(self) -> int:
        if self.version < 0x54:
            return self.number(self.size_int)
        n = 0
        for _ in range(10):  # seven bits a byte, the last one marked
            b = self.byte()
            n = n << 7 | b & 0x7F
            if b & 0x80:
                return n
        raise ValueError("integer too long")

    def string(self) -> str | None:
        if self.version <= 0x52:
            n = self.number(self.size_t)
            return self.take(n)[:-1].decode("latin-1") if n else None
        n = self.integer() if self.version == 0x54 else self.byte()
        if self.version == 0x53 and n == 0xFF:
            n = self.number(self.size_t)
        return self.take(n - 1).decode("latin-1") if n else None


def prototypes(raw: bytes, head: dict | None = None) -> list[tuple[int, int, str, str | None]]:
    """``(proto_no, const_no, kind, value)`` of all constants of a Lua 5.1 to 5.4 chunk, prototypes in the order written.

    Nothing is reserved for a claimed length; constants, prototypes and nesting
    are bounded, and ValueError tells of a chunk that ends or goes on too early.
    """
    head = head or bytecode_header(raw)
    if head["flavor"] != "lua" or head["problem"]:
        raise ValueError(head["problem"] or "no Lua chunk")
    c, v = _Chunk(raw, head), head["version"]
    c.take({0x51: 12, 0x52: 18, 0x53: 33, 0x54: 31}[v])
    if v >= 0x53:
        c.byte()  # upvalues of the main function
    out: list[tuple[int, int, str, str | None]] = []
    numbered = 0

    def constants(no: int) -> None:
        for k in range(c.integer()):
            if len(out) >= MAX_CONSTANTS:
                raise ValueError("too many constants")
            tag = c.byte()
            if tag == 0:
                out.append((no, k, "nil", None))
            elif tag == 1 and v < 0x54:
                out.append((no, k, "boolean", str(bool(c.byte())).lower()))
            elif tag in (1, 0x11):
                out.append((no, k, "boolean", "true" if tag == 0x11 else "false"))
            elif (tag == 3 and v == 0x54) or (tag == 0x13 and v == 0x53):
                out.append((no, k, "integer", str(int.from_bytes(c.take(8), c.order, signed=True))))
            elif tag in (3, 0x13):
                out.append((no, k, "number", repr(struct.unpack(("<" if c.order == "little" else ">") + "d", c.take(8))[0])))
            elif tag in (4, 0x14):
                out.append((no, k, "string", c.string() or ""))
            else:
                raise ValueError(f"unknown constant {tag}")

    def function(depth: int) -> None:
        nonlocal numbered
        no, numbered = numbered, numbered + 1
        if depth > MAX_DEPTH or numbered > MAX_CONSTANTS:
            raise ValueError("too many prototypes")
        if v != 0x52:
            c.string()  # source
        c.integer(), c.integer()
        c.take(4 if v == 0x51 else 3)
        c.take(4 * c.integer())  # code
        constants(no)
        pair = 3 if v == 0x54 else 2
        if v >= 0x53:
            c.take(pair * c.integer())  # upvalues
        for _ in range(c.integer()):
            function(depth + 1)
        if v == 0x52:
            c.take(pair * c.integer())
            c.string()
        lines = c.integer()
        c.take(lines if v == 0x54 else c.size_int * lines)
        if v == 0x54:
            for _ in range(c.integer()):
                c.integer(), c.integer()
        for _ in range(c.integer()):  # local variables
            c.string(), c.integer(), c.integer()
        for _ in range(c.integer()):  # names of upvalues
            c.string()

    function(0)
    return out


def bytecode_strings(raw: bytes) -> list[str]:
    """Printable constants of a chunk in order: of its prototypes, or of its bytes where those cannot be walked."""
    try:
        return [value for _, _, kind, value in prototypes(raw) if kind == "string" and value]
    except (ValueError, RecursionError):
        return [m.decode("latin-1") for m in re.findall(rb"[\x20-\x7e]{3,}", raw)[:MAX_CONSTANTS]]


def bytecode_constants(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, proto_no, const_no, kind, value`` of the chunks that can be walked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, raw in zip(pdf["artifact_id"], pdf["raw"]):
                try:
                    rows += [(i, *c) for c in prototypes(bytes(raw))] if raw is not None else []
                except (ValueError, RecursionError):
                    continue  # triage tells of it
            yield pd.DataFrame(rows, columns=["artifact_id", "proto_no", "const_no", "kind", "value"])

    return artifacts.select("artifact_id", "raw").mapInPandas(run, "artifact_id long, proto_no int, const_no int, kind string, value string")


def triage(artifacts: DataFrame, sinks: list[str], assumed: int = 0x54) -> DataFrame:
    """801 for every chunk, 803 for another version, 805 for an unreadable one, 802 with its sinks.

    A sink shows as one constant, or as two neighbouring ones in either order.
    """
    schema = "artifact_id long, path string, code string, name string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, halves = set(sinks), {tuple(s.rsplit(".", 1)) for s in sinks if "." in s}
        for pdf in batches:
            rows = []
            for i, path, raw in zip(pdf["artifact_id"], pdf["path"], pdf["raw"]):
                h = bytecode_header(bytes(raw))
                label = f"{h['flavor'] or 'unknown'} {h['version'] >> 4}.{h['version'] & 15}"
                rows.append((i, path, "805" if h["problem"] else "801", h["problem"] or label))
                if not h["problem"]:
                    if h["version"] != assumed or h["flavor"] != "lua":
                        rows.append((i, path, "803", label))
                    c = bytecode_strings(bytes(raw))
                    hit = {s for s in c if s in whole} | {".".join(p) for p in halves for x, y in zip(c, c[1:]) if p in ((x, y), (y, x))}
                    rows += [(i, path, "802", s) for s in sorted(hit)]
            yield pd.DataFrame(rows, columns=["artifact_id", "path", "code", "name"])

    return artifacts.select("artifact_id", "path", "raw").mapInPandas(run, schema)
