"""Scalar functions of SURVEY section 2.D, as Column expressions only.

Every function takes and returns Columns, so Catalyst sees through them; none
runs Python on a row.  ``None`` in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")  # by rank, from 0
CONFIDENCES = ("low", "medium", "high", "certain")  # by rank, from 1
METACHARACTERS = (";", "|", "&", "`", "$", "<", ">", "(", ")", "\n")
REGEX_SPECIAL = set(r".^$*+?{}[]\|()-")


def glob_regex(pattern: str) -> str:
    """Java/RE2 regex of an anchored wildcard (D01): ``*`` any run, ``?`` any one character."""
    return "^" + "".join("[\\s\\S]*" if c == "*" else "[\\s\\S]" if c == "?" else "\\" + c if c in REGEX_SPECIAL else c for c in pattern) + "$"


def wildcards(pattern: str) -> int:
    return pattern.count("*") + pattern.count("?")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character (D02); 0 for the empty string.  For short strings."""
    chars = F.split(text, "")
    n = F.length(text)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def is_base64ish(text: Column) -> Column:
    """At least 16 characters of the alphabet, padded to a multiple of four."""
    return (F.length(text) >= 16) & (F.length(text) % 4 == 0) & text.rlike("^[A-Za-z0-9+/]+=*$")


def is_hex_blob(text: Column) -> Column:
    """At least 16 hexadecimal digits, an even number of them."""
    return (F.length(text) >= 16) & (F.length(text) % 2 == 0) & text.rlike("^[0-9a-fA-F]+$")


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based position."""
    head = F.substring(text, F.lit(1), position - 1)
    return (1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("int")


def column_of(text: Column, position: Column) -> Column:
    """1-based column of a 1-based position."""
    return (1 + F.length(F.substring_index(F.substring(text, F.lit(1), position - 1), "\n", -1))).cast("int")


def trim(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Code points that reorder or hide text: C1 controls, zero-width, bidi, line and paragraph separators.
HIDDEN = (*range(0x80, 0xA0), 0x061C, *range(0x200B, 0x2010), 0x2028, 0x2029, *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF)


def sanitize(text: Column) -> Column:
    r"""Controls become ``\xNN`` (tab ``\t``), ``HIDDEN`` characters ``\u{XXXX}``.

    One replacement a code point: texts of any length pass without an array of their characters.
    """
    out = F.replace(text, F.lit("\t"), F.lit("\\t"))
    for n in (*range(32), 127):
        out = out if n == 9 else F.replace(out, F.lit(chr(n)), F.lit(f"\\x{n:02X}"))
    for n in HIDDEN:
        out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{{{n:04X}}}"))
    return out


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, of the UTF-8 bytes, as 16 lower-case hex digits.

    The state is two 32-bit words, so no product leaves the range of a long.
    """
    data = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    word = 4294967296

    def step(s: Column, c: Column) -> Column:
        low = s["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        product = low * F.lit(435)
        high = (s["hi"] * F.lit(435) + F.floor(product / F.lit(word)) + low * F.lit(256)) % F.lit(word)
        return F.struct(high.cast("long").alias("hi"), (product % F.lit(word)).cast("long").alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    end = F.aggregate(F.filter(data, lambda c: c != ""), start, step)
    return F.lower(F.concat(F.lpad(F.hex(end["hi"]), 8, "0"), F.lpad(F.hex(end["lo"]), 8, "0")))


def render_message(template: Column, **fields: Column) -> Column:
    """``{field}`` replaced by its value; a field without value stays visible."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("{" + name + "}")))
    return out


def meaning(template: Column) -> Column:
    """The template without its placeholders."""
    return F.regexp_replace(template, r"\s*\(\{\w+\}\)|\s*\{\w+\}", "")


def category(code: Column) -> Column:
    """The family of a rule code; null outside the known ranges."""
    n = code.cast("int")
    return (
        F.when(n.between(700, 719), "exec").when(n.between(720, 739), "firmware").when(n.between(740, 799), "payload")
        .when(n.between(800, 899), "artifact").when((n < 100) | n.between(900, 999), "meta")
    )


def severity_rank(severity: Column) -> Column:
    """Info 0 to critical 4; unknown names rank 0."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]), severity), F.lit(0))


def confidence_rank(confidence: Column) -> Column:
    """Low 1 to certain 4; unknown names rank 0."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(CONFIDENCES) for x in (F.lit(s), F.lit(i + 1))]), confidence), F.lit(0))


def confidence_down(confidence: Column, steps: Column | int = 1) -> Column:
    """So many steps down the ladder; empty below ``low``."""
    at = confidence_rank(confidence) - (F.lit(steps) if isinstance(steps, int) else steps)
    return F.when(at < 1, F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.greatest(at, F.lit(1)).cast("int")))


def score_label(value: Column, gaps: Column) -> Column:
    """Good from 90, needs work from 60, else critical; gaps turn good into incomplete."""
    label = F.when(value >= 90, "good").when(value >= 60, "needs work").otherwise("critical")
    return F.when((label == "good") & (gaps > 0), "incomplete").otherwise(label)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The slice with white space collapsed."""
    return trim(F.regexp_replace(F.substring(text, start, end - start + 1), r"\s+", " "))


def clamp_column(column: Column, line_length: Column) -> Column:
    """D15."""
    return F.greatest(F.lit(1), F.least(line_length, column))


def segments(path: Column) -> Column:
    """Non-empty segments of a slash-separated path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def in_path_set(path: Column, exact: list[str] = (), prefixes: list[str] = (), names: list[str] = (), name_prefixes: list[str] = (), name_suffixes: list[str] = ()) -> Column:
    """Exact path, path prefix, any segment, or beginning or end of the base name."""
    base = F.element_at(F.split(path, "/"), -1)
    tests = [path.isin(*exact)] if exact else []
    tests += [path.startswith(p) for p in prefixes] + [F.exists(segments(path), lambda s: s.isin(*names))] * bool(names)
    tests += [base.startswith(p) for p in name_prefixes] + [base.endswith(p) for p in name_suffixes]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def open_mode(mode: Column) -> Column:
    """What a file mode does: read, write, truncate (D18: any but read writes)."""
    return F.struct((~mode.contains("w") & ~mode.contains("a")).alias("read"), (mode.contains("w") | mode.contains("a") | mode.contains("+")).alias("write"), mode.contains("w").alias("truncate"))


def command_words(command: Column, most: int = 2) -> Column:
    """First words of a command that are neither options nor assignments."""
    words = F.filter(F.split(trim(command), r"\s+"), lambda w: (w != "") & ~w.startswith("-") & ~w.rlike("^[A-Za-z_][A-Za-z0-9_]*="))
    return F.slice(words, 1, most)


def base_name(path: Column) -> Column:
    """The program name of a path."""
    return F.element_at(F.split(path, "/"), -1)


def redirect_targets(command: Column) -> Column:
    """What ``>`` writes to, paths only, up to the first empty target."""
    found = F.regexp_extract_all(command, F.lit(r">+&?\s*([^\s;|&<>()]*)"), F.lit(1))
    empty = F.array_position(found, "")
    return F.filter(F.when(empty > 0, F.slice(found, F.lit(1), (empty - 1).cast("int"))).otherwise(found), lambda t: t.contains("/"))


def installs_crontab(command: Column) -> Column:
    """``crontab`` with a file or standard input rather than ``-l``, ``-r`` or ``-e`` alone."""
    rest = trim(F.regexp_extract(command, r"(?s)\bcrontab\b([^;|&\n]*)", 1))
    return command.rlike(r"\bcrontab\b") & (rest != "") & ~rest.rlike("^-[lre]$")


def opens_port(command: Column) -> Column:
    """A firewall command that names a port."""
    return command.contains("firewall") & (command.contains("dest_port") | command.contains("src_dport"))


def decoder_name(name: Column) -> Column:
    """A name that speaks of decoding, separators squeezed out."""
    # Words that mark a decoder (fixed values).
    words = (
        "base64|base32|b64|base16|hex|unhex|atob|btoa|decode|deobf|obf|deobfuscate|unescape|urlcode|urldecode|unpack|gunzip|inflate|deflate|decompress|uncompress"
        "|lzma|zlib|crypt|xor|rc4|rot13|rot47|xxtea|chunkify|unfilter"
    )
    return F.lower(F.regexp_replace(name, r"[\s_\-.:]", "")).rlike(words)


def last_segment(path: Column) -> Column:
    """D26."""
    return F.substring_index(path, ".", -1)


def surviving_metacharacters(filtered: Column) -> Column:
    """Shell metacharacters that a filter string leaves."""
    return F.filter(F.array(*map(F.lit, METACHARACTERS)), lambda c: ~F.contains(filtered, c))


def normalise_path(path: Column) -> Column:
    """``.`` and ``..`` resolved, a leading slash kept; ``..`` at the top stays there."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def module_candidates(path: Column) -> Column:
    """Dotted names of all suffixes of a path, the extension stripped."""
    parts = segments(F.regexp_replace(path, r"\.lua$", ""))
    n = F.size(parts)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


MAX_PATTERN, MAX_QUANTIFIERS = 64, 3
CLASSES = {"a": "A-Za-z", "d": "0-9", "l": "a-z", "s": "\\s", "u": "A-Z", "w": "A-Za-z0-9", "x": "0-9A-Fa-f", "p": "!-/:-@\\[-`{-~"}


def code_pattern_regex(pattern: str) -> str | None:
    """Regex of a Lua-style pattern on a code; None if unreadable or over the guard."""
    if len(pattern) > MAX_PATTERN or len(re.findall(r"[*+\-?]", pattern)) > MAX_QUANTIFIERS:
        return None
    out, i, in_set = "^", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            if i + 1 == len(pattern):
                return None
            n = pattern[i + 1]
            body = CLASSES.get(n.lower()) if n.isalpha() else None
            out += (body if in_set else f"[{'^' * n.isupper()}{body}]") if body else "\\" + n
            i += 1
        elif c == "[" and not in_set:
            in_set, out = True, out + "["
        elif c == "]" and in_set:
            in_set, out = False, out + "]"
        elif in_set or c in ".*+?^$":
            out += c
        elif c == "-":
            out += "*?"
        else:
            out += re.escape(c)
        i += 1
    return None if in_set else out + "$"


def html_escape(text: Column) -> Column:
    """D33."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


TEST_WORDS = ("test", "tests", "spec", "specs", "t")


def is_test_path(path: Column) -> Column:
    """A test directory or a test name; a temporary root is no evidence."""
    low = F.regexp_replace(F.lower(path), r"^/?(?:tmp|var/tmp|private/tmp)/", "")
    parts = F.filter(F.split(low, r"[/\\]"), lambda s: s != "")
    dirs = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    stem = F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), parts), -1), r"\.[^.]*$", "")
    return F.exists(dirs, lambda s: s.isin(*TEST_WORDS)) | stem.rlike(r"^(?:test|spec)[_\-.]|[_\-.](?:test|tests|spec)$") | stem.isin("test", "tests", "spec", "specs")
