"""Lexer and parser for Lua 5.1 to 5.4 and LuaJIT.

Runs over one source at a time, in linear time, without recursion deeper than
``MAX_DEPTH``; errors are values of ``LuaError``, never crashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_DEPTH = 200
KEYWORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n\f\v]+)|(?P<comment>--\[(?P<ceq>=*)\[.*?(?:\](?P=ceq)\]|\Z)|--[^\n]*)|(?P<name>[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)
    |(?P<number>0[xX][0-9a-fA-F.]+(?:[pP][+-]?[0-9]+)?(?:[uUlLiI]*)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[uUlLiI]*)
    |(?P<long>\[(?P<seq>=*)\[.*?\](?P=seq)\])|(?P<string>"(?:[^"\\\n]|\\(?:z\s*+|\r\n|.|\n))*+"|'(?:[^'\\\n]|\\(?:z\s*+|\r\n|.|\n))*+')|(?P<backtick>`[^`\n]*`?)
    |(?P<op>\.\.\.|\.\.|==|~=|<=|>=|<<|>>|//|::|[-+*/%^\#&~|<>=(){}\[\];:,.])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:z\s*|x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|([0-9]{1,3})|(\r\n|.|\n))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'", "\n": "\n", "\r\n": "\n"}


class LuaError(Exception):
    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.line = line


@dataclass(slots=True)
class Token:
    kind: str  # name keyword number string backtick op eof
    value: str
    line: int
    col: int
    end: int


@dataclass(slots=True)
class Node:
    tag: str
    line: int
    col: int
    value: object = None
    kids: list = field(default_factory=list)
    id: int = -1
    parent: int = -1


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(min(int(m[2], 16), 0x10FFFF))
        if m[3]:
            return chr(min(int(m[3]), 255))
        return "" if m[0][1] == "z" else _SIMPLE.get(m[4], m[4])  # an unknown escape stands for its character

    return _ESCAPE.sub(one, body) if "\\" in body else body


def tokenize(text: str) -> tuple[list[Token], list[tuple[int, str]], list[tuple[int, str]]]:
    """``(tokens, comments, problems)``; a byte that starts no token is skipped and noted."""
    tokens, comments, problems = [], [], []
    at, line, start = 0, 1, 0
    if text.startswith("#"):
        at = text.find("\n") if "\n" in text else len(text)
    n = len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            problems.append((line, text[at]))
            at += 1
            continue
        kind, s = m.lastgroup, m[0]
        kind = next(k for k in ("space", "comment", "name", "number", "long", "string", "backtick", "op") if m[k] is not None)
        if kind == "comment":
            comments.append((line, s[2:]))
        elif kind != "space":
            value = s
            if kind == "string":
                value = unescape(s[1:-1])
            elif kind == "long":
                kind, value = "string", re.sub(r"^\r?\n", "", s[2 + len(m["seq"]) : -2 - len(m["seq"])])
            elif kind == "name" and s in KEYWORDS:
                kind = "keyword"
            tokens.append(Token(kind, value, line, at - start + 1, at - start + len(s)))
        breaks = s.count("\n")
        if breaks:
            line += breaks
            start = at + s.rfind("\n") + 1
        at = m.end()
    tokens.append(Token("eof", "", line, at - start + 1, at - start + 1))
    return tokens, comments, problems


# binary operators: left and right binding power
_BINARY = {"or": (1, 1), "and": (2, 2), **dict.fromkeys(("<", ">", "<=", ">=", "~=", "=="), (3, 3)), "|": (4, 4), "~": (5, 5), "&": (6, 6), "<<": (7, 7), ">>": (7, 7), "..": (9, 8), "+": (10, 10), "-": (10, 10), **dict.fromkeys(("*", "/", "//", "%"), (11, 11)), "^": (14, 13)}


class Parser:
    """Recursive descent over the tokens; ``parse`` returns the chunk's block."""

    def __init__(self, tokens: list[Token]):
        self.t, self.i, self.depth = tokens, 0, 0

    def peek(self, *values: str) -> bool:
        t = self.t[self.i]
        return t.kind in ("op", "keyword") and t.value in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> Token:
        t = self.t[self.i]
        if t.kind not in ("op", "keyword") or t.value != value:
            raise LuaError(f"{value!r} expected near {t.value!r}", t.line)
        self.i += 1
        return t

    def name(self) -> Token:
        t = self.t[self.i]
        if t.kind != "name" and not (t.kind == "keyword" and t.value == "goto"):
            raise LuaError(f"name expected near {t.value!r}", t.line)
        self.i += 1
        return t

    def node(self, tag: str, token: Token | Node, value=None, *kids) -> Node:
        return Node(tag, token.line, token.col, value, list(kids))

    def parse(self) -> Node:
        block = self.block()
        if self.t[self.i].kind != "eof":
            raise LuaError(f"unexpected {self.t[self.i].value!r}", self.t[self.i].line)
        return block

    def block(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise LuaError("nested too deeply", self.t[self.i].line)
        out = self.node("Block", self.t[self.i])
        while self.t[self.i].kind != "eof" and not self.peek("end", "else", "elseif", "until"):
            if self.take(";"):
                continue
            last = self.peek("return")
            out.kids.append(self.statement())
            if last:
                break
        self.depth -= 1
        return out

    def statement(self) -> Node:
        t = self.t[self.i]
        if t.kind == "keyword":
            method = getattr(self, "s_" + t.value, None)
            if method and not (t.value == "goto" and self.t[self.i + 1].kind != "name"):
                self.i += 1
                return method(t)
        if self.take("::"):
            self.name()
            self.need("::")
            return self.node("Label", t)
        e = self.suffixed()
        if self.peek("=", ","):
            targets = [e]
            while self.take(","):
                targets.append(self.suffixed())
            self.need("=")
            return self.node("Set", t, len(targets), *targets, *self.exprs())
        if e.tag not in ("Call", "Invoke"):
            raise LuaError(f"statement expected near {t.value!r}", t.line)
        return e

    def exprs(self) -> list[Node]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def s_local(self, t: Token) -> Node:
        if self.take("function"):
            n = self.name()
            return self.node("Localfunction", t, n.value, self.body(t, n.value))
        names = []
        while True:
            names.append(self.node("Name", n := self.name(), n.value))
            if self.take("<"):
                self.name()
                self.need(">")
            if not self.take(","):
                break
        return self.node("Local", t, len(names), *names, *(self.exprs() if self.take("=") else []))

    def s_function(self, t: Token) -> Node:
        n = self.name()
        target, full = self.node("Id", n, n.value), n.value
        method = False
        while self.peek(".", ":"):
            method = self.t[self.i].value == ":"
            self.i += 1
            k = self.name()
            full += ("." if not method else ":") + k.value
            target = self.node("Index", t, None, target, self.node("String", k, k.value))
            if method:
                break
        return self.node("Set", t, 1, target, self.body(t, full, method))

    def body(self, t: Token, name: str = "", method: bool = False) -> Node:
        self.need("(")
        params = [self.node("Name", t, "self")] if method else []
        while not self.peek(")"):
            if self.take("..."):
                params.append(self.node("Name", t, "..."))
                break
            n = self.name()
            params.append(self.node("Name", n, n.value))
            if not self.take(","):
                break
        self.need(")")
        block = self.block()
        self.need("end")
        return self.node("Function", t, (name, len(params)), *params, block)

    def s_if(self, t: Token) -> Node:
        out = self.node("If", t, None, self.expr())
        self.need("then")
        out.kids.append(self.block())
        while self.take("elseif"):
            out.kids.append(self.expr())
            self.need("then")
            out.kids.append(self.block())
        if self.take("else"):
            out.kids.append(self.block())
        self.need("end")
        return out

    def s_while(self, t: Token) -> Node:
        e = self.expr()
        self.need("do")
        b = self.block()
        self.need("end")
        return self.node("While", t, None, e, b)

    def s_repeat(self, t: Token) -> Node:
        b = self.block()
        self.need("until")
        return self.node("Repeat", t, None, b, self.expr())

    def s_for(self, t: Token) -> Node:
        names = [self.node("Name", n := self.name(), n.value)]
        if self.take("="):
            e = self.exprs()
            tag = "Fornum"
        else:
            while self.take(","):
                names.append(self.node("Name", n := self.name(), n.value))
            self.need("in")
            e, tag = self.exprs(), "Forin"
        self.need("do")
        b = self.block()
        self.need("end")
        return self.node(tag, t, (len(names), len(e)), *names, *e, b)

    def s_do(self, t: Token) -> Node:
        b = self.block()
        self.need("end")
        return self.node("Do", t, None, b)

    def s_return(self, t: Token) -> Node:
        end = self.t[self.i].kind == "eof" or self.peek("end", "else", "elseif", "until", ";")
        out = self.node("Return", t, None, *([] if end else self.exprs()))
        self.take(";")
        return out

    def s_break(self, t: Token) -> Node:
        return self.node("Break", t)

    def s_goto(self, t: Token) -> Node:
        self.name()
        return self.node("Goto", t)

    def expr(self, limit: int = 0) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise LuaError("nested too deeply", self.t[self.i].line)
        t = self.t[self.i]
        if self.peek("not", "-", "#", "~"):
            self.i += 1
            left = self.node("Op", t, "u" + t.value, self.expr(12))
        else:
            left = self.simple()
        while self.t[self.i].kind in ("op", "keyword") and (p := _BINARY.get(self.t[self.i].value)) and p[0] > limit:
            op = self.t[self.i]
            self.i += 1
            left = self.node("Op", op, op.value, left, self.expr(p[1]))
        self.depth -= 1
        return left

    def simple(self) -> Node:
        t = self.t[self.i]
        tag = {"number": "Number", "string": "String", "backtick": "Backtick"}.get(t.kind)
        if tag or (t.kind == "keyword" and t.value in ("nil", "true", "false")) or (t.kind == "op" and t.value == "..."):
            self.i += 1
            return self.node(tag or {"nil": "Nil", "true": "True", "false": "False", "...": "Dots"}[t.value], t, t.value)
        if self.peek("{"):
            return self.table()
        if self.take("function"):
            return self.body(t)
        return self.suffixed()

    def table(self) -> Node:
        t = self.need("{")
        out = self.node("Table", t)
        while not self.peek("}"):
            k = self.t[self.i]
            if self.take("["):
                key = self.expr()
                self.need("]")
                self.need("=")
                out.kids.append(self.node("Pair", k, None, key, self.expr()))
            elif k.kind == "name" and self.t[self.i + 1].kind == "op" and self.t[self.i + 1].value == "=":
                self.i += 2
                out.kids.append(self.node("Pair", k, k.value, self.node("String", k, k.value), self.expr()))
            else:
                out.kids.append(self.expr())
            if not self.take(",", ";"):
                break
        self.need("}")
        return out

    def suffixed(self) -> Node:
        t = self.t[self.i]
        if self.take("("):
            e = self.node("Paren", t, None, self.expr())
            self.need(")")
        else:
            n = self.name()
            e = self.node("Id", n, n.value)
        while True:
            s = self.t[self.i]
            if self.take("."):
                k = self.name()
                e = self.node("Index", t, None, e, self.node("String", k, k.value))
            elif self.take("["):
                k = self.expr()
                self.need("]")
                e = self.node("Index", t, None, e, k)
            elif self.take(":"):
                k = self.name()
                e = self.node("Invoke", t, k.value, e, *self.arguments())
            elif s.kind == "string" or self.peek("(", "{"):
                e = self.node("Call", t, None, e, *self.arguments())
            else:
                return e

    def arguments(self) -> list[Node]:
        t = self.t[self.i]
        if t.kind == "string":
            self.i += 1
            return [self.node("String", t, t.value)]
        if self.peek("{"):
            return [self.table()]
        self.need("(")
        out = [] if self.peek(")") else self.exprs()
        self.need(")")
        return out


def parse(text: str) -> tuple[Node, list[tuple[int, str]], list[Token]]:
    """``(block, comments, tokens)``, nodes numbered in pre-order; raises LuaError."""
    tokens, comments, problems = tokenize(text)
    if problems:
        raise LuaError(f"unexpected {problems[0][1]!r}", problems[0][0])
    root = Parser(tokens).parse()
    stack, n = [(root, -1)], 0
    while stack:
        node, parent = stack.pop()
        node.id, node.parent, n = n, parent, n + 1
        stack.extend((k, node.id) for k in reversed(node.kids))
    return root, comments, tokens
