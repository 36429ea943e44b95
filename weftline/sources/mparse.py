"""A small parser for the matrix language of ``.m`` files: statements, calls, fields, handles, commands and blocks.

It yields plain trees for the frontend, not a full grammar: operators only separate operands. A statement that doesn't
parse becomes an ``error`` node up to the end of its line, so the rest of a file stays analysable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = {"if", "elseif", "else", "for", "parfor", "while", "switch", "case", "otherwise", "try", "catch", "spmd", "end", "function", "classdef", "return", "break", "continue", "global", "persistent"}
COMPOUND = {"if", "for", "parfor", "while", "switch", "try", "spmd"}
TOKEN = re.compile(
    r"""(?P<block>%\{[ \t]*\n(?:.*\n)*?[ \t]*%\}[ \t]*(?=\n|$))|(?P<comment>%[^\n]*|\#[^\n]*)|(?P<cont>\.\.\.[^\n]*\n)|(?P<space>[ \t\r]+)|(?P<nl>\n)
    |(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eEdD][+-]?\d+)?[ij]?)|(?P<id>[A-Za-z]\w*)|(?P<dstr>"(?:[^"\n]|"")*")|(?P<op>\.\^'|\.\*|\./|\.\\|\.\^|\.'|==|~=|!=|<=|>=|&&|\|\||[-+*/\\^<>=&|~!@:,;.(){}\[\]'?])""",
    re.X,
)


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    start: int
    end: int
    spaced: bool  # white space before it


@dataclass
class Node:
    kind: str
    line: int
    end_line: int
    start: int = 0
    end: int = 0
    name: str = ""
    kids: list["Node"] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


class Unparsed(Exception):
    pass


def lex(src: str) -> list[Tok]:
    out, at, line, spaced, depth = [], 0, 1, False, []
    while at < len(src):
        prev = out[-1] if out else None
        # a quote right after an operand is a transpose, elsewhere it opens a string
        if src[at] == "'":
            operand = prev is not None and (prev.kind in ("id", "num", "str") and prev.text not in KEYWORDS or prev.text in (")", "]", "}", "'", ".'") or (prev.text == "end" and depth))
            if not (operand and not (spaced and depth and depth[-1] in "[{")):
                m = re.compile(r"'(?:[^'\n]|'')*'").match(src, at)
                if m:
                    out.append(Tok("str", m[0], line, at, m.end(), spaced))
                    at, spaced = m.end(), False
                    continue
        m = TOKEN.match(src, at)
        if not m:
            out.append(Tok("bad", src[at], line, at, at + 1, spaced))
            at, spaced = at + 1, False
            continue
        kind, text = m.lastgroup, m[0]
        if kind in ("block", "comment") and (kind == "comment" or not prev or prev.kind == "nl"):
            line += text.count("\n")
        elif kind == "block":
            text = text.split("\n", 1)[0]
            m = re.compile(re.escape(text)).match(src, at)
        elif kind in ("cont", "space"):
            spaced = True
            line += text.count("\n")
            at = m.end()
            continue
        elif kind == "nl" and depth and depth[-1] in "[{":
            # brackets and braces go on over lines, parentheses don't
            out.append(Tok("op", ";", line, at, m.end(), spaced))
            line += 1
            spaced = True
        else:
            out.append(Tok("str" if kind == "dstr" else kind, text, line, at, m.end(), spaced))
            if kind == "nl":
                depth.clear()
            if kind == "op":
                if text in "([{":
                    depth.append(text)
                elif text in ")]}" and depth:
                    depth.pop()
            line += text.count("\n")
            spaced = False
            at = m.end()
            continue
        at = m.end()
        spaced = True
    out.append(Tok("nl", "\n", line, len(src), len(src), spaced))
    out.append(Tok("eof", "", line, len(src), len(src), spaced))
    return out


class Parser:
    def __init__(self, src: str):
        self.src, self.toks, self.i, self.errors = src, lex(src), 0, []

    @property
    def t(self) -> Tok:
        return self.toks[self.i]

    def take(self, text: str | None = None) -> Tok:
        t = self.t
        if text is not None and t.text != text:
            raise Unparsed(f"expected {text!r} at line {t.line}")
        self.i = min(self.i + 1, len(self.toks) - 1)
        return t

    def node(self, kind: str, first: Tok, **more) -> Node:
        last = self.toks[max(0, self.i - 1)]
        return Node(kind, first.line, max(first.line, last.line), first.start, last.end, **more)

    # statements
    def file(self) -> Node:
        first = self.t
        kids = self.block(set())
        return self.node("file", first, kids=kids)

    def block(self, stops: set[str]) -> list[Node]:
        out = []
        while self.t.kind != "eof" and not (self.t.kind == "id" and self.t.text in stops):
            if self.t.kind in ("nl",) or self.t.text in (";", ","):
                self.take()
                continue
            if self.t.text == "function" and "function" not in stops and stops:
                break
            start, first = self.i, self.t
            try:
                out.append(self.statement())
            except Unparsed as e:
                self.errors.append((first.line, self.t.line, str(e)))
                while self.t.kind not in ("nl", "eof"):
                    self.take()
                if self.i == start:
                    self.take()
                out.append(self.node("error", first))
        return out

    def line_end(self) -> bool:
        return self.t.kind in ("nl", "eof") or self.t.text in (";", ",")

    def statement(self) -> Node:
        t = self.t
        if t.kind == "id" and t.text in KEYWORDS:
            return self.keyword()
        if t.text == "arguments" and self.toks[self.i + 1].text in ("\n", "("):
            return self.declarations(t)
        if t.kind == "id" and self.is_command():
            return self.command()
        if t.text == "[" and (n := self.multi()):
            return n
        left = self.expression()
        if self.t.text == "=":
            self.take()
            right = self.expression()
            out = self.node("assignment", t, kids=[left, right])
        else:
            out = left if left.kind in ("call", "field", "name") else self.node("expression", t, kids=[left])
        if not self.line_end():
            raise Unparsed(f"unexpected {self.t.text!r} at line {self.t.line}")
        return out

    def declarations(self, first: Tok) -> Node:
        """An arguments block: nothing in it runs."""
        while not (self.t.text == "end" and self.toks[self.i - 1].kind == "nl"):
            if self.t.kind == "eof":
                raise Unparsed("unclosed arguments block")
            self.take()
        self.take("end")
        return self.node("class", first)

    def is_command(self) -> bool:
        t, n = self.t, self.toks[self.i + 1]
        if n.kind in ("nl", "eof") or n.text in (";", ","):
            return t.text in ALONE
        if not n.spaced or n.text in ("=", "("):
            return False
        after = self.toks[self.i + 2]
        if n.kind == "op" and n.text not in ("-", "@", ".", "'", "~"):
            return False
        if n.kind == "op":
            return not after.spaced and n.text in ("-", ".") and after.kind in ("id", "num")
        return n.kind in ("id", "num", "str") and not (after.text == "=" and n.kind == "id")

    def command(self) -> Node:
        first = self.take()
        end = self.src.find("\n", first.end)
        end = len(self.src) if end < 0 else end
        text = re.split(r"[;,%]", self.src[first.end : end], maxsplit=1)[0]
        args = [Node("argument", first.line, first.line, name=a) for a in re.findall(r"'[^']*'|\S+", text)]
        while self.t.start < first.end + len(text.rstrip()) and self.t.kind not in ("nl", "eof"):
            self.take()
        return self.node("command", first, name=first.text, kids=args)

    def multi(self) -> Node | None:
        """[a, b] = expression"""
        i, depth = self.i, 0
        while self.toks[i].kind not in ("nl", "eof"):
            depth += {"[": 1, "]": -1}.get(self.toks[i].text, 0)
            i += 1
            if not depth:
                break
        if self.toks[i].text != "=":
            return None
        first, names = self.take("["), []
        while self.t.text != "]":
            names += [] if self.t.text in (",", "~") else [self.expression(stop=True)]
            if self.t.text in (",", "~"):
                self.take()
        self.take("]")
        left = self.node("outputs", first, kids=names)
        self.take("=")
        return self.node("assignment", first, kids=[left, self.expression()])

    def keyword(self) -> Node:
        first = self.take()
        k = first.text
        if k in ("return", "break", "continue"):
            return self.node(k, first)
        if k in ("global", "persistent"):
            names = []
            while not self.line_end():
                t = self.take()
                if t.kind == "id":
                    names.append(Node("name", t.line, t.line, t.start, t.end, t.text))
            return self.node(k, first, kids=names)
        if k in ("function", "classdef"):
            return self.function(first) if k == "function" else self.rest_of_class(first)
        if k == "if":
            clauses = [(self.expression(), self.block({"elseif", "else", "end"}))]
            while self.t.text == "elseif":
                self.take()
                clauses.append((self.expression(), self.block({"elseif", "else", "end"})))
            other = None
            if self.t.text == "else":
                self.take()
                other = self.block({"end"})
            self.take("end")
            kids = [x for c, b in clauses for x in (c, *b)] + (other or [])
            return self.node("if", first, kids=kids, extra={"clauses": clauses, "other": other})
        if k in ("for", "parfor", "while"):
            paren = self.t.text == "(" and k != "while"
            if k == "while":
                head, var = self.expression(), None
            else:
                if paren:
                    self.take("(")
                var = self.expression(stop=True)
                self.take("=")
                head = self.expression()
                if paren:
                    while self.t.text != ")":
                        self.take()
                        if self.t.kind == "eof":
                            raise Unparsed("unclosed loop header")
                    self.take(")")
            body = self.block({"end"})
            self.take("end")
            return self.node(k, first, kids=[*([var] if var else []), head, *body], extra={"head": head, "var": var, "body": body})
        if k in ("switch", "try", "spmd"):
            kids = [self.expression()] if k == "switch" else []
            while self.t.text != "end":
                if self.t.kind == "eof":
                    raise Unparsed(f"unclosed {k}")
                if self.t.text in ("case",):
                    self.take()
                    kids.append(self.expression())
                elif self.t.text in ("otherwise", "catch"):
                    word = self.take()
                    if word.text == "catch" and self.t.kind == "id" and self.t.line == word.line and self.t.text not in KEYWORDS:
                        kids.append(self.expression())
                kids += self.block({"case", "otherwise", "catch", "end"})
            self.take("end")
            return self.node(k, first, kids=kids)
        raise Unparsed(f"unexpected {k!r} at line {first.line}")

    def rest_of_class(self, first: Tok) -> Node:
        while self.t.kind != "eof":
            self.take()
        return self.node("class", first)

    def function(self, first: Tok) -> Node:
        i = self.i
        while self.toks[i].kind not in ("nl", "eof") and self.toks[i].text not in ("=", "("):
            i += 1
        outputs = []
        if self.toks[i].text == "=":
            while self.t.text != "=":
                t = self.take()
                if t.kind == "id":
                    outputs.append(t.text)
            self.take("=")
        name = self.take().text
        while self.t.text == ".":
            self.take()
            name += "." + self.take().text
        params = []
        if self.t.text == "(":
            self.take()
            while self.t.text != ")":
                t = self.take()
                if t.kind == "eof":
                    raise Unparsed("unclosed parameter list")
                if t.kind == "id":
                    params.append(t.text)
            self.take(")")
        body = self.block({"end", "function"})
        if self.t.text == "end":
            self.take()
        return self.node("function", first, name=name, kids=body, extra={"params": params, "outputs": outputs})

    # expressions
    def expression(self, stop: bool = False, inside: str = "") -> Node:
        """Operands and operators up to a separator; stop: one operand only."""
        first, parts, want = self.t, [], True
        while True:
            t = self.t
            if t.kind in ("nl", "eof") or t.text in (";", ",", "=", ")", "]", "}"):
                break
            if t.kind == "bad":
                raise Unparsed(f"stray {t.text!r} at line {t.line}")
            if t.kind == "id" and t.text in KEYWORDS and not (t.text == "end" and inside):
                if parts:
                    break
                raise Unparsed(f"unexpected {t.text!r} at line {t.line}")
            if t.kind == "op" and t.text not in ("(", "[", "{", "@"):
                sign = t.text in ("-", "+") and not want and inside in ("[", "{") and t.spaced and not self.toks[self.i + 1].spaced
                self.take()
                want = t.text not in ("'", ".'")
                if sign:
                    want = True
                continue
            if not want and inside not in ("[", "{"):
                break
            parts.append(self.operand(inside))
            want = False
            if stop:
                break
        if not parts and first is self.t:
            raise Unparsed(f"expected an expression at line {first.line}")
        return parts[0] if len(parts) == 1 else self.node("group", first, kids=parts)

    def arguments(self, close: str) -> list[Node]:
        inside = {")": "(", "}": "{", "]": "["}[close]
        out = []
        while self.t.text != close:
            if self.t.kind == "eof":
                raise Unparsed(f"missing {close!r}")
            if self.t.kind == "nl":
                raise Unparsed(f"missing {close!r} at line {self.t.line}")
            if self.t.text in (",", ";", "="):
                self.take()
                continue
            out.append(self.expression(inside="(" if close == ")" else inside))
        self.take(close)
        return out

    def operand(self, inside: str) -> Node:
        t = self.take()
        if t.kind in ("num", "str") or t.text == "end":
            out = self.node("literal", t)
        elif t.kind == "id":
            out = self.node("name", t, name=t.text)
        elif t.text == "(":
            out = self.node("group", t, kids=self.arguments(")"))
        elif t.text in ("[", "{"):
            out = self.node("group", t, kids=self.arguments("]" if t.text == "[" else "}"))
        elif t.text == "@":
            if self.t.text == "(":
                self.take()
                params = [a for a in self.arguments(")")]
                body = self.expression(inside=inside if inside == "(" else "")
                return self.node("lambda", t, kids=[body], extra={"params": {n.name for p in params for n in p.walk() if n.kind == "name"}})
            name = self.take().text
            while self.t.text == "." and not self.t.spaced:
                self.take()
                name += "." + self.take().text
            return self.node("handle", t, name=name)
        else:
            raise Unparsed(f"unexpected {t.text!r} at line {t.line}")
        return self.postfix(out, t, inside)

    def postfix(self, out: Node, first: Tok, inside: str) -> Node:
        while True:
            t = self.t
            if t.spaced and inside in ("[", "{"):
                return out
            if t.text in ("(", "{") and (not t.spaced or t.text == "(") and out.kind != "literal":
                self.take()
                args = self.arguments(")" if t.text == "(" else "}")
                if out.kind == "field" and out.extra["member"].kind == "name":
                    member = out.extra["member"]
                    call = self.node("call", first, name=member.name, kids=args, extra={"of": None, "arguments": args, "object": out.extra["object"]})
                    out = self.node("field", first, kids=[out.extra["object"], call], extra={"object": out.extra["object"], "member": call, "dynamic": None})
                else:
                    out = self.node("call", first, name=out.name if out.kind == "name" else "", kids=args if out.kind == "name" else [out, *args], extra={"of": out, "arguments": args, "object": None})
            elif t.text == "." and not t.spaced and (self.toks[self.i + 1].kind == "id" or self.toks[self.i + 1].text == "("):
                self.take()
                if self.t.text == "(":
                    self.take()
                    inner = self.node("group", first, kids=self.arguments(")"))
                    out = self.node("field", first, kids=[out, inner], extra={"object": out, "member": inner, "dynamic": inner})
                else:
                    m = self.take()
                    member = Node("name", m.line, m.line, m.start, m.end, m.text)
                    out = self.node("field", first, kids=[out, member], extra={"object": out, "member": member, "dynamic": None})
            else:
                return out


#: commands that need no argument
ALONE = {"clear", "clc", "close", "figure", "hold", "format", "who", "whos", "load", "save", "path", "more", "drawnow", "tic", "toc", "grid", "axis", "cd"}


def parse(src: str) -> tuple[Node, list[tuple[int, int, str]]]:
    p = Parser(src.replace("\r\n", "\n"))
    return p.file(), p.errors
