"""A tolerant parser for R source text: tokens, then a syntax tree by operator precedence.

What cannot be read becomes an RError node up to the end of its line, and parsing goes on after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>[ \t\f\r]+)|(?P<comment>\#[^\n]*)|(?P<newline>\n)
    |(?P<raw>[rR](?P<q>["'])(?P<dash>-*)(?:\[(?:.|\n)*?\](?P=dash)(?P=q)|\((?:.|\n)*?\)(?P=dash)(?P=q)|\{(?:.|\n)*?\}(?P=dash)(?P=q)))
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<number>0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[Li]?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[Li]?)
    |(?P<symbol>`(?:\\.|[^`\\])*`|(?:[^\W\d_]|\.(?!\d))[\w.]*)
    |(?P<op>:::|<<-|->>|%[^%\n]*%|\|\||&&|<=|>=|==|!=|<-|->|\|>|::|:=|\*\*|\[\[|[-+*/^<>=!&|~?:$@(){}\[\],;\\])
    |(?P<bad>.)""",
    re.X | re.S,
)
#: Binding powers (left, right) of infix operators, and the right power of prefix ones.
INFIX = {
    "?": (1, 2), "=": (4, 3), "<-": (6, 5), "<<-": (6, 5), ":=": (6, 5), "->": (7, 8), "->>": (7, 8), "~": (9, 10), "||": (11, 12), "|": (11, 12),
    "&&": (13, 14), "&": (13, 14), "<": (17, 18), ">": (17, 18), "<=": (17, 18), ">=": (17, 18), "==": (17, 18), "!=": (17, 18), "+": (19, 20), "-": (19, 20),
    "*": (21, 22), "/": (21, 22), "|>": (23, 24), ":": (25, 26), "^": (30, 27), "**": (30, 27),
}
PREFIX = {"?": 2, "~": 10, "!": 15, "-": 27, "+": 27}
SPECIAL, POSTFIX = (23, 24), 40
WORDS = {"if", "else", "for", "while", "repeat", "function", "break", "next", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_character_", "in"}
ASSIGN = {"<-", "<<-", "=", ":=", "->", "->>"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int
    end: tuple[int, int]


@dataclass
class Node:
    type: str
    lexeme: str
    start: tuple[int, int]
    end: tuple[int, int]
    children: list[tuple[str, Node]] = field(default_factory=list)
    value: object = None
    id: int = -1

    def get(self, role: str) -> Node | None:
        return next((c for r, c in self.children if r == role), None)

    def all(self, role: str) -> list[Node]:
        return [c for r, c in self.children if r == role]


def tokens(text: str) -> tuple[list[Token], list[Token]]:
    """Tokens without comments, and the comments."""
    out, comments, line, start = [], [], 1, 0
    for m in TOKEN.finditer(text):
        kind, piece = m.lastgroup, m.group()
        if m.group("raw") is not None:
            kind = "raw"
        col = m.start() - start + 1
        breaks = piece.count("\n")
        at = line
        if breaks:
            line += breaks
            start = m.start() + piece.rindex("\n") + 1
        if kind == "space":
            continue
        token = Token(kind, piece, at, col, (line, m.end() - start) if not kind == "newline" else (at, col))
        if kind == "symbol" and piece in WORDS:
            token.kind = "word"
        (comments if kind == "comment" else out).append(token)
    out.append(Token("end", "", line, len(text) - start + 1, (line, len(text) - start + 1)))
    return out, comments


class Problem(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.tokens, self.comments = tokens(text)
        self.at = 0
        self.depth = [False]  # whether newlines count as space

    def peek(self) -> Token:
        if self.depth[-1]:
            while self.tokens[self.at].kind == "newline":
                self.at += 1
        return self.tokens[self.at]

    def take(self, text: str | None = None) -> Token:
        t = self.peek()
        if text is not None and t.text != text:
            raise Problem(f"expected {text}")
        if t.kind == "end":
            raise Problem("unexpected end")
        self.at += 1
        return t

    def skip_newlines(self) -> None:
        while self.tokens[self.at].kind == "newline":
            self.at += 1

    def file(self) -> Node:
        root = Node("RExpressionList", "", (1, 1), (1, 1))
        self.expressions(root, "end")
        for c in self.comments:
            root.children.append(("comment", Node("RComment", c.text, (c.line, c.col), c.end)))
        if root.children:
            root.end = max(c.end for _, c in root.children)
        return root

    def expressions(self, into: Node, stop: str) -> None:
        while True:
            while self.tokens[self.at].kind == "newline" or self.tokens[self.at].text == ";":
                self.at += 1
            t = self.tokens[self.at]
            if t.kind == "end" or (stop == "}" and t.text == "}"):
                return
            begin = self.at
            try:
                into.children.append(("expr-list-child", self.expression(0)))
                after = self.tokens[self.at]
                if after.kind not in ("newline", "end") and after.text not in (";", "}"):
                    raise Problem("unexpected token")
            except Problem:
                if into.children and into.children[-1][1].start == (t.line, t.col):
                    into.children.pop()
                self.depth = self.depth[:1] if stop == "end" else self.depth
                self.at = max(self.at, begin)
                while self.tokens[self.at].kind not in ("newline", "end") and not (stop == "}" and self.tokens[self.at].text == "}"):
                    self.at += 1
                bad = self.tokens[begin : max(self.at, begin + 1)]
                into.children.append(("expr-list-child", Node("RError", " ".join(x.text for x in bad), (t.line, t.col), bad[-1].end)))
                if self.at == begin:
                    self.at += 1

    def expression(self, power: int) -> Node:
        left = self.prefix()
        while True:
            t = self.peek()
            if t.text in ("(", "[", "[[", "$", "@", "::", ":::") and t.kind == "op" and POSTFIX > power:
                left = self.postfix(left, t)
                continue
            powers = SPECIAL if t.kind == "op" and t.text.startswith("%") else INFIX.get(t.text) if t.kind == "op" else None
            if powers is None or powers[0] <= power:
                return left
            self.at += 1
            self.skip_newlines()
            right = self.expression(powers[1])
            kind = "RPipe" if t.text == "|>" else "RBinaryOp"
            left = Node(kind, t.text, left.start, right.end, [("binop-lhs", left), ("binop-rhs", right)])

    def prefix(self) -> Node:
        t = self.peek()
        start = (t.line, t.col)
        if t.kind == "op" and t.text in PREFIX:
            self.at += 1
            self.skip_newlines()
            x = self.expression(PREFIX[t.text])
            return Node("RUnaryOp", t.text, start, x.end, [("unary-op", x)])
        if t.text == "(" and t.kind == "op":
            self.at += 1
            self.depth.append(True)
            inner = self.expression(0)
            end = self.take(")")
            self.depth.pop()
            return Node("RExpressionList", "(", start, end.end, [("expr-list-child", inner)])
        if t.text == "{":
            self.at += 1
            self.depth.append(False)
            out = Node("RExpressionList", "{", start, start)
            self.expressions(out, "}")
            out.end = self.take("}").end
            self.depth.pop()
            return out
        if t.text == "\\" or t.text == "function":
            return self.function(t)
        if t.kind == "word":
            return self.word(t)
        if t.kind in ("number", "string", "raw", "symbol"):
            self.at += 1
            return literal(t)
        raise Problem(f"unexpected {t.text!r}")

    def word(self, t: Token) -> Node:
        start = (t.line, t.col)
        self.at += 1
        if t.text in ("TRUE", "FALSE"):
            return Node("RLogical", t.text, start, t.end, value=t.text == "TRUE")
        if t.text in ("break", "next"):
            return Node("RBreak" if t.text == "break" else "RNext", t.text, start, t.end)
        if t.text == "repeat":
            self.skip_newlines()
            body = self.expression(3)
            return Node("RRepeatLoop", t.text, start, body.end, [("repeat-body", body)])
        if t.text in ("while", "if"):
            self.take("(")
            self.depth.append(True)
            cond = self.expression(0)
            self.take(")")
            self.depth.pop()
            self.skip_newlines()
            body = self.expression(3)
            if t.text == "while":
                return Node("RWhileLoop", t.text, start, body.end, [("while-cond", cond), ("while-body", body)])
            out = Node("RIfThenElse", t.text, start, body.end, [("if-cond", cond), ("if-then", body)])
            back = self.at
            self.skip_newlines()
            if self.tokens[self.at].text == "else":
                self.at += 1
                self.skip_newlines()
                other = self.expression(3)
                out.children.append(("if-otherwise", other))
                out.end = other.end
            else:
                self.at = back
            return out
        if t.text == "for":
            self.take("(")
            self.depth.append(True)
            name = self.take()
            self.take("in")
            over = self.expression(0)
            self.take(")")
            self.depth.pop()
            self.skip_newlines()
            body = self.expression(3)
            return Node("RForLoop", t.text, start, body.end, [("for-variable", literal(name)), ("for-vector", over), ("for-body", body)])
        if t.text in ("else", "in"):
            raise Problem(f"unexpected {t.text}")
        return Node("RSymbol", t.text, start, t.end, value=t.text)

    def function(self, t: Token) -> Node:
        self.at += 1
        self.take("(")
        self.depth.append(True)
        out = Node("RFunctionDefinition", t.text, (t.line, t.col), t.end)
        while self.peek().text != ")":
            name = self.take()
            if name.kind not in ("symbol", "word"):
                raise Problem("bad parameter")
            p = Node("RParameter", name.text, (name.line, name.col), name.end, [("param-name", literal(name))])
            if self.peek().text == "=":
                self.at += 1
                value = self.expression(4)
                p.children.append(("param-value", value))
                p.end = value.end
            out.children.append(("function-def-param", p))
            if self.peek().text == ",":
                self.at += 1
        self.take(")")
        self.depth.pop()
        self.skip_newlines()
        body = self.expression(3)
        out.children.append(("function-def-body", body))
        out.end = body.end
        return out

    def postfix(self, left: Node, t: Token) -> Node:
        self.at += 1
        if t.text in ("$", "@"):
            self.skip_newlines()
            name = self.take()
            if name.text == "(" and name.kind == "op":
                self.depth.append(True)
                x = self.expression(0)
                end = self.take(")").end
                self.depth.pop()
            else:
                x, end = literal(name), name.end
            return Node("RAccess", t.text, left.start, end, [("accessed", left), ("index-access", argument(x))])
        if t.text in ("::", ":::"):
            name = self.take()
            out = literal(name)
            out.value, out.start = name.text.strip("`"), left.start
            out.lexeme = f"{left.lexeme}{t.text}{name.text}"
            out.children = [("namespace", left)]
            return out
        close = {"(": ")", "[": "]", "[[": "]"}[t.text]
        self.depth.append(True)
        args = self.arguments(close)
        end = self.take(close)
        if t.text == "[[":
            end = self.take("]")
        self.depth.pop()
        if t.text == "(":
            return Node("RFunctionCall", left.lexeme, left.start, end.end, [("call-name", left), *[("call-argument", a) for a in args]])
        return Node("RAccess", t.text, left.start, end.end, [("accessed", left), *[("index-access", a) for a in args]])

    def arguments(self, close: str) -> list[Node]:
        out: list[Node] = []
        while True:
            t = self.peek()
            if t.text == close and t.kind == "op":
                return out
            if t.text == ",":
                out.append(Node("RArgument", "", (t.line, t.col), (t.line, t.col)))
                self.at += 1
                continue
            after = self.tokens[self.at + 1 :]
            nxt = next((x for x in after if x.kind != "newline"), t)
            if t.kind in ("symbol", "string", "word") and nxt.text == "=" and nxt.kind == "op":
                self.at += 1
                self.take("=")
                a = Node("RArgument", t.text, (t.line, t.col), t.end, [("arg-name", literal(t))])
                if self.peek().text not in (",", close):
                    value = self.expression(4)
                    a.children.append(("arg-value", value))
                    a.end = value.end
            else:
                a = argument(self.expression(4))
            out.append(a)
            if self.peek().text == ",":
                self.at += 1
                last = self.peek()
                if close == "]" and last.text == close and last.kind == "op":
                    # x[i, ] has an empty second index
                    out.append(Node("RArgument", "", (last.line, last.col), (last.line, last.col)))
            elif self.peek().text != close:
                raise Problem("expected , in arguments")


def argument(x: Node) -> Node:
    return Node("RArgument", "", x.start, x.end, [("arg-value", x)])


#: What a backslash stands for before these characters.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def string_value(text: str) -> str:
    def out(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "xuU":
            return chr(int(x.strip("xuU{}"), 16))
        return ESCAPES.get(x, x)

    return re.sub(r"\\(x[0-9a-fA-F]{1,2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{1,4}|U[0-9a-fA-F]{1,8}|.)", out, text[1:-1], flags=re.S)


def number_value(text: str) -> float | int | complex:
    if text.endswith("i"):
        return complex(0, number_value(text[:-1]))
    whole = text.endswith("L")
    text = text.rstrip("L")
    value = (float.fromhex(text) if "p" in text.lower() or "." in text else int(text, 16)) if text.lower().startswith("0x") else float(text)
    return int(value) if whole else float(value)


def literal(t: Token) -> Node:
    start = (t.line, t.col)
    if t.kind == "number":
        return Node("RNumber", t.text, start, t.end, value=number_value(t.text))
    if t.kind == "string":
        return Node("RString", t.text, start, t.end, value=string_value(t.text))
    if t.kind == "raw":
        return Node("RString", t.text, start, t.end, value=re.sub(r"^[rR][\"'](-*)[\[({]|[\])}]-*[\"']$", "", t.text))
    if t.kind in ("symbol", "word"):
        return Node("RSymbol", t.text, start, t.end, value=t.text.strip("`"))
    raise Problem(f"unexpected {t.text!r}")


def parse(text: str) -> Node:
    """The tree of a file, nodes numbered in reading order."""
    root = Parser(text).file()
    n, todo = 0, [root]
    while todo:
        x = todo.pop()
        x.id, n = n, n + 1
        todo.extend(c for _, c in reversed(x.children))
    return root
