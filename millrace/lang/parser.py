"""The mapping language: text to a syntax tree.

A mapping is a list of statements, one a line. Operators bind in four ranks, each left to right:
``* / % |``, then ``+ -``, then comparisons, then ``&& ||`` (of equal rank).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Path:
    """``this``, ``root`` or a named context, and the segments read from it."""

    base: str
    segments: tuple[str, ...] = ()


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Meta:
    """``@key``; key None is all metadata."""

    key: str | None


@dataclass(frozen=True)
class Call:
    """A function."""

    name: str
    args: tuple = ()
    named: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Method:
    target: Any
    name: str
    args: tuple = ()
    named: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Get:
    """A field of the value of an expression."""

    target: Any
    segment: str


@dataclass(frozen=True)
class Bind:
    """``target.(expr)``: expr with the target as context."""

    target: Any
    body: Any


@dataclass(frozen=True)
class Lambda:
    name: str
    body: Any


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    value: Any


@dataclass(frozen=True)
class Neg:
    value: Any


@dataclass(frozen=True)
class If:
    arms: tuple[tuple[Any, Any], ...]
    other: Any = None


@dataclass(frozen=True)
class Match:
    """Cases of (pattern or None for the default, result)."""

    subject: Any
    cases: tuple[tuple[Any, Any], ...]


@dataclass(frozen=True)
class Arr:
    items: tuple


@dataclass(frozen=True)
class Obj:
    items: tuple[tuple[Any, Any], ...]


@dataclass(frozen=True)
class Assign:
    """kind: root, meta or let; path: segments below the root, the metadata key, or the variable's name."""

    kind: str
    path: tuple
    value: Any


@dataclass(frozen=True)
class Branching:
    """A statement-level if: arms of (condition, statements)."""

    arms: tuple
    other: tuple = ()


@dataclass
class Mapping:
    statements: list = field(default_factory=list)
    maps: dict[str, list] = field(default_factory=dict)


_TOKEN = re.compile(
    r"""
    (?P<ws>[ \t\r]+) | (?P<comment>\#[^\n]*) | (?P<nl>\n)
  | (?P<raw>\"\"\"(?:.|\n)*?\"\"\") | (?P<str>"(?:[^"\\\n]|\\.)*")
  | (?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
  | (?P<var>\$[A-Za-z_0-9]+) | (?P<at>@(?:[A-Za-z_0-9]+|"(?:[^"\\]|\\.)*")?)
  | (?P<id>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<op>->|=>|==|!=|>=|<=|&&|\|\||[-+*/%|<>=!(){}\[\],.:])
    """,
    re.X,
)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[0-7]{3}|.)")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}


def unescape(body: str) -> str:
    def one(m):
        c = m[1]
        if c[0] in "uUx" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c.isdigit():
            return chr(int(c, 8))
        if c not in _SIMPLE:
            raise ParseError(f"unknown escape \\{c}")
        return _SIMPLE[c]

    return _ESCAPE.sub(one, body)


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            line = text.count("\n", 0, at) + 1
            raise ParseError(f"line {line}: unexpected character {text[at]!r}")
        if m.lastgroup not in ("ws", "comment"):
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    out.append(("end", "", len(text)))
    return out


_RANKS = (("*", "/", "%", "|"), ("+", "-"), ("==", "!=", ">=", "<=", ">", "<"), ("&&", "||"))


class Parser:
    def __init__(self, text: str, load=None):
        self.text, self.tokens, self.at, self.load = text, tokenize(text), 0, load
        self.names: list[str] = []

    def fail(self, why: str):
        line = self.text.count("\n", 0, self.tokens[self.at][2]) + 1
        raise ParseError(f"line {line}: {why}, found {self.tokens[self.at][1]!r}")

    def peek(self, value: str | None = None, ahead: int = 0):
        kind, text, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return (kind in ("op", "id") and text == value) if value is not None else kind

    def word(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def take(self, value: str | None = None) -> str:
        kind, text, _ = self.tokens[self.at]
        if value is not None and not self.peek(value):
            self.fail(f"expected {value!r}")
        self.at += 1
        return text

    def accept(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def lines(self) -> None:
        while self.peek() == "nl":
            self.at += 1

    # statements

    def mapping(self) -> Mapping:
        out = Mapping()
        self.lines()
        start = self.at
        if not self._is_statement():
            try:
                value = self.expr()
                self.lines()
                if self.peek() == "end":
                    out.statements.append(Assign("root", (), value))
                    return out
            except ParseError:
                pass
            self.at = start
        while self.peek() != "end":
            self._statement(out.statements, out.maps)
            if self.peek() not in ("nl", "end"):
                self.fail("expected the end of the statement")
            self.lines()
        return out

    def _is_statement(self) -> bool:
        if self.peek() == "id" and self.word() in ("let", "map", "import", "from") and self.peek(ahead=1) in ("id", "str", "var"):
            return True
        if self.peek("meta") and (self.peek("=", 1) or self.peek(ahead=1) in ("id", "str")):
            return True
        i = self.at
        while self.tokens[i][0] in ("id", "str", "at", "num") or self.tokens[i][1] == ".":
            i += 1
        return i > self.at and self.tokens[i][0] == "op" and self.tokens[i][1] == "="

    def _statement(self, out: list, maps: dict) -> None:
        if self.peek("let") and self.peek(ahead=1) in ("id", "str"):
            self.take()
            name = self._name()
            self.take("=")
            self.lines()
            out.append(Assign("let", (name,), self.expr()))
        elif self.peek("map") and self.peek(ahead=1) == "id" and self.peek("{", 2):
            self.take()
            name = self.take()
            maps[name] = self._block(maps)
        elif self.peek("import") and self.peek(ahead=1) == "str":
            self.take()
            maps.update(Parser(self._file(), self.load).mapping().maps)
        elif self.peek("from") and self.peek(ahead=1) == "str":
            self.take()
            other = Parser(self._file(), self.load).mapping()
            out.extend(other.statements)
            maps.update(other.maps)
        elif self.peek("meta") and (self.peek("=", 1) or self.peek(ahead=1) in ("id", "str")):
            self.take()
            path = () if self.peek("=") else (self._name(),)
            self.take("=")
            self.lines()
            out.append(Assign("meta", path, self.expr()))
        elif self.peek("if"):
            out.append(self._branching(maps))
        elif self.peek() == "at":
            key = self.take()[1:]
            self.take("=")
            self.lines()
            out.append(Assign("meta", (key.strip('"'),) if key else (), self.expr()))
        else:
            segments = [self._segment()]
            while self.accept("."):
                segments.append(self._segment())
            if segments[0] == "root":
                segments = segments[1:]
            elif segments[0] == "this":
                self.fail("this cannot be assigned to")
            self.take("=")
            self.lines()
            out.append(Assign("root", tuple(segments), self.expr()))

    def _block(self, maps: dict) -> list:
        self.take("{")
        self.lines()
        out: list = []
        if not self._is_statement() and not self.peek("}") and not self.peek("if"):
            out.append(Assign("root", (), self.expr()))
            self.lines()
        while not self.peek("}"):
            self._statement(out, maps)
            self.lines()
        self.take("}")
        return out

    def _branching(self, maps: dict) -> Branching:
        arms, other = [], ()
        self.take("if")
        cond = self.expr()
        arms.append((cond, tuple(self._block(maps))))
        while self._else():
            if self.accept("if"):
                cond = self.expr()
                arms.append((cond, tuple(self._block(maps))))
            else:
                other = tuple(self._block(maps))
                break
        return Branching(tuple(arms), other)

    def _else(self) -> bool:
        start = self.at
        self.lines()
        if self.accept("else"):
            return True
        self.at = start
        return False

    def _file(self) -> str:
        path = unescape(self.take()[1:-1])
        if self.load is None:
            self.fail(f"imports are not enabled ({path})")
        return self.load(path)

    def _name(self) -> str:
        return unescape(self.take()[1:-1]) if self.peek() == "str" else self.take()

    def _segment(self) -> str:
        kind = self.peek()
        if kind == "str":
            return unescape(self.take()[1:-1])
        if kind in ("id", "num"):
            return self.take().replace("~1", ".").replace("~0", "~")
        self.fail("expected a path segment")

    # expressions

    def expr(self, rank: int = len(_RANKS) - 1):
        if rank < 0:
            return self.unary()
        left = self.expr(rank - 1)
        while True:
            start = self.at
            self.lines()
            if self.peek() == "op" and self.word() in _RANKS[rank]:
                op = self.take()
                self.lines()
                left = Bin(op, left, self.expr(rank - 1))
            else:
                self.at = start
                return left

    def unary(self):
        if self.accept("!"):
            return Not(self.unary())
        if self.accept("-"):
            value = self.unary()
            return Lit(-value.value) if isinstance(value, Lit) and isinstance(value.value, (int, float)) else Neg(value)
        return self.tail(self.term())

    def tail(self, value):
        while True:
            start = self.at
            self.lines()
            if not self.peek("."):
                self.at = start
                return value
            self.take(".")
            self.lines()
            if self.accept("("):
                self.lines()
                body = self.expr()
                self.lines()
                self.take(")")
                value = Bind(value, body)
            elif self.peek() == "id" and self.peek("(", 1):
                name = self.take()
                args, named = self.arguments()
                value = Method(value, name, args, named)
            elif self.peek() == "num":
                for part in self.take().split("."):
                    value = Get(value, part) if not isinstance(value, Path) else Path(value.base, (*value.segments, part))
            else:
                if self.accept("*"):
                    part = "*"
                else:
                    part = self._segment()
                value = Path(value.base, (*value.segments, part)) if isinstance(value, Path) else Get(value, part)

    def arguments(self) -> tuple[tuple, tuple]:
        self.take("(")
        args, named = [], []
        self.lines()
        while not self.peek(")"):
            if self.peek() == "id" and self.peek(":", 1):
                name = self.take()
                self.take(":")
                self.lines()
                named.append((name, self.expr()))
            else:
                args.append(self.expr())
            self.lines()
            if not self.accept(","):
                break
            self.lines()
        self.take(")")
        return tuple(args), tuple(named)

    def term(self):
        kind, text = self.peek(), self.word()
        if kind == "num":
            self.take()
            return Lit(float(text) if any(c in text for c in ".eE") else int(text))
        if kind == "str":
            self.take()
            return Lit(unescape(text[1:-1]))
        if kind == "raw":
            self.take()
            return Lit(text[3:-3])
        if kind == "var":
            self.take()
            return Var(text[1:])
        if kind == "at":
            self.take()
            key = text[1:]
            return Meta(unescape(key[1:-1]) if key.startswith('"') else key or None)
        if self.peek("("):
            return self._parenthesis()
        if self.peek("["):
            return self._array()
        if self.peek("{"):
            return self._object()
        if kind != "id":
            self.fail("expected an expression")
        if text in ("true", "false", "null") and not self.peek("(", 1):
            self.take()
            return Lit({"true": True, "false": False, "null": None}[text])
        if text == "if":
            return self._if()
        if text == "match":
            return self._match()
        if self.peek("->", 1):
            self.take()
            return self._lambda(text)
        if self.peek("(", 1):
            self.take()
            args, named = self.arguments()
            return Call(text, args, named)
        self.take()
        if text in ("this", "root") or text in self.names:
            return Path(text)
        return Path("this", (text.replace("~1", ".").replace("~0", "~"),))

    def _lambda(self, name: str) -> Lambda:
        self.take("->")
        self.lines()
        self.names.append(name)
        body = self.expr()
        self.names.pop()
        return Lambda(name, body)

    def _parenthesis(self):
        if self.peek(ahead=1) == "id" and self.peek(")", 2) and self.peek("->", 3):
            self.take()
            name = self.take()
            self.take(")")
            return self._lambda(name)
        self.take("(")
        self.lines()
        value = self.expr()
        self.lines()
        self.take(")")
        return value

    def _array(self) -> Arr:
        self.take("[")
        items = []
        self.lines()
        while not self.peek("]"):
            items.append(self.expr())
            self.lines()
            if not self.accept(","):
                break
            self.lines()
        self.take("]")
        return Arr(tuple(items))

    def _object(self) -> Obj:
        self.take("{")
        items = []
        self.lines()
        while not self.peek("}"):
            key = self.expr()
            self.lines()
            self.take(":")
            self.lines()
            items.append((key, self.expr()))
            self.lines()
            if not self.accept(","):
                break
            self.lines()
        self.take("}")
        return Obj(tuple(items))

    def _braced(self):
        self.take("{")
        self.lines()
        value = self.expr()
        self.lines()
        self.take("}")
        return value

    def _if(self) -> If:
        arms, other = [], None
        self.take("if")
        cond = self.expr()
        arms.append((cond, self._braced()))
        while self._else():
            if self.accept("if"):
                cond = self.expr()
                arms.append((cond, self._braced()))
            else:
                other = self._braced()
                break
        return If(tuple(arms), other)

    def _match(self) -> Match:
        self.take("match")
        subject = None if self.peek("{") else self.expr()
        self.take("{")
        cases = []
        self.lines()
        while not self.peek("}"):
            if self.peek("_") and self.peek("=>", 1):
                self.take()
                pattern = None
            else:
                pattern = self.expr()
            self.take("=>")
            self.lines()
            cases.append((pattern, self.expr()))
            self.lines()
            self.accept(",")
            self.lines()
        self.take("}")
        return Match(subject, tuple(cases))


def parse(text: str, load=None) -> Mapping:
    """A mapping; ``load`` reads the text of an imported file."""
    return Parser(text, load).mapping()


def parse_expression(text: str):
    p = Parser(text)
    p.lines()
    value = p.expr()
    p.lines()
    if p.peek() != "end":
        p.fail("expected the end of the expression")
    return value


_HOLE = re.compile(r"\$\{(\{)?!((?:[^}\"]|\"(?:[^\"\\]|\\.)*\")*)\}(\})?")


def parse_interpolation(text: str) -> list:
    """Literal strings and expressions in turn; ``${{!x}}`` stands for the text ``${!x}``."""
    out, at = [], 0
    for m in _HOLE.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
        out.append("${!" + m[2] + "}" if m[1] else parse_expression(m[2].strip()))
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out
