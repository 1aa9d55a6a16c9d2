"""The mapping language run in Python, value by value.

The reference semantics of our engine: the compiler to columns must agree with it, and whatever has no column form
runs here inside an Arrow step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from millrace.lang import parser as P
from millrace.lang.values import DELETE, NOTHING, MappingError, as_bool, as_number, compare, equal, from_json, is_number, kind, read_path, to_text, write_path


@dataclass
class Message:
    """A row of a batch: raw content or a parsed document, metadata and an error."""

    content: Any = b""
    meta: dict = field(default_factory=dict)
    error: dict | None = None

    def document(self) -> Any:
        return from_json(self.content) if isinstance(self.content, (str, bytes)) else self.content


@dataclass
class Context:
    """What an expression can read."""

    batch: list[Message] = field(default_factory=lambda: [Message()])
    index: int = 0
    this: Any = NOTHING  # NOTHING: the message's document
    root: Any = None
    new_meta: dict = field(default_factory=dict)
    vars: dict = field(default_factory=dict)
    names: dict = field(default_factory=dict)
    maps: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)
    depth: int = 0

    def message(self) -> Message:
        if not 0 <= self.index < len(self.batch):
            return Message()
        return self.batch[self.index]

    def value(self) -> Any:
        return self.message().document() if self.this is NOTHING else self.this

    def with_(self, **changes) -> Context:
        out = Context(self.batch, self.index, self.this, self.root, self.new_meta, self.vars, self.names, self.maps, self.state, self.depth)
        for k, v in changes.items():
            setattr(out, k, v)
        return out


MOST_DEPTH = 500


def evaluate(node: Any, ctx: Context) -> Any:
    return _EVAL[type(node)](node, ctx)


def _path(n: P.Path, ctx: Context) -> Any:
    if n.base == "this":
        base = ctx.value()
        if not n.segments and base is NOTHING:
            raise MappingError("context was undefined")
    elif n.base == "root":
        base = ctx.root
    else:
        base = ctx.names[n.base]
    return read_path(base, n.segments)


def _var(n: P.Var, ctx: Context) -> Any:
    if n.name not in ctx.vars:
        raise MappingError(f"variable '{n.name}' undefined")
    return ctx.vars[n.name]


def _meta(n: P.Meta, ctx: Context) -> Any:
    return dict(ctx.new_meta) if n.key is None else ctx.new_meta.get(n.key)


def apply(node: Any, value: Any, ctx: Context) -> Any:
    """An argument that is a query, run with a value as its context (or bound to its name)."""
    if isinstance(node, P.Lambda):
        names = ctx.names if node.name == "_" else ctx.names | {node.name: value}
        return evaluate(node.body, ctx.with_(names=names))
    return evaluate(node, ctx.with_(this=value))


def arithmetic(op: str, a: Any, b: Any) -> Any:
    if op == "+" and isinstance(a, (str, bytes)) and isinstance(b, (str, bytes)):
        return to_text(a) + to_text(b)
    if not is_number(a) or not is_number(b):
        raise MappingError(f"cannot {dict(zip('+-*/%', ('add', 'subtract', 'multiply', 'divide', 'modulo')))[op]} types {kind(a)} and {kind(b)}")
    a, b = as_number(a), as_number(b)
    if op == "/":
        if b == 0:
            raise MappingError("attempted to divide by zero")
        return a / b
    if op == "%":
        a, b = int(a), int(b)
        if b == 0:
            raise MappingError("attempted to divide by zero")
        return a - b * int(abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
    out = a + b if op == "+" else a - b if op == "-" else a * b
    if isinstance(out, int) and not -(1 << 63) <= out < 1 << 63:
        out = (out + (1 << 63)) % (1 << 64) - (1 << 63)  # whole numbers wrap
    return out


def _bin(n: P.Bin, ctx: Context) -> Any:
    if n.op == "|":
        try:
            left = evaluate(n.left, ctx)
        except MappingError:
            left = None
        return evaluate(n.right, ctx) if left is None or left is DELETE or left is NOTHING else left
    a = evaluate(n.left, ctx)
    if n.op in ("&&", "||"):
        a = as_bool(a)
        return a if a == (n.op == "||") else as_bool(evaluate(n.right, ctx))
    b = evaluate(n.right, ctx)
    if n.op == "==":
        return equal(a, b)
    if n.op == "!=":
        return not equal(a, b)
    if n.op in (">", "<", ">=", "<="):
        c = compare(a, b)
        return {">": c > 0, "<": c < 0, ">=": c >= 0, "<=": c <= 0}[n.op]
    return arithmetic(n.op, a, b)


def truth(v: Any) -> bool:
    """A condition: null is false, anything but a boolean an error."""
    if v is None:
        return False
    if not isinstance(v, bool):
        raise MappingError(f"expected bool value, got {kind(v)}")
    return v


def _if(n: P.If, ctx: Context) -> Any:
    for cond, value in n.arms:
        if truth(evaluate(cond, ctx)):
            return evaluate(value, ctx)
    return NOTHING if n.other is None else evaluate(n.other, ctx)


def _match(n: P.Match, ctx: Context) -> Any:
    inner = ctx if n.subject is None else ctx.with_(this=evaluate(n.subject, ctx))
    for pattern, value in n.cases:
        if pattern is None:
            return evaluate(value, inner)
        if isinstance(pattern, P.Lit):
            hit = equal(inner.value(), pattern.value)
        else:
            try:
                hit = evaluate(pattern, inner) is True
            except MappingError:
                hit = False
        if hit:
            return evaluate(value, inner)
    return NOTHING


def _array(n: P.Arr, ctx: Context) -> list:
    return [v for v in (evaluate(i, ctx) for i in n.items) if v is not DELETE and v is not NOTHING]


def _object(n: P.Obj, ctx: Context) -> dict:
    out = {}
    for k, v in n.items:
        key = evaluate(k, ctx) if not isinstance(k, P.Path) or k.base != "this" or len(k.segments) != 1 else evaluate(k, ctx)
        if not isinstance(key, str):
            raise MappingError(f"object keys are strings, got {kind(key)}")
        value = evaluate(v, ctx)
        if value is not DELETE and value is not NOTHING:
            out[key] = value
    return out


def _call(n: P.Call, ctx: Context) -> Any:
    from millrace.functions.library import FUNCTIONS

    spec = FUNCTIONS.get(n.name)
    if spec is None:
        raise MappingError(f"unrecognised function '{n.name}'")
    return spec.run(ctx, None, n.args, n.named)


def _method(n: P.Method, ctx: Context) -> Any:
    from millrace.functions.library import METHODS

    spec = METHODS.get(n.name)
    if spec is None:
        raise MappingError(f"unrecognised method '{n.name}'")
    return spec.run(ctx, n.target, n.args, n.named)


def _get(n: P.Get, ctx: Context) -> Any:
    return read_path(evaluate(n.target, ctx), (n.segment,))


_EVAL = {
    P.Lit: lambda n, ctx: n.value,
    P.Path: _path,
    P.Var: _var,
    P.Meta: _meta,
    P.Bin: _bin,
    P.Not: lambda n, ctx: not as_bool(evaluate(n.value, ctx)),
    P.Neg: lambda n, ctx: -as_number(evaluate(n.value, ctx)),
    P.If: _if,
    P.Match: _match,
    P.Arr: _array,
    P.Obj: _object,
    P.Call: _call,
    P.Method: _method,
    P.Get: _get,
    P.Bind: lambda n, ctx: apply(n.body, evaluate(n.target, ctx), ctx),
    P.Lambda: lambda n, ctx: (_ for _ in ()).throw(MappingError("a lambda is no value")),
}


def run_map(name: str, value: Any, ctx: Context) -> Any:
    """A named map applied to a value: a document of its own."""
    if name not in ctx.maps:
        raise MappingError(f"map '{name}' was not found")
    if ctx.depth >= MOST_DEPTH:
        raise MappingError(f"map '{name}' exceeded the recursion limit")
    inner = ctx.with_(this=value, root=NOTHING, vars={}, names={}, depth=ctx.depth + 1)
    _statements(ctx.maps[name], inner, False)
    return value if inner.root is NOTHING else inner.root


def _statements(statements, ctx: Context, onto: bool) -> None:
    for s in statements:
        if isinstance(s, P.Branching):
            for cond, body in s.arms:
                if truth(evaluate(cond, ctx)):
                    _statements(body, ctx, onto)
                    break
            else:
                _statements(s.other, ctx, onto)
            continue
        value = evaluate(s.value, ctx)
        if value is NOTHING:
            continue
        if s.kind == "let":
            if value is DELETE:
                ctx.vars.pop(s.path[0], None)
            else:
                ctx.vars[s.path[0]] = value
        elif s.kind == "meta":
            if not s.path:
                ctx.new_meta.clear()
                if value is not DELETE:
                    ctx.new_meta.update(value if isinstance(value, dict) else {})
            elif value is DELETE:
                ctx.new_meta.pop(s.path[0], None)
            else:
                ctx.new_meta[s.path[0]] = value
        elif not s.path:
            ctx.root = value
            if onto:
                ctx.this = value
        else:
            if ctx.root is DELETE:
                continue
            base = ctx.root
            ctx.root = write_path({} if base is NOTHING or base is None else base, s.path, value)
            if onto:
                ctx.this = ctx.root


def run_mapping(mapping: P.Mapping, batch: list[Message], index: int, state: dict | None = None, onto: bool = False) -> Message | None:
    """The mapped message, or None if it is deleted.

    A mapping builds a new document while ``this`` stays the old one; with ``onto`` (a mutation) statements change
    the document in turn and later ones read what earlier ones wrote.
    """
    old = batch[index]
    ctx = Context(batch, index, new_meta=dict(old.meta), maps=mapping.maps, state=state if state is not None else {}, root=NOTHING, vars={})
    if onto:
        try:
            ctx.root = ctx.this = old.document()
        except MappingError:
            ctx.root = NOTHING
    _statements(mapping.statements, ctx, onto)
    if ctx.root is DELETE:
        return None
    return Message(old.content if ctx.root is NOTHING else ctx.root, ctx.new_meta, old.error)


def query(text_or_node: Any, value: Any = NOTHING, **more) -> Any:
    """Evaluate an expression on a value; for tests and tools."""
    node = P.parse_expression(text_or_node) if isinstance(text_or_node, str) else text_or_node
    return evaluate(node, Context(this=value, **more))


def interpolate(parts: list, batch: list[Message], index: int, state: dict | None = None) -> str:
    """The text of an interpolated field; a failing expression fails it."""
    out = []
    for p in parts:
        out.append(p if isinstance(p, str) else to_text(evaluate(p, Context(batch, index, new_meta=batch[index].meta, state=state if state is not None else {}))))
    return "".join(out)
