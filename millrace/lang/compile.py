"""The mapping language compiled to Spark columns.

Every expression becomes a ``Val``: a column with a known type, and, only where they can occur, columns that say why
it failed, that it deletes, or that it assigns nothing. Failures are data: no expression aborts the query. What has
no column form raises ``NotCompilable``; the caller then runs the whole mapping in the interpreter (``plans.dynamic``).
Single methods that only Python offers run as one Arrow step on their own arguments.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace
from typing import Any, Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import parser as P


class NotCompilable(Exception):
    """No column form; the interpreter has to run."""


_NO = object()
NULL = T.NullType()
VARIANT = T.VariantType()
STRING, LONG, DOUBLE, BOOL, BINARY, STAMP = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.TimestampType()


@dataclass(frozen=True)
class Val:
    col: Column
    type: T.DataType
    error: Column | None = None  # text where it fails, else null
    deleted: Column | None = None
    nothing: Column | None = None
    literal: Any = _NO
    fields: dict | None = None  # of an object whose fields are known one by one

    def plain(self, what: str) -> Val:
        if self.deleted is not None or self.nothing is not None:
            raise NotCompilable(f"{what} of a value that may be deleted")
        return self


def either(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def both(a: Column | None, b: Column | None) -> Column | None:
    return a if b is None else b if a is None else a | b


def lit(v: Any) -> Val:
    if v is None:
        return Val(F.lit(None), NULL, literal=None)
    kind = BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else BINARY if isinstance(v, bytes) else STRING
    return Val(F.lit(v).cast(kind), kind, literal=v)


def failing(why: str, kind: T.DataType = NULL) -> Val:
    return Val(F.lit(None).cast(kind), kind, error=F.lit(why))


def obj(fields: dict[str, Val]) -> Val:
    kind = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    col = F.struct(*[v.col.cast(v.type).alias(k) if v.type != VARIANT else v.col.alias(k) for k, v in fields.items()]) if fields else F.struct()
    return Val(col, kind, error=either(*[v.error for v in fields.values()]), fields=fields)


def is_num(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.BinaryType))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if is_num(t):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if is_time(t):
        return "timestamp"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "unknown"


@dataclass
class Env:
    """What names mean while an expression is compiled."""

    doc: Val  # the message's document
    this: Val | None = None  # None: the document
    root: Val | None = None
    vars: dict[str, Val] = field(default_factory=dict)
    names: dict[str, Val] = field(default_factory=dict)
    maps: dict[str, list] = field(default_factory=dict)
    meta: Column | None = None  # map<string,string> of the input
    new_meta: Column | None = None
    error: Column | None = None  # struct<message,name,label,path>
    content: Column | None = None
    batch: tuple = ()  # partition columns
    order: tuple = ()
    depth: int = 0
    inner: bool = False  # inside a lambda: no windows, no Python

    def value(self) -> Val:
        return self.doc if self.this is None else self.this

    def window(self, ordered: bool):
        if self.inner or not self.order:
            raise NotCompilable("batch functions need a batch")
        w = Window.partitionBy(*self.batch)
        return w.orderBy(*self.order) if ordered else w


def compile_expr(node: Any, env: Env) -> Val:
    return _COMPILE[type(node)](node, env)


# reading


def read(v: Val, segments: tuple[str, ...]) -> Val:
    for i, s in enumerate(segments):
        if v.type == VARIANT:
            path = "$" + "".join(f"[{x}]" if x.isdigit() else "['" + x.replace("'", "\\'") + "']" for x in segments[i:])
            if "*" in segments[i:]:
                raise NotCompilable("a wildcard in a dynamic value")
            return Val(F.try_variant_get(v.col, path, "variant"), VARIANT, v.error)
        if v.fields is not None:
            if s not in v.fields:
                return replace(lit(None), error=v.error)
            v = v.fields[s]
        elif isinstance(v.type, T.StructType):
            if s not in v.type.names:
                return replace(lit(None), error=v.error)
            v = Val(v.col.getField(s), v.type[s].dataType, v.error)
        elif isinstance(v.type, T.MapType):
            v = Val(F.try_element_at(v.col, F.lit(s)), v.type.valueType, v.error)
        elif isinstance(v.type, T.ArrayType):
            if not s.lstrip("-").isdigit():
                raise NotCompilable("a wildcard path")
            n = int(s)
            v = Val(F.try_element_at(v.col, F.lit(n + 1 if n >= 0 else n)), v.type.elementType, v.error)
        else:
            return replace(lit(None), error=v.error)
    return v


def _path(n: P.Path, env: Env) -> Val:
    if n.base == "this":
        base = env.value()
    elif n.base == "root":
        if env.root is None:
            return lit(None)
        base = env.root
    else:
        base = env.names[n.base]
    return read(base, n.segments)


def _var(n: P.Var, env: Env) -> Val:
    return env.vars[n.name] if n.name in env.vars else failing(f"variable '{n.name}' undefined")


def _meta(n: P.Meta, env: Env) -> Val:
    source = env.new_meta if env.new_meta is not None else env.meta
    if source is None:
        raise NotCompilable("no metadata column")
    return Val(source, T.MapType(STRING, STRING)) if n.key is None else Val(F.try_element_at(source, F.lit(n.key)), STRING)


def bound(node: Any, value: Val, env: Env, inner: bool = False) -> Val:
    """A query argument with a value as context, or bound to its name."""
    env = replace(env, inner=env.inner or inner)
    if isinstance(node, P.Lambda):
        return compile_expr(node.body, replace(env, names=env.names | ({} if node.name == "_" else {node.name: value})))
    return compile_expr(node, replace(env, this=value))


# coercion


def number(v: Val, what: str = "use") -> Val:
    """The value as a number; null and other kinds fail."""
    v = v.plain(what)
    if v.type == VARIANT:
        col = F.try_variant_get(v.col, "$", "double")
        return Val(col, DOUBLE, either(v.error, F.when(col.isNull(), F.lit("expected number value"))))
    if not is_num(v.type):
        return failing(f"expected number value, got {kind_of(v.type)}", DOUBLE) if v.error is None else Val(F.lit(None).cast("double"), DOUBLE, v.error)
    if isinstance(v.type, T.DecimalType):
        v = Val(v.col.cast("double"), DOUBLE, v.error)
    elif is_int(v.type):
        v = Val(v.col.cast("long"), LONG, v.error, literal=v.literal)
    else:
        v = Val(v.col.cast("double"), DOUBLE, v.error, literal=v.literal)
    return v if v.literal is not _NO else replace(v, error=either(v.error, F.when(v.col.isNull(), F.lit("expected number value, got null"))))


def text(v: Val, what: str = "use") -> Val:
    v = v.plain(what)
    if v.type == VARIANT:
        col = F.try_variant_get(v.col, "$", "string")
        return Val(col, STRING, either(v.error, F.when(col.isNull(), F.lit("expected string value"))))
    if is_time(v.type):
        return Val(rfc3339(v.col), STRING, v.error)
    if not is_text(v.type):
        return Val(F.lit(None).cast("string"), STRING, either(v.error, F.lit(f"expected string value, got {kind_of(v.type)}")))
    out = v if isinstance(v.type, T.StringType) else Val(F.decode(v.col, "UTF-8"), STRING, v.error)
    return out if v.literal is not _NO else replace(out, error=either(v.error, F.when(v.col.isNull(), F.lit("expected string value, got null"))))


def truth(v: Val) -> Val:
    """A condition: null counts as false, what is no boolean fails."""
    v = v.plain("a condition")
    if v.type == VARIANT:
        return Val(F.coalesce(F.try_variant_get(v.col, "$", "boolean"), F.lit(False)), BOOL, v.error)
    if isinstance(v.type, T.NullType):
        return Val(F.lit(False), BOOL, v.error)
    if not isinstance(v.type, T.BooleanType):
        return Val(F.lit(False), BOOL, either(v.error, F.lit(f"expected bool value, got {kind_of(v.type)}")))
    return Val(F.coalesce(v.col, F.lit(False)), BOOL, v.error, literal=v.literal)


def boolean(v: Val) -> Val:
    """An operand of && and ||: numbers are true unless 0, null fails."""
    v = v.plain("a boolean")
    if is_num(v.type):
        v = number(v)
        return Val(v.col != 0, BOOL, v.error)
    out = truth(v)
    return out if v.literal is not _NO else replace(out, error=either(v.error, F.when(v.col.isNull(), F.lit("expected bool value, got null"))))


def stamp(v: Val) -> Val:
    """A timestamp from a timestamp, unix seconds or RFC 3339 text."""
    v = v.plain("a timestamp")
    if isinstance(v.type, T.TimestampType):
        out = v
    elif is_time(v.type):
        out = Val(v.col.cast("timestamp"), STAMP, v.error)
    elif is_num(v.type):
        out = Val(F.timestamp_micros((F.round(v.col.cast("double") * 1e6) if not is_int(v.type) else v.col.cast("long") * 1_000_000).cast("long")), STAMP, v.error)
    else:
        t = text(v)
        shaped = t.col.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d+)?([Zz]|[+-]\d{2}:\d{2})$")
        out = Val(F.when(shaped, F.regexp_replace(t.col, r"(\.\d{6})\d+", "$1").try_cast("timestamp")), STAMP, t.error)
    return replace(out, error=either(out.error, F.when(out.col.isNull(), F.lit("expected timestamp value"))))


def rfc3339(t: Column) -> Column:
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(micros.cast("string"), 6, "0"), F.lit("0"))))
    return F.concat(base, fraction, F.lit("Z"))


def string_of(v: Val) -> Val:
    """The canonical text of a value."""
    v = v.plain("text")
    if isinstance(v.type, T.StringType):
        return Val(F.coalesce(v.col, F.lit("null")), STRING, v.error, literal=v.literal if isinstance(v.literal, str) else _NO)
    if isinstance(v.type, T.NullType):
        return lit("null")
    if is_int(v.type) or isinstance(v.type, T.BooleanType):
        return Val(F.coalesce(v.col.cast("string"), F.lit("null")), STRING, v.error)
    if is_text(v.type) or is_time(v.type):
        return Val(F.coalesce(text(v).col, F.lit("null")), STRING, v.error)
    if is_num(v.type):
        d = v.col.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e6)
        exact = F.when(whole, F.floor(d).cast("string")).when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e6), d.cast("string"))
        return Val(F.coalesce(exact, F.when(d.isNull(), F.lit("null")), d.cast("string")), STRING, v.error)
    if v.type == VARIANT:
        return Val(F.coalesce(F.try_variant_get(v.col, "$", "string"), F.to_json(v.col), F.lit("null")), STRING, v.error)
    return Val(json_text(v), STRING, v.error)


def json_text(v: Val) -> Column:
    """JSON with nulls kept and keys sorted."""
    if v.type == VARIANT:
        return F.to_json(v.col)
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.to_variant_object(v.col))
    if is_text(v.type) or is_time(v.type):
        return F.regexp_replace(F.to_json(F.array(text(v).col)), r"^\[|\]$", "")
    return string_of(v).col


# operators


def _common(a: T.DataType, b: T.DataType) -> T.DataType | None:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if is_num(a) and is_num(b):
        return LONG if is_int(a) and is_int(b) else DOUBLE
    if is_time(a) and is_time(b):
        return STAMP
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        e = _common(a.elementType, b.elementType)
        return e and T.ArrayType(e)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        kinds = [_common(x.dataType, y.dataType) for x, y in zip(a, b)]
        return None if None in kinds else T.StructType([T.StructField(n, k) for n, k in zip(a.names, kinds)])
    return None


def _to(v: Val, kind: T.DataType) -> Column:
    if kind == VARIANT:
        return v.col if v.type == VARIANT else F.parse_json(json_text(v)) if not isinstance(v.type, T.NullType) else F.lit(None).cast("variant")
    return v.col if v.type == kind else v.col.cast(kind)


def unify(values: list[Val]) -> T.DataType:
    kind: T.DataType | None = NULL
    for v in values:
        kind = _common(kind, v.type) if kind is not None else None
    return VARIANT if kind is None else kind


def _against(a: Val, b: Val) -> tuple[Val, Val] | None:
    """Two values brought to kinds that compare, or None."""
    if a.type == VARIANT and b.type == VARIANT:
        return string_of(a), string_of(b)
    if a.type == VARIANT:
        out = _against(b, a)
        return out and (out[1], out[0])
    if b.type == VARIANT:
        name = "double" if is_num(a.type) else a.type.simpleString()
        if isinstance(a.type, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
            return string_of(a), string_of(b)
        return (Val(a.col.cast(name), DOUBLE, a.error) if is_num(a.type) else a), Val(F.try_variant_get(b.col, "$", name), DOUBLE if is_num(a.type) else a.type, b.error)
    if is_text(a.type) and is_text(b.type) and a.type != b.type:
        return text(a), text(b)
    if is_time(a.type) and is_text(b.type):
        return a, stamp(b)
    if is_text(a.type) and is_time(b.type):
        return stamp(a), b
    if isinstance(a.type, T.BooleanType) and is_num(b.type):
        return a, Val(b.col != 0, BOOL, b.error)
    kind = _common(a.type, b.type)
    if kind is None:
        return None
    return Val(_to(a, kind), kind, a.error), Val(_to(b, kind), kind, b.error)


def equals(a: Val, b: Val) -> Val:
    a, b = a.plain("=="), b.plain("==")
    error = either(a.error, b.error)
    if isinstance(b.type, T.NullType) or isinstance(a.type, T.NullType):
        other = a if isinstance(b.type, T.NullType) else b
        none = other.col.isNull() if other.type != VARIANT else other.col.isNull() | F.is_variant_null(other.col)
        return Val(none if not isinstance(other.type, T.NullType) else F.lit(True), BOOL, error)
    pair = _against(a, b)
    if pair is None:
        return Val(a.col.isNull() & b.col.isNull(), BOOL, error)
    return Val(pair[0].col.eqNullSafe(pair[1].col), BOOL, error)


def _bin(n: P.Bin, env: Env) -> Val:
    if n.op == "|":
        return coalesced(compile_expr(n.left, env), compile_expr(n.right, env))
    if n.op in ("&&", "||"):
        a, b = boolean(compile_expr(n.left, env)), boolean(compile_expr(n.right, env))
        decided = a.col == F.lit(n.op == "||")
        rest = F.when(~decided, b.error) if b.error is not None else None
        return Val((a.col & b.col) if n.op == "&&" else (a.col | b.col), BOOL, either(a.error, rest))
    a, b = compile_expr(n.left, env), compile_expr(n.right, env)
    if n.op in ("==", "!="):
        out = equals(a, b)
        return out if n.op == "==" else replace(out, col=~out.col)
    if n.op in ("<", ">", "<=", ">="):
        pair = _against(a.plain(n.op), b.plain(n.op))
        if pair is None or isinstance(pair[0].type, (T.NullType, T.StructType, T.ArrayType, T.MapType)):
            return failing(f"cannot compare types {kind_of(a.type)} and {kind_of(b.type)}", BOOL)
        x, y = pair
        col = {"<": x.col < y.col, ">": x.col > y.col, "<=": x.col <= y.col, ">=": x.col >= y.col}[n.op]
        return Val(col, BOOL, either(x.error, y.error, F.when(col.isNull(), F.lit("cannot compare with null"))))
    if n.op == "+" and is_text(a.type) and is_text(b.type):
        x, y = text(a), text(b)
        return Val(F.concat(x.col, y.col), STRING, either(x.error, y.error))
    if n.op == "+" and {kind_of(a.type), kind_of(b.type)} == {"unknown", "string"}:
        x, y = text(a), text(b)
        return Val(F.concat(x.col, y.col), STRING, either(x.error, y.error))
    x, y = number(a, n.op), number(b, n.op)
    error = either(x.error, y.error)
    if n.op == "/":
        zero = None if y.literal is not _NO and y.literal else F.when(y.col == 0, F.lit("attempted to divide by zero"))
        divisor = y.col if zero is None else F.nullif(y.col, F.lit(0).cast(y.type))
        return Val(x.col.cast("double") / divisor.cast("double"), DOUBLE, either(error, zero))
    if n.op == "%":
        zero = None if y.literal is not _NO and y.literal else F.when(y.col == 0, F.lit("attempted to divide by zero"))
        divisor = y.col.cast("long") if zero is None else F.nullif(y.col.cast("long"), F.lit(0).cast("long"))
        return Val(x.col.cast("long") % divisor, LONG, either(error, zero))
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[n.op]
    if is_int(x.type) and is_int(y.type):
        col = f(x.col, y.col)
        return Val(col, LONG, either(error, F.when(col.isNull(), F.lit("integer overflow"))))
    return Val({"+": x.col.cast("double") + y.col, "-": x.col.cast("double") - y.col, "*": x.col.cast("double") * y.col}[n.op], DOUBLE, error)


def coalesced(a: Val, b: Val) -> Val:
    """a, or b where a fails, is null, deletes or assigns nothing."""
    kind = unify([a, b])
    bad = a.col.isNull() if not isinstance(a.type, T.NullType) else F.lit(True)
    if a.type == VARIANT:
        bad = bad | F.coalesce(F.is_variant_null(a.col), F.lit(False))
    for flag in (a.error.isNotNull() if a.error is not None else None, a.deleted, a.nothing):
        bad = bad if flag is None else bad | flag
    col = F.when(bad, _to(b, kind)).otherwise(_to(a, kind))
    only = lambda e: None if e is None else F.when(bad, e)
    flag = lambda e: None if e is None else bad & e
    return Val(col, kind, only(b.error), flag(b.deleted), flag(b.nothing))


def caught(a: Val, b: Val) -> Val:
    """a, or b where a fails."""
    if a.error is None:
        return a
    kind = unify([a, b])
    bad = a.error.isNotNull()
    only = lambda e: None if e is None else F.when(bad, e)
    return Val(F.when(bad, _to(b, kind)).otherwise(_to(a, kind)), kind, only(b.error), b.deleted and (bad & b.deleted), b.nothing and (bad & b.nothing))


def cases(arms: list[tuple[Val, Val]], other: Val) -> Val:
    """The value of the first arm whose condition holds."""
    values = [v for _, v in arms] + [other]
    kind = unify(values)

    def ladder(of: Callable[[Val], Column | None], default):
        picked = [of(v) for v in values]
        if all(p is None for p in picked):
            return None
        out = None
        for (cond, _), p in zip(arms, picked):
            p = default if p is None else p
            out = F.when(cond.col, p) if out is None else out.when(cond.col, p)
        return out.otherwise(default if picked[-1] is None else picked[-1])

    error = ladder(lambda v: v.error, F.lit(None).cast("string"))
    before = None
    for cond, _ in arms:  # a condition that fails matters only if no earlier arm was taken
        if cond.error is not None:
            before = either(before, cond.error)
    fields = None
    if all(v.fields is not None for v in values) and len({tuple(v.fields) for v in values}) == 1:
        fields = {k: cases([(c, v.fields[k]) for c, v in arms], other.fields[k]) for k in values[0].fields}
        kind = T.StructType([T.StructField(k, f.type) for k, f in fields.items()])
        return Val(obj(fields).col, kind, either(before, error), ladder(lambda v: v.deleted, F.lit(False)), ladder(lambda v: v.nothing, F.lit(False)), fields=fields)
    return Val(ladder(lambda v: _to(v, kind), F.lit(None)), kind, either(before, error), ladder(lambda v: v.deleted, F.lit(False)), ladder(lambda v: v.nothing, F.lit(False)))



def nothing() -> Val:
    return Val(F.lit(None), NULL, nothing=F.lit(True))


def deleted() -> Val:
    return Val(F.lit(None), NULL, deleted=F.lit(True))


def _if(n: P.If, env: Env) -> Val:
    arms = [(truth(compile_expr(c, env)), compile_expr(v, env)) for c, v in n.arms]
    return cases(arms, nothing() if n.other is None else compile_expr(n.other, env))


def _match(n: P.Match, env: Env) -> Val:
    inner = env if n.subject is None else replace(env, this=compile_expr(n.subject, env))
    arms, other = [], nothing()
    for pattern, value in n.cases:
        if pattern is None:
            other = compile_expr(value, inner)
            break
        if isinstance(pattern, P.Lit):
            cond = equals(inner.value(), lit(pattern.value))
        else:
            cond = truth(compile_expr(pattern, inner))
        ok = cond.col if cond.error is None else cond.col & cond.error.isNull()
        arms.append((Val(F.coalesce(ok, F.lit(False)), BOOL), compile_expr(value, inner)))
    return cases(arms, other) if arms else other


def _array(n: P.Arr, env: Env) -> Val:
    items = [compile_expr(i, env) for i in n.items]
    kind = unify(items)
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(STRING))
    error = either(*[v.error for v in items])
    if all(v.deleted is None and v.nothing is None for v in items):
        return Val(F.array(*[_to(v, kind) for v in items]), T.ArrayType(kind), error)
    kept = [F.when(~functools.reduce(lambda a, b: a | b, [f for f in (v.deleted, v.nothing) if f is not None], F.lit(False)), F.array(_to(v, kind))).otherwise(F.array().cast(T.ArrayType(kind))) for v in items]
    return Val(F.concat(*kept), T.ArrayType(kind), error)


def _object(n: P.Obj, env: Env) -> Val:
    fields: dict[str, Val] = {}
    for k, v in n.items:
        if not isinstance(k, P.Lit) or not isinstance(k.value, str):
            raise NotCompilable("a computed key")
        value = compile_expr(v, env)
        if value.deleted is not None or value.nothing is not None:
            raise NotCompilable("a member that may vanish")
        fields[k.value] = value
    return obj(fields)


def _call(n: P.Call, env: Env) -> Val:
    from millrace.functions.columns import FUNCTION_COLUMNS

    if n.name not in FUNCTION_COLUMNS:
        raise NotCompilable(f"function {n.name}")
    return FUNCTION_COLUMNS[n.name](env, *n.args, **{k: v for k, v in n.named})


def _method(n: P.Method, env: Env) -> Val:
    from millrace.functions.columns import METHOD_COLUMNS, PYTHON_METHODS

    named = {k.rstrip("_"): v for k, v in n.named}
    if n.name in ("sum", "max", "min", "length") and not n.args and (over := _over_batch(n, env)) is not None:
        return over
    if n.name in METHOD_COLUMNS:
        try:
            return METHOD_COLUMNS[n.name](env, n.target, *n.args, **named)
        except NotCompilable:
            if n.name not in PYTHON_METHODS:
                raise
    if n.name in PYTHON_METHODS and not env.inner:
        if named:
            raise NotCompilable("named arguments in a Python step")
        return python(n.name, compile_expr(n.target, env), tuple(compile_expr(a, env) for a in n.args))
    raise NotCompilable(f"method {n.name}")


def _over_batch(n: P.Method, env: Env) -> Val | None:
    """``x.from_all().sum()`` and its like as plain window aggregates, and with ``.slice(0, batch_index() + 1)`` as running ones: no array is built."""
    source, running = n.target, False
    if isinstance(source, P.Method) and source.name == "slice" and source.args == (P.Lit(0), P.Bin("+", P.Call("batch_index"), P.Lit(1))):
        source, running = source.target, True
    if not isinstance(source, P.Method) or source.name != "from_all":
        return None
    w = env.window(True).rowsBetween(Window.unboundedPreceding, 0) if running else env.window(False)
    if n.name == "length":
        return Val(F.count(F.lit(1)).over(w), LONG)
    v = number(compile_expr(source.target, env))
    col = {"sum": lambda: F.sum(v.col.cast("double")), "max": lambda: F.max(v.col), "min": lambda: F.min(v.col)}[n.name]()
    error = None if v.error is None else F.min(v.error).over(w)
    return Val(col.over(w), DOUBLE if n.name == "sum" else v.type, error)


def python(name: str, target: Val, args: tuple[Val, ...]) -> Val:
    """One method run by the interpreter's library in an Arrow step on its own arguments."""
    from millrace.functions.columns import PYTHON_METHODS
    from millrace.plans.dynamic import method_step

    result = PYTHON_METHODS[name]
    values = [v.plain(name) for v in (target, *args)]
    as_json = [isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)) or v.type == VARIANT for v in values]
    sent = [json_text(v) if j else (v.col if not isinstance(v.type, T.NullType) else v.col.cast("string")) for v, j in zip(values, as_json)]
    out = method_step(name, tuple(as_json), result)(*sent)
    error = either(*[v.error for v in values], out["error"])
    if result == "json":
        return Val(F.parse_json(out["value"]), VARIANT, error)
    return Val(out["value"], T._parse_datatype_string(result), error)


def _neg(n: P.Neg, env: Env) -> Val:
    v = number(compile_expr(n.value, env))
    return Val(-v.col, v.type, v.error)


def _not(n: P.Not, env: Env) -> Val:
    v = boolean(compile_expr(n.value, env))
    return Val(~v.col, BOOL, v.error)


def _lambda(n: P.Lambda, env: Env) -> Val:
    raise NotCompilable("a lambda is no value")


_COMPILE = {
    P.Lit: lambda n, env: lit(n.value),
    P.Path: _path,
    P.Var: _var,
    P.Meta: _meta,
    P.Bin: _bin,
    P.Not: _not,
    P.Neg: _neg,
    P.If: _if,
    P.Match: _match,
    P.Arr: _array,
    P.Obj: _object,
    P.Call: _call,
    P.Method: _method,
    P.Get: lambda n, env: read(compile_expr(n.target, env), (n.segment,)),
    P.Bind: lambda n, env: bound(n.body, compile_expr(n.target, env), env),
    P.Lambda: _lambda,
}


# statements


@dataclass
class Mapped:
    """What a mapping makes of a document."""

    root: Val | None  # None: the document is left as it is
    deleted: Column | None = None
    error: Column | None = None
    meta: Column | None = None


def _write(base: Val | None, path: tuple[str, ...], value: Val) -> Val:
    if not path:
        return value
    first, rest = path[0], path[1:]
    if base is None or isinstance(base.type, T.NullType):
        fields: dict[str, Val] = {}
    elif base.fields is not None:
        fields = dict(base.fields)
    elif isinstance(base.type, T.StructType):
        fields = {f.name: Val(base.col.getField(f.name), f.dataType, base.error) for f in base.type}
    elif base.type == VARIANT or isinstance(base.type, T.MapType):
        raise NotCompilable("assignment into a dynamic object")
    else:
        return failing(f"unable to set target path {'.'.join(path)} as the value of its parent is a non-object type")
    old = fields.get(first)
    if rest:
        fields[first] = _write(old, rest, value)
    else:
        if value.deleted is not None:
            if value.deleted is not None and isinstance(value.type, T.NullType) and value.error is None and value.nothing is None:
                fields.pop(first, None)  # always deleted
                return obj(fields)
            raise NotCompilable("a field that is deleted in some rows")
        if value.nothing is not None:
            if isinstance(value.type, T.NullType) and value.error is None and old is None:
                return obj(fields) if base is not None else obj({})
            kept = old if old is not None else lit(None)
            kind = unify([replace(value, nothing=None), kept])
            value = Val(F.when(value.nothing, _to(kept, kind)).otherwise(_to(value, kind)), kind, value.error)
        fields[first] = replace(value, error=None)
        out = obj(fields)
        return replace(out, error=either(base.error if base is not None else None, value.error))
    out = obj(fields)
    return replace(out, error=either(base.error if base is not None else None, out.error))


def compile_mapping(mapping: P.Mapping, env: Env, onto: bool = False) -> Mapped:
    env = replace(env, maps=mapping.maps, vars={}, new_meta=env.meta)
    state = {"root": env.doc if onto else None, "gone": None, "error": None}
    if onto:
        env = replace(env, this=env.doc, root=env.doc)
    _run(mapping.statements, env, state, onto)
    return Mapped(state["root"], state["gone"], state["error"], state.get("meta"))


def _run(statements, env: Env, state: dict, onto: bool) -> Env:
    for s in statements:
        if isinstance(s, P.Branching):
            env = _branch(s, env, state, onto)
            continue
        value = compile_expr(s.value, env)
        state["error"] = either(state["error"], value.error)
        if s.kind == "let":
            if value.nothing is not None or value.deleted is not None:
                raise NotCompilable("a variable that may vanish")
            env = replace(env, vars=env.vars | {s.path[0]: value})
        elif s.kind == "meta":
            env = replace(env, new_meta=_write_meta(env.new_meta, s.path, value))
            state["meta"] = env.new_meta
        else:
            if not s.path:
                if value.deleted is not None:
                    state["gone"] = both(state["gone"], value.deleted)
                only_flags = isinstance(value.type, T.NullType) and (value.nothing is not None or value.deleted is not None)
                if only_flags:
                    continue  # deletes or leaves; there is nothing to take over
                if value.nothing is not None:
                    kept = state["root"] if state["root"] is not None else env.doc
                    value = cases([(Val(value.nothing, BOOL), kept)], replace(value, nothing=None, deleted=None, error=None))
                state["root"] = replace(value, deleted=None, error=None)
            else:
                state["root"] = _write(state["root"], s.path, replace(value, error=None))
                if state["root"].error is not None:
                    state["error"] = either(state["error"], state["root"].error)
                    state["root"] = replace(state["root"], error=None)
            env = replace(env, root=state["root"])
            if onto:
                env = replace(env, this=state["root"], doc=state["root"])
    return env


def _branch(s: P.Branching, env: Env, state: dict, onto: bool) -> Env:
    """Statements under a condition: each arm is run on its own and the outcomes are merged by case."""
    outcomes = []
    for cond, body in (*s.arms, (None, s.other)):
        own = dict(state)
        after = _run(body, env, own, onto)
        outcomes.append((None if cond is None else truth(compile_expr(cond, env)), own, after))
    if any(own.get("meta") is not state.get("meta") for _, own, _ in outcomes) or any(a.vars.keys() != env.vars.keys() for _, _, a in outcomes):
        raise NotCompilable("metadata or variables set under a condition")
    arms = outcomes[:-1]
    root_of = lambda o: o[1]["root"] if o[1]["root"] is not None else (env.doc if any(x[1]["root"] is not None for x in outcomes) else None)
    roots = [root_of(o) for o in outcomes]
    if roots[0] is not None:
        names = {n for r in roots for n in (r.fields or {})}
        if all(r.fields is not None for r in roots):
            order = list(dict.fromkeys(n for r in roots for n in r.fields))
            roots = [obj({n: r.fields.get(n, lit(None)) for n in order}) for r in roots] if names else roots
        state["root"] = cases([(o[0], r) for o, r in zip(arms, roots)], roots[-1])
    flags = [o[1]["gone"] for o in outcomes]
    if any(f is not None for f in flags):
        none = F.lit(False)
        merged = cases([(o[0], Val(f if f is not None else none, BOOL)) for o, f in zip(arms, flags)], Val(flags[-1] if flags[-1] is not None else none, BOOL))
        state["gone"] = merged.col
    errors = [o[1]["error"] for o in outcomes]
    if any(e is not None for e in errors) or any(o[0].error is not None for o in arms):
        none = F.lit(None).cast("string")
        merged = cases([(o[0], Val(e if e is not None else none, STRING)) for o, e in zip(arms, errors)], Val(errors[-1] if errors[-1] is not None else none, STRING))
        state["error"] = either(*[o[0].error for o in arms], merged.col)
    env = replace(env, root=state["root"])
    return replace(env, this=state["root"], doc=state["root"]) if onto and state["root"] is not None else env


def _write_meta(meta: Column | None, path: tuple, value: Val) -> Column:
    now = meta if meta is not None else F.create_map().cast("map<string,string>")
    if not path:
        if value.deleted is not None:
            return F.create_map().cast("map<string,string>")
        if value.fields is None:
            raise NotCompilable("metadata from a dynamic object")
        return F.create_map(*[x for k, v in value.fields.items() for x in (F.lit(k), string_of(v).col)]) if value.fields else F.create_map().cast("map<string,string>")
    rest = F.map_filter(now, lambda k, _: k != path[0])
    if value.deleted is not None and isinstance(value.type, T.NullType):
        return rest
    if value.deleted is not None or value.nothing is not None:
        raise NotCompilable("metadata that may vanish")
    return F.map_concat(rest, F.create_map(F.lit(path[0]), string_of(value).col))


def run_named(name: str, value: Val, env: Env) -> Val:
    """A named map applied to a value."""
    if name not in env.maps:
        return failing(f"map '{name}' was not found")
    if env.depth > 20:
        raise NotCompilable("a map that applies itself")
    inner = replace(env, doc=value, this=value, root=None, vars={}, names={}, depth=env.depth + 1, new_meta=env.meta)
    state = {"root": None, "gone": None, "error": None}
    _run(env.maps[name], inner, state, False)
    if state["gone"] is not None:
        raise NotCompilable("a map that deletes")
    out = state["root"] if state["root"] is not None else value
    return replace(out, error=either(value.error, state["error"]))
