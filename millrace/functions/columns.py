"""Functions and methods as Spark columns, by name.

Each entry takes (env, target node, argument nodes...) and returns a ``Val``. ``PYTHON_METHODS`` lists methods that
run as one Arrow step on their own arguments, with the type of their result.
"""

from __future__ import annotations

import os
import socket
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import compile as C
from millrace.lang import parser as P
from millrace.lang.compile import BINARY, BOOL, DOUBLE, LONG, STAMP, STRING, VARIANT, Env, NotCompilable, Val, either, is_int, is_num, is_text, kind_of, lit, number, text

FUNCTION_COLUMNS: dict = {}
METHOD_COLUMNS: dict = {}
#: Result types of methods that the library runs in Python; json: any value, as a VARIANT.
PYTHON_METHODS = {
    "capitalize": "string", "unescape_html": "string", "escape_url_path": "string", "unescape_url_query": "string", "unescape_url_path": "string", "filepath_join": "string", "quote": "string", "unquote": "string",
    "format": "string", "string": "string", "re_find_object": "json", "re_find_all_object": "json", "re_find_all_submatch": "json", "parse_csv": "json", "parse_logfmt": "json", "parse_yaml": "json",
    "format_yaml": "binary", "format_json": "binary", "parse_url": "json", "parse_form_url_encoded": "json", "json_schema": "json", "infer_schema": "json", "hash": "binary", "encode": "string",
    "decode": "binary", "encrypt_aes": "binary", "decrypt_aes": "binary", "uuid_v5": "string", "compress": "binary", "decompress": "binary", "parse_duration": "bigint",
    "parse_duration_iso8601": "bigint", "ts_format": "string", "ts_strftime": "string", "ts_parse": "timestamp", "ts_strptime": "timestamp", "parse_timestamp": "string", "parse_timestamp_strptime": "string",
    "format_timestamp": "string", "format_timestamp_strftime": "string", "collapse": "json", "squash": "json", "merge": "json", "assign": "json", "with": "json", "without": "json", "reverse": "string",
    "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "uint64": "decimal(20,0)", "uint32": "bigint", "uint16": "int", "uint8": "smallint",
}


def method(*names: str):
    def put(f):
        METHOD_COLUMNS.update(dict.fromkeys(names, f))
        return f

    return put


def function(*names: str):
    def put(f):
        FUNCTION_COLUMNS.update(dict.fromkeys(names, f))
        return f

    return put


def constant(node, env: Env, what: str):
    v = C.compile_expr(node, env)
    if v.literal is C._NO:
        raise NotCompilable(f"{what} must be a literal")
    return v.literal


def texts(env: Env, *nodes) -> list[Val]:
    return [text(C.compile_expr(n, env)) for n in nodes]


def _text_method(name: str, f, *more: str):
    def run(env, target, *args):
        vals = texts(env, target, *args)
        return Val(f(*[v.col for v in vals]), STRING, either(*[v.error for v in vals]))

    METHOD_COLUMNS.update(dict.fromkeys((name, *more), run))


def _test_method(name: str, f):
    def run(env, target, *args):
        vals = texts(env, target, *args)
        return Val(f(*[v.col for v in vals]), BOOL, either(*[v.error for v in vals]))

    METHOD_COLUMNS[name] = run


_text_method("uppercase", F.upper)
_text_method("lowercase", F.lower)
_text_method("replace_all", lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)), "replace")
_text_method("trim_prefix", lambda s, p: F.when(F.startswith(s, p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s))
_text_method("trim_suffix", lambda s, p: F.when(F.endswith(s, p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s))
_text_method("escape_html", lambda s: F.replace(F.replace(F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;")))
_text_method("escape_url_query", lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
_test_method("has_prefix", F.startswith)
_test_method("has_suffix", F.endswith)


@method("trim")
def trim(env, target, cutset=None):
    (s,) = texts(env, target)
    if cutset is None:
        return Val(F.regexp_replace(s.col, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", ""), STRING, s.error)
    (c,) = texts(env, cutset)
    return Val(F.btrim(s.col, c.col), STRING, either(s.error, c.error))


@method("reverse")
def reverse(env, target):
    v = C.compile_expr(target, env)
    if isinstance(v.type, T.BinaryType):
        raise NotCompilable("bytes in reverse")
    s = text(v)
    return Val(F.reverse(s.col), STRING, s.error)


@method("repeat")
def repeat(env, target, count):
    (s,), n = texts(env, target), number(C.compile_expr(count, env))
    return Val(F.repeat(s.col, F.greatest(n.col, F.lit(0)).cast("int")), STRING, either(s.error, n.error, F.when(n.col < 0, F.lit("the count of repeat is negative"))))


@method("replace_all_many", "replace_many")
def replace_all_many(env, target, values):
    (s,) = texts(env, target)
    if not isinstance(values, P.Arr) or len(values.items) % 2:
        raise NotCompilable("replacements that are no literal list")
    for a, b in zip(values.items[::2], values.items[1::2]):
        s = Val(F.replace(s.col, F.lit(constant(a, env, "old")), F.lit(constant(b, env, "new"))), STRING, s.error)
    return s


@method("split")
def split(env, target, delimiter, empty_as_null=None):
    (s,) = texts(env, target)
    by = constant(delimiter, env, "delimiter")
    if by == "":
        parts = F.filter(F.split(s.col, ""), lambda c: c != "")
    else:
        parts = F.split(s.col, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    if empty_as_null is not None and constant(empty_as_null, env, "empty_as_null"):
        parts = F.transform(parts, lambda p: F.nullif(p, F.lit("")))
    return Val(parts, T.ArrayType(STRING), s.error)


@method("join")
def join(env, target, delimiter=None):
    a = array(env, target)
    if not isinstance(a.type.elementType, T.StringType):
        return Val(F.lit(None).cast("string"), STRING, F.lit("expected string value in array"))
    by = lit("") if delimiter is None else texts(env, delimiter)[0]
    bad = F.when(F.exists(a.col, lambda x: x.isNull()), F.lit("expected string value in array, got null"))
    return Val(F.array_join(a.col, by.literal) if by.literal is not C._NO else F.call_function("array_join", a.col, by.col), STRING, either(a.error, by.error, bad))


@method("index_of")
def index_of(env, target, value):
    s, v = texts(env, target, value)
    at = F.call_function("locate", v.col, s.col)
    return Val(F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(s.col, F.lit(1), at - 1))).cast("long"), LONG, either(s.error, v.error))


def java_regex(pattern: str) -> str:
    """A pattern of the mapping language in Java's syntax."""
    out = pattern.replace("(?P<", "(?<").replace(r"\C", ".").replace("(?U)", "")
    if "[[:" in out:
        for name, java in (("alpha", r"\p{Alpha}"), ("digit", r"\d"), ("alnum", r"\p{Alnum}"), ("space", r"\s"), ("upper", r"\p{Upper}"), ("lower", r"\p{Lower}"), ("punct", r"\p{Punct}"), ("word", r"\w")):
            out = out.replace(f"[:{name}:]", java)
    return out


def java_replacement(value: str) -> str:
    """``$1``, ``${1}`` and ``${name}``; a backslash is no escape."""
    import re

    out = value.replace("\\", "\\\\").replace("$$", "\\$")
    return re.sub(r"\$\{(\d+)\}", r"$\1", out)


@method("re_match")
def re_match(env, target, pattern):
    (s,) = texts(env, target)
    return Val(s.col.rlike(java_regex(constant(pattern, env, "pattern"))), BOOL, s.error)


@method("re_replace_all", "re_replace")
def re_replace_all(env, target, pattern, value):
    (s,) = texts(env, target)
    return Val(F.regexp_replace(s.col, java_regex(constant(pattern, env, "pattern")), java_replacement(constant(value, env, "value"))), STRING, s.error)


@method("re_find_all")
def re_find_all(env, target, pattern):
    (s,) = texts(env, target)
    return Val(F.regexp_extract_all(s.col, F.lit(java_regex(constant(pattern, env, "pattern"))), F.lit(0)), T.ArrayType(STRING), s.error)


def group_names(pattern: str) -> list[str]:
    """Keys of the groups, 0 first: the name where there is one, else the number."""
    import re

    out, n, at, in_class = ["0"], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        if c == "(" and not in_class:
            m = re.match(r"\(\?P?<([A-Za-z]\w*)>", pattern[at:])
            if m or not pattern.startswith("(?", at):
                n += 1
                out.append(m[1] if m else str(n))
        at += 1
    return out


@method("re_find_object")
def re_find_object(env, target, pattern):
    (s,) = texts(env, target)
    p = constant(pattern, env, "pattern")
    names = group_names(p)
    found = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.regexp_extract(s.col, java_regex(p), i) for i in range(len(names))]))
    return Val(F.when(s.col.rlike(java_regex(p)), found).otherwise(F.create_map().cast("map<string,string>")), T.MapType(STRING, STRING), s.error)


@method("re_find_all_submatch")
def re_find_all_submatch(env, target, pattern):
    (s,) = texts(env, target)
    p = constant(pattern, env, "pattern")
    groups = [F.regexp_extract_all(s.col, F.lit(java_regex(p)), F.lit(i)) for i in range(len(group_names(p)))]
    rows = F.transform(F.sequence(F.lit(1), F.size(groups[0])), lambda i: F.array(*[F.element_at(g, i) for g in groups]))
    empty = F.array().cast("array<array<string>>")
    return Val(F.when(F.size(groups[0]) > 0, rows).otherwise(empty), T.ArrayType(T.ArrayType(STRING)), s.error)


@method("bytes")
def to_bytes(env, target):
    v = C.compile_expr(target, env)
    return v if isinstance(v.type, T.BinaryType) else Val(F.encode(C.string_of(v).col, "UTF-8"), BINARY, v.error)


@method("string")
def to_string(env, target):
    v = C.compile_expr(target, env)
    if is_num(v.type) and not is_int(v.type):
        raise NotCompilable("text of a fraction")
    return C.string_of(v)


@method("filepath_split")
def filepath_split(env, target):
    (s,) = texts(env, target)
    return Val(F.array(F.regexp_extract(s.col, r"(?s)^(.*/)?", 0), F.regexp_extract(s.col, r"(?s)([^/]*)$", 1)), T.ArrayType(STRING), s.error)


def _binary(v: Val) -> Val:
    v = v.plain("bytes")
    return v if isinstance(v.type, T.BinaryType) else replace(t := text(v), col=F.encode(t.col, "UTF-8"), type=BINARY)


@method("encode")
def encode(env, target, scheme):
    b, how = _binary(C.compile_expr(target, env)), constant(scheme, env, "scheme")
    plain = F.regexp_replace(F.base64(b.col), "\r\n", "")
    forms = {"hex": lambda: F.lower(F.hex(b.col)), "base64": lambda: plain, "base64url": lambda: F.translate(plain, "+/", "-_"), "base64rawurl": lambda: F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))}
    if how not in forms:
        raise NotCompilable(how)
    return Val(forms[how](), STRING, b.error)


@method("decode")
def decode(env, target, scheme):
    (s,), how = texts(env, target), constant(scheme, env, "scheme")
    if how == "hex":
        ok = s.col.rlike("^([0-9a-fA-F]{2})*$")
        return Val(F.when(ok, F.unhex(s.col)), BINARY, either(s.error, F.when(~ok, F.lit("failed to decode hex"))))
    if how not in ("base64", "base64url", "base64rawurl"):
        raise NotCompilable(how)
    plain = s.col if how == "base64" else F.translate(s.col, "-_", "+/")
    if how == "base64rawurl":
        plain = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    ok = plain.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return Val(F.when(ok, F.unbase64(plain)), BINARY, either(s.error, F.when(~ok, F.lit(f"failed to decode {how}"))))


@method("hash")
def hash_(env, target, algorithm, *more):
    b, how = _binary(C.compile_expr(target, env)), constant(algorithm, env, "algorithm")
    if more and how != "crc32":
        raise NotCompilable("a keyed hash")
    forms = {"md5": lambda: F.unhex(F.md5(b.col)), "sha1": lambda: F.unhex(F.sha1(b.col)), "sha256": lambda: F.unhex(F.sha2(b.col, 256)), "sha512": lambda: F.unhex(F.sha2(b.col, 512)), "crc32": lambda: F.unhex(F.lpad(F.hex(F.crc32(b.col)), 8, "0"))}
    if how not in forms or more:
        raise NotCompilable(how)
    return Val(forms[how](), BINARY, b.error)


@method("contains")
def contains(env, target, value):
    v, x = C.compile_expr(target, env), C.compile_expr(value, env)
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        items = v.col if isinstance(v.type, T.ArrayType) else F.map_values(v.col)
        kind = v.type.elementType if isinstance(v.type, T.ArrayType) else v.type.valueType
        return Val(F.coalesce(F.exists(items, lambda e: C.equals(Val(e, kind), x).col), F.lit(False)), BOOL, either(v.error, x.error))
    s, w = text(v), text(x)
    return Val(F.contains(s.col, w.col), BOOL, either(s.error, w.error))


@method("length")
def length(env, target):
    v = C.compile_expr(target, env)
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return Val(F.size(v.col).cast("long"), LONG, either(v.error, F.when(v.col.isNull(), F.lit("expected array value, got null"))))
    if isinstance(v.type, T.StructType):
        return lit(len(v.type.names))
    if isinstance(v.type, T.BinaryType):
        return Val(F.octet_length(v.col).cast("long"), LONG, v.error)
    s = text(v)
    return Val(F.octet_length(s.col).cast("long"), LONG, s.error)


@method("slice")
def slice_(env, target, low, high=None):
    v, a = C.compile_expr(target, env), number(C.compile_expr(low, env))
    z = None if high is None else number(C.compile_expr(high, env))
    is_list = isinstance(v.type, T.ArrayType)
    if not is_list:
        if not is_text(v.type):
            raise NotCompilable("slice of a dynamic value")
        v = _binary(v)
    n = (F.size(v.col) if is_list else F.octet_length(v.col)).cast("long")
    at = lambda x: F.greatest(F.when(x < 0, x + n).otherwise(F.least(x, n)), F.lit(0).cast("long"))
    start, end = at(a.col.cast("long")), n if z is None else at(z.col.cast("long"))
    size = F.greatest(end - start, F.lit(0).cast("long"))
    error = either(v.error, a.error, z and z.error)
    if z is not None:
        error = either(error, F.when((z.col >= 0) & (z.col < start), F.lit("lower slice bound must be lower than upper")))
    if is_list:
        return Val(F.slice(v.col, (start + 1).cast("int"), size.cast("int")), v.type, error)
    part = F.substring(v.col, (start + 1).cast("int"), size.cast("int"))
    return Val(F.decode(part, "UTF-8"), STRING, error)


# numbers


def _number_method(name: str, f, kind=None):
    def run(env, target, *args):
        vals = [number(C.compile_expr(n, env)) for n in (target, *args)]
        return Val(f(*[v.col for v in vals]), kind or vals[0].type, either(*[v.error for v in vals]))

    METHOD_COLUMNS[name] = run


_number_method("log", lambda x: F.when(x > 0, F.ln(F.when(x > 0, x.cast("double")))).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))), DOUBLE)
_number_method("log10", lambda x: F.when(x > 0, F.log10(F.when(x > 0, x.cast("double")))).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))), DOUBLE)
_number_method("pow", lambda x, y: F.pow(x.cast("double"), y.cast("double")), DOUBLE)
_number_method("sin", F.sin, DOUBLE)
_number_method("cos", F.cos, DOUBLE)
_number_method("tan", F.tan, DOUBLE)
_number_method("bitwise_and", lambda x, y: x.cast("long").bitwiseAND(y.cast("long")), LONG)
_number_method("bitwise_or", lambda x, y: x.cast("long").bitwiseOR(y.cast("long")), LONG)
_number_method("bitwise_xor", lambda x, y: x.cast("long").bitwiseXOR(y.cast("long")), LONG)


def _rounding(name: str, f):
    def run(env, target):
        v = number(C.compile_expr(target, env))
        return v if is_int(v.type) else Val(f(v.col).cast("long"), LONG, v.error)

    METHOD_COLUMNS[name] = run


_rounding("ceil", F.ceil)
_rounding("floor", F.floor)
_rounding("round", lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


@method("abs")
def abs_(env, target):
    v = number(C.compile_expr(target, env))
    low = -(1 << 63)
    return Val(F.when(v.col == low, F.lit((1 << 63) - 1)).otherwise(F.abs(F.when(v.col != low, v.col))), LONG, v.error) if is_int(v.type) else Val(F.abs(v.col), DOUBLE, v.error)


@method("number")
def number_(env, target, default=None):
    v = C.compile_expr(target, env).plain("number")
    if isinstance(v.type, T.StringType):
        parsed = F.trim(v.col).try_cast("double")
        out = Val(parsed, DOUBLE, either(v.error, F.when(parsed.isNull(), F.lit("could not parse text as a number"))))
    elif v.type == VARIANT:
        parsed = F.try_variant_get(v.col, "$", "double")
        out = Val(parsed, DOUBLE, either(v.error, F.when(parsed.isNull(), F.lit("could not parse value as a number"))))
    else:
        out = number(v)
        out = replace(out, col=out.col.cast("double"), type=DOUBLE) if not is_int(out.type) else out
    return out if default is None else C.caught(out, C.compile_expr(default, env))


@method("float64", "float32")
def float64(env, target):
    v = number_(env, target)
    return replace(v, col=v.col.cast("double"), type=DOUBLE)


def _whole(name: str, low: int, high: int, kind: str):
    def run(env, target):
        v = C.compile_expr(target, env).plain(name)
        if not is_num(v.type):
            raise NotCompilable("text as a whole number")
        n = number(v)
        if is_int(n.type):  # bounds past those of a long hold anyway
            ok = F.lit(True) if low < -(1 << 62) else n.col >= low
            ok = ok if high > 1 << 62 else ok & (n.col <= high)
        else:
            ok = (n.col == F.floor(n.col)) & (n.col >= float(low)) & (n.col < float(high) + 1)
        col = F.when(ok, n.col).cast(kind)
        return Val(col, T._parse_datatype_string(kind), either(n.error, F.when(~ok, F.lit("value is no whole number in range"))))

    METHOD_COLUMNS[name] = run


for _bits, _signed, _wider in ((8, "tinyint", "smallint"), (16, "smallint", "int"), (32, "int", "bigint"), (64, "bigint", "decimal(20,0)")):
    _whole(f"int{_bits}", -(1 << (_bits - 1)), (1 << (_bits - 1)) - 1, _signed)
    _whole(f"uint{_bits}", 0, (1 << _bits) - 1, _wider)


@method("bool")
def bool_(env, target, default=None):
    v = C.compile_expr(target, env).plain("bool")
    if isinstance(v.type, T.StringType):
        col = F.when(v.col.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(True)).when(v.col.isin("0", "f", "F", "FALSE", "false", "False"), F.lit(False))
        out = Val(col, BOOL, either(v.error, F.when(col.isNull(), F.lit("expected bool value, got string"))))
    else:
        out = C.boolean(v)
    return out if default is None else C.caught(out, C.compile_expr(default, env))


# control


@method("catch")
def catch(env, target, fallback):
    v = C.compile_expr(target, env)
    why = Val(v.error if v.error is not None else F.lit(""), STRING)
    return C.caught(v, C.bound(fallback, why, env) if isinstance(fallback, P.Lambda) else C.compile_expr(fallback, replace(env, this=why) if _reads_this(fallback) else env))


def _reads_this(node) -> bool:
    if isinstance(node, P.Path):
        return node.base == "this"
    return any(_reads_this(x) for f in getattr(node, "__dataclass_fields__", ()) for x in _flat(getattr(node, f)))


def _flat(x):
    return [z for y in x for z in _flat(y)] if isinstance(x, tuple) else [x]


@method("or")
def or_(env, target, fallback):
    return C.coalesced(C.compile_expr(target, env), C.compile_expr(fallback, env))


@method("not")
def not_(env, target):
    v = C.compile_expr(target, env)
    out = C.boolean(v) if isinstance(v.type, T.BooleanType) or v.type == VARIANT else C.failing(f"expected bool value, got {kind_of(v.type)}", BOOL)
    return replace(out, col=~out.col)


@method("not_null")
def not_null(env, target):
    v = C.compile_expr(target, env)
    return replace(v, error=either(v.error, F.when(v.col.isNull(), F.lit("value is null"))))


@method("not_empty")
def not_empty(env, target):
    v = C.compile_expr(target, env)
    if isinstance(v.type, T.StructType):
        return v
    size = F.size(v.col) if isinstance(v.type, (T.ArrayType, T.MapType)) else F.length(text(v).col)
    return replace(v, error=either(v.error, F.when(size == 0, F.lit(f"{kind_of(v.type)} value is empty"))))


@method("map")
def map_(env, target, query):
    return C.bound(query, C.compile_expr(target, env), env)


@method("apply")
def apply(env, target, mapping):
    return C.run_named(constant(mapping, env, "mapping"), C.compile_expr(target, env), env)


@method("get")
def get(env, target, path):
    from millrace.lang.values import segments_of

    return C.read(C.compile_expr(target, env), tuple(segments_of(constant(path, env, "path"))))


@method("exists")
def exists(env, target, path):
    from millrace.lang.values import segments_of

    v, at = C.compile_expr(target, env), segments_of(constant(path, env, "path"))
    if isinstance(v.type, T.MapType) and len(at) == 1:
        return Val(F.map_contains_key(v.col, F.lit(at[0])), BOOL, v.error)
    if v.type == VARIANT:
        return Val(C.read(v, tuple(at)).col.isNotNull(), BOOL, v.error)
    for s in at:
        if not isinstance(v.type, T.StructType) or s not in v.type.names:
            return Val(F.lit(False), BOOL, v.error)
        v = C.read(v, (s,))
    return Val(F.lit(True), BOOL, v.error)


@method("type")
def type_(env, target):
    v = C.compile_expr(target, env)
    if v.type != VARIANT:
        known = F.lit(kind_of(v.type))
        return Val(known if isinstance(v.type, T.NullType) else F.when(v.col.isNull(), F.lit("null")).otherwise(known), STRING, v.error)
    s = F.schema_of_variant(v.col)
    col = F.when(v.col.isNull() | (s == "VOID"), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(F.startswith(s, F.lit("ARRAY")), "array").when(F.startswith(s, F.lit("OBJECT")), "object").otherwise("number")
    return Val(col, STRING, v.error)


@method("from")
def from_(env, target, index):
    """Another message's value: a literal index, or batch_index() plus or minus one, which wraps around the batch."""
    v = C.compile_expr(target, env)
    if isinstance(index, P.Bin) and index.op in "+-" and isinstance(index.left, P.Call) and index.left.name == "batch_index" and isinstance(index.right, P.Lit):
        k = index.right.value * (1 if index.op == "+" else -1)
        w = env.window(True)
        rank, size = F.row_number().over(w) - 1, F.count(F.lit(1)).over(env.window(False))
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        near = F.lead(v.col, k).over(w) if k >= 0 else F.lag(v.col, -k).over(w)
        wrapped = F.last(v.col).over(whole)
        if k < -1:
            raise NotCompilable("wrapping by more than one")
        col = near if k >= 0 else F.when(rank + k < 0, wrapped).otherwise(near)
        error = F.when(rank + k >= size, F.lit("message index out of bounds")) if k > 0 else None
        return Val(col, v.type, error)
    k = constant(index, env, "index")
    whole = env.window(True).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if k >= 0:
        col = F.nth_value(v.col, k + 1).over(whole)
    else:
        col = F.get(F.collect_list(F.struct(v.col.alias("x"))).over(whole), F.count(F.lit(1)).over(env.window(False)).cast("int") + k)["x"]
    return Val(col, v.type)


@method("from_all")
def from_all(env, target):
    v = C.compile_expr(target, env)
    whole = env.window(True).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = F.collect_list(F.struct(v.col.alias("x"))).over(whole)
    return Val(F.transform(rows, lambda r: r["x"]), T.ArrayType(v.type))


# arrays and objects


def array(env: Env, node) -> Val:
    v = C.compile_expr(node, env).plain("an array")
    if not isinstance(v.type, T.ArrayType):
        if v.type == VARIANT:
            col = F.try_variant_get(v.col, "$", "array<variant>")
            return Val(col, T.ArrayType(VARIANT), either(v.error, F.when(col.isNull(), F.lit("expected array value"))))
        raise NotCompilable(f"expected array value, got {kind_of(v.type)}")
    return replace(v, error=either(v.error, F.when(v.col.isNull(), F.lit("expected array value, got null"))))


def elementwise(env: Env, a: Val, query, use, kind=None) -> tuple[Val, Val]:
    """Compile a query once on a sample element, to know its type and flags; returns (sample, ignored)."""
    seen: dict = {}

    def once(x):
        seen["v"] = C.bound(query, Val(x, a.type.elementType), env, inner=True)
        return seen["v"].col

    F.transform(a.col, once)
    return seen["v"], a


def _errors(env: Env, a: Val, query, sample: Val) -> Column | None:
    if sample.error is None:
        return a.error
    each = F.transform(a.col, lambda x: C.bound(query, Val(x, a.type.elementType), env, inner=True).error)
    return either(a.error, F.get(F.array_compact(each), F.lit(0)))


@method("map_each")
def map_each(env, target, query):
    v = C.compile_expr(target, env)
    if isinstance(v.type, T.MapType):
        kind = v.type
        entry = lambda k, x: C.obj({"key": Val(k, kind.keyType), "value": Val(x, kind.valueType)})
        seen: dict = {}

        def each(k, x):
            seen["v"] = C.bound(query, entry(k, x), env, inner=True).plain("a mapped value")
            return seen["v"].col

        col = F.transform_values(v.col, each)
        if seen["v"].error is not None:
            raise NotCompilable("failures inside an object")
        return Val(col, T.MapType(kind.keyType, seen["v"].type), v.error)
    a = array(env, target)
    sample, _ = elementwise(env, a, query, None)
    run = lambda x: C.bound(query, Val(x, a.type.elementType), env, inner=True)
    error = _errors(env, a, query, sample)
    kind = sample.type
    col = a.col
    if sample.deleted is not None:
        col = F.filter(col, lambda x: ~F.coalesce(run(x).deleted, F.lit(False)))
    if isinstance(kind, T.NullType) and sample.nothing is not None:
        return Val(col, a.type, error)
    if sample.nothing is not None:
        kind = C.unify([replace(sample, nothing=None, deleted=None), Val(F.lit(None), a.type.elementType)])
        col = F.transform(col, lambda x: F.when(run(x).nothing, C._to(Val(x, a.type.elementType), kind)).otherwise(C._to(run(x), kind)))
    else:
        col = F.transform(col, lambda x: run(x).col)
    return Val(col, T.ArrayType(kind), error)


@method("map_each_key")
def map_each_key(env, target, query):
    v = C.compile_expr(target, env)
    if not isinstance(v.type, T.MapType):
        raise NotCompilable("keys of a struct")
    return Val(F.transform_keys(v.col, lambda k, _: text(C.bound(query, Val(k, STRING), env, inner=True)).col), v.type, v.error)


def _flag(env: Env, a: Val, query):
    return lambda x: F.coalesce(C.truth(C.bound(query, Val(x, a.type.elementType), env, inner=True)).col, F.lit(False))


@method("filter")
def filter_(env, target, test):
    v = C.compile_expr(target, env)
    if isinstance(v.type, T.MapType):
        entry = lambda k, x: C.obj({"key": Val(k, v.type.keyType), "value": Val(x, v.type.valueType)})
        return Val(F.map_filter(v.col, lambda k, x: C.truth(C.bound(test, entry(k, x), env, inner=True)).col), v.type, v.error)
    a = array(env, target)
    sample, _ = elementwise(env, a, test, None)
    return Val(F.filter(a.col, _flag(env, a, test)), a.type, _errors(env, a, test, sample))


@method("all")
def all_(env, target, test):
    a = array(env, target)
    sample, _ = elementwise(env, a, test, None)
    return Val((F.size(a.col) > 0) & F.forall(a.col, _flag(env, a, test)), BOOL, _errors(env, a, test, sample))


@method("any")
def any_(env, target, test):
    a = array(env, target)
    sample, _ = elementwise(env, a, test, None)
    return Val(F.exists(a.col, _flag(env, a, test)), BOOL, _errors(env, a, test, sample))


def _indexed(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("value")))


@method("enumerated")
def enumerated(env, target):
    a = array(env, target)
    return Val(_indexed(a.col), T.ArrayType(T.StructType([T.StructField("index", LONG), T.StructField("value", a.type.elementType)])), a.error)


def _found(env: Env, target, test, by_value: bool) -> tuple[Val, Column]:
    a = array(env, target)
    if by_value:
        x = C.compile_expr(test, env)
        hit = lambda e: C.equals(Val(e["value"], a.type.elementType), x).col
    else:
        hit = lambda e: _flag(env, a, test)(e["value"])
    return a, F.transform(F.filter(_indexed(a.col), hit), lambda e: e["index"])


@method("find")
def find(env, target, value):
    a, places = _found(env, target, value, True)
    return Val(F.coalesce(F.get(places, F.lit(0)), F.lit(-1).cast("long")), LONG, a.error)


@method("find_all")
def find_all(env, target, value):
    a, places = _found(env, target, value, True)
    return Val(places, T.ArrayType(LONG), a.error)


@method("find_by")
def find_by(env, target, query):
    a, places = _found(env, target, query, False)
    return Val(F.coalesce(F.get(places, F.lit(0)), F.lit(-1).cast("long")), LONG, a.error)


@method("find_all_by")
def find_all_by(env, target, query):
    a, places = _found(env, target, query, False)
    return Val(places, T.ArrayType(LONG), a.error)


@method("flatten")
def flatten(env, target):
    a = array(env, target)
    return Val(F.flatten(a.col), a.type.elementType, a.error) if isinstance(a.type.elementType, T.ArrayType) else a


@method("fold")
def fold(env, target, initial, query):
    a, start = array(env, target), C.compile_expr(initial, env)
    kind = start.type
    step = lambda tally, x: C.bound(query, C.obj({"tally": Val(tally, kind), "value": Val(x, a.type.elementType)}), env, inner=True)
    seen: dict = {}

    def probe(tally, x):
        seen["v"] = step(tally, x).plain("a fold")
        return C._to(seen["v"], kind) if seen["v"].type != kind and not (is_int(kind) and not is_int(seen["v"].type)) else seen["v"].col.cast(kind)

    F.aggregate(a.col, start.col, probe)
    if is_num(kind) and is_num(seen["v"].type) and is_int(kind) and not is_int(seen["v"].type):
        kind = DOUBLE
    col = F.aggregate(a.col, start.col.cast(kind), lambda t, x: step(t, x).col.cast(kind))
    error = either(a.error, start.error)
    if seen["v"].error is not None:
        error = either(error, F.when(col.isNull() & (F.size(a.col) > 0), F.lit("fold failed")))
    return Val(col, kind, error)


@method("index")
def index(env, target, index):
    a, i = array(env, target), number(C.compile_expr(index, env))
    at = i.col.cast("int")
    n = F.size(a.col)
    inside = (at < n) & (at >= -n)
    return Val(F.get(a.col, F.when(at < 0, at + n).otherwise(at)), a.type.elementType, either(a.error, i.error, F.when(~inside, F.lit("index was out of bounds for array"))))


@method("append")
def append(env, target, *values):
    a, items = array(env, target), [C.compile_expr(v, env).plain("an element") for v in values]
    kind = C.unify([Val(F.lit(None), a.type.elementType), *items])
    return Val(F.concat(_as(a, kind), F.array(*[C._to(v, kind) for v in items])), T.ArrayType(kind), either(a.error, *[v.error for v in items]))


def _as(a: Val, kind: T.DataType) -> Column:
    return a.col if a.type.elementType == kind else F.transform(a.col, lambda x: C._to(Val(x, a.type.elementType), kind))


@method("concat")
def concat(env, target, *arrays):
    all_arrays = [array(env, n) for n in (target, *arrays)]
    kind = C.unify([Val(F.lit(None), a.type.elementType) for a in all_arrays])
    return Val(F.concat(*[_as(a, kind) for a in all_arrays]), T.ArrayType(kind), either(*[a.error for a in all_arrays]))


@method("zip")
def zip_(env, target, *arrays):
    all_arrays = [array(env, n) for n in (target, *arrays)]
    kind = C.unify([Val(F.lit(None), a.type.elementType) for a in all_arrays])
    uneven = F.greatest(*[F.size(a.col) for a in all_arrays]) != F.least(*[F.size(a.col) for a in all_arrays])
    zipped = F.transform(F.arrays_zip(*[_as(a, kind).alias(f"c{i}") for i, a in enumerate(all_arrays)]), lambda r: F.array(*[r[f"c{i}"] for i in range(len(all_arrays))]))
    return Val(zipped, T.ArrayType(T.ArrayType(kind)), either(*[a.error for a in all_arrays], F.when(uneven, F.lit("can't zip arrays of different lengths"))))


@method("array")
def array_(env, target):
    v = C.compile_expr(target, env)
    return v if isinstance(v.type, T.ArrayType) else Val(F.array(v.col), T.ArrayType(v.type), v.error)


@method("keys")
def keys(env, target):
    v = C.compile_expr(target, env)
    if isinstance(v.type, T.StructType):
        return Val(F.array(*map(F.lit, sorted(v.type.names))), T.ArrayType(STRING), v.error)
    if not isinstance(v.type, T.MapType):
        raise NotCompilable("keys of a dynamic value")
    return Val(F.sort_array(F.map_keys(v.col)), T.ArrayType(STRING), v.error)


def _map(env: Env, node) -> Val:
    v = C.compile_expr(node, env)
    if isinstance(v.type, T.StructType):
        parts = [C.read(v, (n,)) for n in sorted(v.type.names)]
        kind = C.unify(parts)
        col = F.create_map(*[x for n, p in zip(sorted(v.type.names), parts) for x in (F.lit(n), C._to(p, kind))])
        return Val(col, T.MapType(STRING, kind), v.error)
    if not isinstance(v.type, T.MapType):
        raise NotCompilable("a dynamic object")
    return v


def _entries(m: Val) -> Column:
    return F.array_sort(F.map_entries(m.col), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


@method("key_values")
def key_values(env, target):
    m = _map(env, target)
    return Val(_entries(m), T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", m.type.valueType)])), m.error)


@method("values")
def values(env, target):
    m = _map(env, target)
    return Val(F.transform(_entries(m), lambda e: e["value"]), T.ArrayType(m.type.valueType), m.error)


def _static(v: Val) -> dict[str, Val]:
    if not isinstance(v.type, T.StructType):
        raise NotCompilable("an object of unknown fields")
    return dict(v.fields) if v.fields is not None else {n: C.read(v, (n,)) for n in v.type.names}


def _merged(a: Val, b: Val, keep_both: bool) -> Val:
    x, y = _static(a), _static(b)
    out = dict(x)
    for k, v in y.items():
        if k not in x:
            out[k] = v
        elif isinstance(x[k].type, T.StructType) and isinstance(v.type, T.StructType):
            out[k] = _merged(x[k], v, keep_both)
        elif not keep_both:
            out[k] = v
        else:
            one, two = (w if isinstance(w.type, T.ArrayType) else Val(F.array(w.col), T.ArrayType(w.type), w.error) for w in (x[k], v))
            kind = C.unify([Val(F.lit(None), one.type.elementType), Val(F.lit(None), two.type.elementType)])
            out[k] = Val(F.concat(_as(one, kind), _as(two, kind)), T.ArrayType(kind), either(one.error, two.error))
    return C.obj(out)


@method("merge")
def merge(env, target, with_):
    a, b = C.compile_expr(target, env), C.compile_expr(with_, env)
    if isinstance(a.type, T.ArrayType):
        return concat(env, target, with_) if isinstance(b.type, T.ArrayType) else append(env, target, with_)
    return _merged(a, b, True)


@method("assign")
def assign(env, target, with_):
    a, b = C.compile_expr(target, env), C.compile_expr(with_, env)
    if isinstance(a.type, T.ArrayType):
        return concat(env, target, with_) if isinstance(b.type, T.ArrayType) else append(env, target, with_)
    return _merged(a, b, False)


def _without(v: Val, paths: list[list[str]]) -> Val:
    out = _static(v)
    for p in paths:
        if len(p) == 1:
            out.pop(p[0], None)
        elif p[0] in out:
            out[p[0]] = _without(out[p[0]], [p[1:]])
    return C.obj(out)


@method("without")
def without(env, target, *paths):
    from millrace.lang.values import segments_of

    v = C.compile_expr(target, env)
    at = [segments_of(constant(p, env, "path")) for p in paths]
    if isinstance(v.type, T.MapType) and all(len(p) == 1 for p in at):
        return Val(F.map_filter(v.col, lambda k, _: ~k.isin(*[p[0] for p in at])), v.type, v.error)
    return _without(v, at)


@method("with")
def with_(env, target, *paths):
    from millrace.lang.values import segments_of

    v = C.compile_expr(target, env)
    at = [segments_of(constant(p, env, "path")) for p in paths]
    if isinstance(v.type, T.MapType) and all(len(p) == 1 for p in at):
        return Val(F.map_filter(v.col, lambda k, _: k.isin(*[p[0] for p in at])), v.type, v.error)

    def keep(x: Val, ps: list[list[str]]) -> Val:
        out: dict[str, Val] = {}
        for name, f in _static(x).items():
            own = [p[1:] for p in ps if p[0] == name]
            if own:
                out[name] = f if [] in own else keep(f, own)
        return C.obj(out)

    return keep(v, at)


@method("explode")
def explode(env, target, path):
    """One copy of the object for each element of the array at a path."""
    from millrace.lang.values import segments_of

    v, at = C.compile_expr(target, env), tuple(segments_of(constant(path, env, "path")))
    inner = C.read(v, at)
    if not isinstance(inner.type, T.ArrayType):
        raise NotCompilable("explode of an object")
    made: dict = {}

    def one(x):
        made["v"] = C._write(v, at, Val(x, inner.type.elementType))
        return made["v"].col

    col = F.transform(inner.col, one)
    return Val(col, T.ArrayType(made["v"].type), either(v.error, inner.error))


def _bare(a: Val) -> Val:
    """Elements that sort: numbers or text, none null."""
    kind = a.type.elementType
    if not is_num(kind) and not is_text(kind):
        raise NotCompilable("an order of such elements")
    return replace(a, error=either(a.error, F.when(F.exists(a.col, lambda x: x.isNull()), F.lit("sort element: expected number or string value, got null"))))


@method("sort")
def sort(env, target, compare=None):
    a = array(env, target)
    if compare is None:
        a = _bare(a)
        return Val(F.sort_array(a.col), a.type, a.error)
    less = lambda x, y: C.truth(C.bound(compare, C.obj({"left": Val(x, a.type.elementType), "right": Val(y, a.type.elementType)}), env, inner=True)).col
    return Val(F.array_sort(a.col, lambda x, y: F.when(less(x, y), -1).when(less(y, x), 1).otherwise(0)), a.type, a.error)


@method("sort_by")
def sort_by(env, target, query):
    a = array(env, target)
    key = lambda x: C.bound(query, Val(x, a.type.elementType), env, inner=True).col
    sample, _ = elementwise(env, a, query, None)
    if not is_num(sample.type) and not is_text(sample.type):
        raise NotCompilable("an order of such elements")
    return Val(F.array_sort(a.col, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)), a.type, _errors(env, a, query, sample))


@method("sum")
def sum_(env, target):
    v = C.compile_expr(target, env)
    if is_num(v.type):
        return number(v)
    a = array(env, target)
    if a.type.elementType == VARIANT:
        a = Val(F.transform(a.col, lambda x: F.try_variant_get(x, "$", "double")), T.ArrayType(DOUBLE), a.error)
    if not is_num(a.type.elementType):
        raise NotCompilable("a sum of such elements")
    bad = F.when(F.exists(a.col, lambda x: x.isNull()), F.lit("expected number value, got null"))
    return Val(F.aggregate(a.col, F.lit(0.0), lambda t, x: t + x.cast("double")), DOUBLE, either(a.error, bad))


def _extreme(name: str, f):
    def run(env, target):
        a = array(env, target)
        if not is_num(a.type.elementType):
            raise NotCompilable("an extreme of such elements")
        bad = F.when(F.size(a.col) == 0, F.lit("the array was empty")).when(F.exists(a.col, lambda x: x.isNull()), F.lit("expected number value in array, got null"))
        return Val(f(a.col), a.type.elementType, either(a.error, bad))

    METHOD_COLUMNS[name] = run


_extreme("max", F.array_max)
_extreme("min", F.array_min)


@method("unique")
def unique(env, target, emit=None):
    a = array(env, target)
    if emit is None:
        a = _bare(a)
        return Val(F.array_distinct(a.col), a.type, a.error)
    key = lambda x: C.bound(emit, Val(x, a.type.elementType), env, inner=True).col
    places = _indexed(a.col)
    first = lambda e: ~F.exists(F.slice(a.col, F.lit(1), e["index"].cast("int")), lambda y: key(y).eqNullSafe(key(e["value"])))
    return Val(F.transform(F.filter(places, first), lambda e: e["value"]), a.type, a.error)


# time


@method("timestamp")
def timestamp(env, target, default=None):
    v = C.stamp(C.compile_expr(target, env))
    return v if default is None else C.caught(v, C.compile_expr(default, env))


def _unix(name: str, f):
    def run(env, target):
        v = C.stamp(C.compile_expr(target, env))
        return Val(f(F.unix_micros(v.col)), LONG, v.error)

    METHOD_COLUMNS.update({name: run, f"format_{name.replace('ts_', 'timestamp_', 1)}": run})


_unix("ts_unix", lambda m: F.floor(m / F.lit(1_000_000)).cast("long"))
_unix("ts_unix_milli", lambda m: F.floor(m / F.lit(1000)).cast("long"))
_unix("ts_unix_micro", lambda m: m)
_unix("ts_unix_nano", lambda m: m * 1000)


@method("ts_sub")
def ts_sub(env, target, t2):
    a, b = C.stamp(C.compile_expr(target, env)), C.stamp(C.compile_expr(t2, env))
    return Val((F.unix_micros(a.col) - F.unix_micros(b.col)) * 1000, LONG, either(a.error, b.error))


@method("ts_round")
def ts_round(env, target, duration):
    from millrace.functions.times import YEAR_ONE

    t = C.stamp(C.compile_expr(target, env))
    if isinstance(duration, P.Method) and duration.name == "parse_duration" and isinstance(duration.target, P.Lit):
        from millrace.functions.times import duration_nanos

        step = duration_nanos(duration.target.value)
    else:
        step = constant(duration, env, "duration")
    if step <= 0 or step % 1000:
        raise NotCompilable("rounding below a microsecond")
    step //= 1000
    since = F.unix_micros(t.col) + F.lit(YEAR_ONE)
    rest = since % step
    rounded = since - rest + F.when(rest * 2 >= step, F.lit(step)).otherwise(F.lit(0))
    return Val(F.timestamp_micros(rounded - F.lit(YEAR_ONE)), STAMP, t.error)


@method("ts_tz")
def ts_tz(env, target, tz):
    """An instant stays; a zone only shows when it is formatted."""
    constant(tz, env, "tz")
    return C.stamp(C.compile_expr(target, env))


def _shift(sign: int):
    def run(env, target, duration):
        from millrace.functions.times import iso_period

        t = C.stamp(C.compile_expr(target, env))
        years, months, weeks, days, hours, minutes, seconds = (sign * x for x in iso_period(constant(duration, env, "duration")))
        whole = int(years * 12 + months)
        first = F.date_trunc("month", t.col)
        moved = t.col if not whole else F.timestamp_micros(F.unix_micros(F.add_months(first, whole).cast("timestamp")) + F.unix_micros(t.col) - F.unix_micros(first))
        micros = round((((weeks * 7 + days) * 24 + hours) * 3600 + minutes * 60 + seconds) * 1e6)
        return Val(F.timestamp_micros(F.unix_micros(moved) + F.lit(micros)), STAMP, t.error)

    return run


METHOD_COLUMNS["ts_add_iso8601"] = _shift(1)
METHOD_COLUMNS["ts_sub_iso8601"] = _shift(-1)
#: Strftime directives and the Java patterns that print the same.
JAVA = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%-d": "d", "%-m": "M", "%-I": "h", "%p": "a", "%:zZ": "XXX", "%:z": "xxx", "%z": "xx", "%zZ": "XX"}


def _java(parts: list[tuple[str, str]], reading: bool) -> str:
    out = ""
    for what, x in parts:
        if what == "lit":
            out += f"'{x}'" if x.isalpha() else "''" if x == "'" else x
        elif what == "frac" and not reading and x[0] == "." and set(x[1:]) == {"0"} and len(x) <= 7:
            out += "." + "S" * (len(x) - 1)
        elif what == "dir" and x in JAVA and not (reading and x in ("%p", "%a", "%A", "%j")):
            out += JAVA[x]
        else:
            raise NotCompilable(f"time directive {x}")
    return out.replace("''", "") if "''" in out and "'" not in out.replace("''", "") else out


def _formatter(parts_of):
    def run(env, target, format=None, tz=None):
        if isinstance(target, C.P.Method) and target.name == "ts_tz":  # the zone of the instant shows here
            given = (*target.args, *(a for _, a in target.named))
            if len(given) != 1:
                raise NotCompilable("a zone")
            target, tz = target.target, given[0] if tz is None else tz
        if format is None:
            t = C.stamp(C.compile_expr(target, env))
            if tz is not None:
                raise NotCompilable("a zone")
            return Val(C.rfc3339(t.col), STRING, t.error)
        pattern = _java(parts_of(constant(format, env, "format")), False)
        t = C.stamp(C.compile_expr(target, env))
        name = None if tz is None else constant(tz, env, "tz")
        if name not in (None, "UTC", "") and any(c in pattern for c in "xXzZ"):
            raise NotCompilable("an offset in another zone")
        col = t.col if name in (None, "UTC", "") else F.from_utc_timestamp(t.col, name)
        return Val(F.date_format(col, pattern), STRING, t.error)

    return run


def _reader(parts_of):
    def run(env, target, format):
        pattern = _java(parts_of(constant(format, env, "format")), True)
        (s,) = texts(env, target)
        col = F.try_to_timestamp(s.col, F.lit(pattern))
        return Val(col, STAMP, either(s.error, F.when(col.isNull(), F.lit("parsing time failed"))))

    return run


def _register_times() -> None:
    from millrace.functions.times import layout_parts, strftime_parts

    METHOD_COLUMNS["ts_format"] = METHOD_COLUMNS["format_timestamp"] = _formatter(layout_parts)
    METHOD_COLUMNS["ts_strftime"] = METHOD_COLUMNS["format_timestamp_strftime"] = _formatter(strftime_parts)
    METHOD_COLUMNS["ts_parse"] = _reader(layout_parts)
    METHOD_COLUMNS["ts_strptime"] = _reader(strftime_parts)
    as_text = lambda f: lambda env, target, format: (lambda v: Val(C.rfc3339(v.col), STRING, v.error))(f(env, target, format))
    METHOD_COLUMNS["parse_timestamp"], METHOD_COLUMNS["parse_timestamp_strptime"] = as_text(METHOD_COLUMNS["ts_parse"]), as_text(METHOD_COLUMNS["ts_strptime"])


_register_times()


@method("parse_json")
def parse_json(env, target, use_number=None):
    (s,) = texts(env, target)
    col = F.try_parse_json(s.col)
    return Val(col, VARIANT, either(s.error, F.when(col.isNull(), F.lit("failed to parse value as JSON"))))


@method("format_json")
def format_json(env, target, indent=None, no_indent=None, escape_html=None):
    if no_indent is None or not constant(no_indent, env, "no_indent") or escape_html is None or constant(escape_html, env, "escape_html"):
        raise NotCompilable("indented or escaped JSON")
    v = C.compile_expr(target, env)
    return Val(F.encode(C.json_text(v), "UTF-8"), BINARY, v.error)


# functions


@function("batch_index")
def batch_index(env):
    return Val((F.row_number().over(env.window(True)) - 1).cast("long"), LONG)


@function("batch_size")
def batch_size(env):
    return Val(F.count(F.lit(1)).over(env.window(False)), LONG)


@function("count")
def count(env, name):
    """A named counter from 1 in the order of the rows. The counter spans all batches, so its window has no partition."""
    if env.inner or not env.order:
        raise NotCompilable("a counter needs an order")
    return Val(F.row_number().over(Window.orderBy(*env.order)).cast("long"), LONG)


@function("content")
def content(env):
    if env.content is not None:
        return Val(F.encode(env.content, "UTF-8"), BINARY)
    return Val(F.encode(C.json_text(env.doc), "UTF-8"), BINARY)


@function("json")
def json_(env, path=None):
    from millrace.lang.values import segments_of

    return env.doc if path is None else C.read(env.doc, tuple(segments_of(constant(path, env, "path"))))


def _meta(env: Env, source, key):
    if source is None:
        raise NotCompilable("no metadata column")
    return Val(source, T.MapType(STRING, STRING)) if key is None else Val(F.try_element_at(source, F.lit(constant(key, env, "key"))), STRING)


@function("metadata", "meta")
def metadata(env, key=None):
    return _meta(env, env.meta, key)


@function("root_meta")
def root_meta(env, key=None):
    return _meta(env, env.new_meta, key)


def _error_field(name: str, default=None):
    def run(env):
        if env.error is None:
            return lit(default)
        return Val(env.error.getField(name), STRING)

    return run


FUNCTION_COLUMNS["error"] = _error_field("message")
FUNCTION_COLUMNS["error_source_name"] = _error_field("name")
FUNCTION_COLUMNS["error_source_label"] = _error_field("label")
FUNCTION_COLUMNS["error_source_path"] = _error_field("path")


@function("errored")
def errored(env):
    return lit(False) if env.error is None else Val(env.error.isNotNull(), BOOL)


FUNCTION_COLUMNS["deleted"] = lambda env: C.deleted()
FUNCTION_COLUMNS["nothing"] = lambda env: C.nothing()
FUNCTION_COLUMNS["tracing_span"] = lambda env: lit(None)
FUNCTION_COLUMNS["tracing_id"] = lambda env: lit("")
FUNCTION_COLUMNS["pi"] = lambda env: lit(3.141592653589793)
FUNCTION_COLUMNS["hostname"] = lambda env: lit(socket.gethostname())
FUNCTION_COLUMNS["now"] = lambda env: Val(C.rfc3339(F.current_timestamp()), STRING)
FUNCTION_COLUMNS["timestamp_unix"] = lambda env: Val(F.unix_seconds(F.current_timestamp()), LONG)
FUNCTION_COLUMNS["timestamp_unix_milli"] = lambda env: Val(F.unix_millis(F.current_timestamp()), LONG)
FUNCTION_COLUMNS["timestamp_unix_micro"] = lambda env: Val(F.unix_micros(F.current_timestamp()), LONG)
FUNCTION_COLUMNS["timestamp_unix_nano"] = lambda env: Val(F.unix_micros(F.current_timestamp()) * 1000, LONG)
FUNCTION_COLUMNS["uuid_v4"] = lambda env: Val(F.expr("uuid()"), STRING)


@function("throw")
def throw(env, why):
    v = text(C.compile_expr(why, env))
    return Val(F.lit(None), C.NULL, either(v.error, v.col))


@function("var")
def var(env, name):
    return C._var(P.Var(constant(name, env, "name")), env)


@function("env")
def env_(env, name=None, no_cache=None):
    if name is None:
        raise NotCompilable("the whole environment")
    return lit(os.environ.get(constant(name, env, "name")))


@function("file", "file_rel")
def file(env, path, no_cache=None):
    with open(constant(path, env, "path"), "rb") as f:
        return lit(f.read())


@function("bytes")
def bytes_(env, length):
    n = number(C.compile_expr(length, env))
    return Val(F.encode(F.repeat(F.lit("\0"), n.col.cast("int")), "UTF-8"), BINARY, n.error)


@function("range")
def range_(env, start, stop, step=None):
    a, b = number(C.compile_expr(start, env)), number(C.compile_expr(stop, env))
    s = lit(1) if step is None else number(C.compile_expr(step, env))
    low, high, by = (v.col.cast("long") for v in (a, b, s))
    safe = F.when(by != 0, by).otherwise(F.lit(1).cast("long"))
    n = F.floor(F.abs(high - low) / F.abs(safe)).cast("long")
    wrong = F.when(by == 0, F.lit("step must not be 0")).when((high != low) & ((high > low) != (by > 0)), F.lit("step must point from start to stop"))
    seq = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), lambda i: low + i * safe)
    return Val(F.when(n > 0, seq).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG), either(a.error, b.error, s.error, wrong))


@function("random_int")
def random_int(env, seed=None, min=None, max=None):
    low = 0 if min is None else constant(min, env, "min")
    high = (1 << 53) if max is None else constant(max, env, "max")
    r = F.rand() if seed is None else F.rand(constant(seed, env, "seed"))
    return Val((F.floor(r * (high - low + 1)) + low).cast("long"), LONG)


@function("counter")
def counter(env, min=None, max=None, set=None):
    if set is not None:
        raise NotCompilable("a counter that is set")
    low = 1 if min is None else constant(min, env, "min")
    place = count(env, None).col - 1
    return Val((place if max is None else place % (constant(max, env, "max") - low + 1)) + low, LONG)
