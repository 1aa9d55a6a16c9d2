"""Values of the mapping language, in Python: kinds, coercions, comparison, text.

str, bytes, int, float, Decimal (exact numbers), bool, datetime (with a zone), list, dict and None; and two marks
that are no data: DELETE removes what it is assigned to, NOTHING leaves it as it was.
"""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any


class MappingError(Exception):
    """A failed expression; the message it belongs to is flagged and flows on."""


class Mark:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self):
        return self.name

    def __reduce__(self):
        return (_mark, (self.name,))


_MARKS = {n: Mark(n) for n in ("deleted", "nothing")}


def _mark(name: str) -> Mark:
    return _MARKS[name]


DELETE, NOTHING = _MARKS["deleted"], _MARKS["nothing"]
UTC = timezone.utc


def kind(v: Any) -> str:
    if v is None:
        return "null"
    if v is DELETE:
        return "delete"
    if v is NOTHING:
        return "nothing"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float, Decimal)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (bytes, bytearray)):
        return "bytes"
    if isinstance(v, datetime):
        return "timestamp"
    if isinstance(v, list):
        return "array"
    if isinstance(v, dict):
        return "object"
    return "unknown"


def wrong(want: str, got: Any):
    raise MappingError(f"expected {want} value, got {kind(got)}")


def as_string(v: Any) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if isinstance(v, datetime):
        return rfc3339(v)
    wrong("string", v)


def as_bytes(v: Any) -> bytes:
    return bytes(v) if isinstance(v, (bytes, bytearray)) else as_string(v).encode()


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def as_number(v: Any) -> int | float:
    if not is_number(v):
        wrong("number", v)
    return float(v) if isinstance(v, Decimal) else v


def as_int(v: Any) -> int:
    if not is_number(v):
        wrong("integer", v)
    return int(v)


def as_bool(v: Any) -> bool:
    """Truth of a boolean or a number."""
    if isinstance(v, bool):
        return v
    if is_number(v):
        return v != 0
    wrong("bool", v)


def as_array(v: Any) -> list:
    if not isinstance(v, list):
        wrong("array", v)
    return v


def as_object(v: Any) -> dict:
    if not isinstance(v, dict):
        wrong("object", v)
    return v


def as_timestamp(v: Any) -> datetime:
    """Unix seconds (with a fraction) or RFC 3339 text."""
    if isinstance(v, datetime):
        return v if v.tzinfo else v.replace(tzinfo=UTC)
    if is_number(v):
        whole = math.floor(v)
        return datetime.fromtimestamp(whole, UTC) + timedelta(microseconds=round((float(v) - whole) * 1e6))
    if isinstance(v, (str, bytes)):
        return parse_rfc3339(as_string(v))
    wrong("timestamp", v)


def parse_rfc3339(text: str) -> datetime:
    try:
        cut = text.strip().replace("z", "Z")
        if "." in cut:  # nanoseconds are cut to microseconds
            head, tail = cut.split(".", 1)
            digits = ""
            while tail and tail[0].isdigit():
                digits, tail = digits + tail[0], tail[1:]
            cut = f"{head}.{digits[:6].ljust(6, '0')}{tail}"
        out = datetime.fromisoformat(cut.replace("Z", "+00:00"))
    except ValueError:
        raise MappingError(f"parsing time {text!r}: not RFC 3339") from None
    if out.tzinfo is None or len(text) < 11:
        raise MappingError(f"parsing time {text!r}: not RFC 3339")
    return out


def rfc3339(t: datetime) -> str:
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    fraction = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
    off = t.utcoffset() or timedelta(0)
    minutes = int(off.total_seconds() // 60)
    zone = "Z" if not minutes else f"{'+' if minutes > 0 else '-'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return t.strftime("%Y-%m-%dT%H:%M:%S") + fraction + zone


def number_text(v: int | float | Decimal, widest: int = 6) -> str:
    """Shortest decimal text; an exponent below -4 or from ``widest`` on is written out as one."""
    if isinstance(v, int):
        return str(v)
    if isinstance(v, Decimal):
        return format(v, "f") if v.is_finite() else str(v)
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == 0:
        return "-0" if math.copysign(1, v) < 0 else "0"
    sign, digits, exponent = Decimal(repr(v)).as_tuple()
    digits = list(digits)
    while len(digits) > 1 and digits[-1] == 0:
        digits.pop()
        exponent += 1
    point = len(digits) + exponent - 1
    if point < -4 or point >= widest:
        body = str(digits[0]) + ("." + "".join(map(str, digits[1:])) if len(digits) > 1 else "")
        return f"{'-' * sign}{body}e{'-' if point < 0 else '+'}{abs(point):02d}"
    return format(Decimal((sign, tuple(digits), exponent)), "f")


def json_number(v: int | float | Decimal) -> str:
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            raise MappingError(f"unsupported value {v}")
        if v == int(v) and abs(v) < 1e21:
            return str(int(v))
        text = repr(v)
        if "e" in text:
            head, tail = text.split("e")
            return format(Decimal(text), "f") if -7 < int(tail) < 21 else f"{head}e{'+' if int(tail) > 0 else '-'}{abs(int(tail))}"
        return text
    return number_text(v, 21)


def to_json(v: Any, indent: str | None = None, escape: bool = False, _at: str = "") -> str:
    """JSON text with sorted keys."""
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    if is_number(v):
        return json_number(v)
    if isinstance(v, (str, bytes, bytearray, datetime)):
        text = json.dumps(as_string(v), ensure_ascii=False)
        return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") if escape else text
    if isinstance(v, (list, dict)):
        inner = _at + (indent or "")
        parts = [f"{json.dumps(str(k), ensure_ascii=False)}:{' ' if indent else ''}{to_json(v[k], indent, escape, inner)}" for k in sorted(v)] if isinstance(v, dict) else [to_json(x, indent, escape, inner) for x in v]
        a, z = "{}" if isinstance(v, dict) else "[]"
        if not parts:
            return a + z
        return f"{a}\n{inner}" + f",\n{inner}".join(parts) + f"\n{_at}{z}" if indent else a + ",".join(parts) + z
    raise MappingError(f"a {kind(v)} value has no JSON form")


def from_json(text: str | bytes, exact: bool = False) -> Any:
    try:
        return json.loads(text, parse_float=Decimal if exact else float, parse_int=(lambda x: Decimal(x)) if exact else _json_int)
    except ValueError as e:
        raise MappingError(f"failed to parse value as JSON: {e}") from None


def _json_int(text: str) -> int | float:
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 64 else float(text)


def to_text(v: Any) -> str:
    """The canonical text of a value."""
    if isinstance(v, (str, bytes, bytearray, datetime)):
        return as_string(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if v is None:
        return "null"
    if is_number(v):
        return number_text(v)
    return to_json(v)


def equal(a: Any, b: Any) -> bool:
    """Equality across kinds; null equals null, and a boolean on the left takes a number on the right for a boolean."""
    if isinstance(a, bool):
        return (isinstance(b, bool) or is_number(b)) and a == as_bool(b)
    if a is None or b is None:
        return a is b
    if is_number(a):
        return is_number(b) and a == b
    if isinstance(a, (str, bytes, bytearray)):
        return isinstance(b, (str, bytes, bytearray, datetime)) and as_bytes(a) == as_bytes(b)
    if isinstance(a, datetime):
        return isinstance(b, (str, datetime)) and as_string(a) == as_string(b)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(equal(x, y) for x, y in zip(a, b))
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a is b


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1; kinds that have no order with one another are an error."""
    if isinstance(a, bool):
        x, y = a, as_bool(b)
    elif is_number(a) and is_number(b):
        x, y = a, b
    elif isinstance(a, datetime) or isinstance(b, datetime):
        x, y = as_timestamp(a), as_timestamp(b)
    elif isinstance(a, (str, bytes)) and isinstance(b, (str, bytes)):
        x, y = as_bytes(a), as_bytes(b)
    else:
        raise MappingError(f"cannot compare types {kind(a)} and {kind(b)}")
    return (x > y) - (x < y)


def segments_of(path: str) -> list[str]:
    """Segments of a dot path; ``~1`` is a dot and ``~0`` a tilde."""
    return [s.replace("~1", ".").replace("~0", "~") for s in path.split(".")] if path else []


def read_path(v: Any, segments, missing: Any = None) -> Any:
    for i, s in enumerate(segments):
        if isinstance(v, dict):
            if s not in v:
                return missing
            v = v[s]
        elif isinstance(v, list):
            if s == "*":
                return [read_path(x, segments[i + 1 :], missing) for x in v]
            if not s.lstrip("-").isdigit() or not -len(v) <= int(s) < len(v):
                return missing
            v = v[int(s)]
        else:
            return missing
    return v


def write_path(v: Any, segments, new: Any) -> Any:
    """The value with ``new`` at a path (DELETE removes it); objects on the way are made, the value itself is not changed."""
    if not segments:
        return new
    first, rest = segments[0], segments[1:]
    if isinstance(v, list):
        out = list(v)
        if first == "-":
            return out + [write_path({}, rest, new)]
        if not first.lstrip("-").isdigit() or not -len(out) <= int(first) < len(out):
            raise MappingError(f"unable to set index {first!r}")
        if not rest and new is DELETE:
            del out[int(first)]
        else:
            out[int(first)] = write_path(out[int(first)], rest, new)
        return out
    if v is None or v is NOTHING:
        v = {}
    if not isinstance(v, dict):
        raise MappingError(f"unable to set target path {'.'.join(segments)} as the value of its parent is a non-object type ({kind(v)})")
    out = dict(v)
    if not rest and new is DELETE:
        out.pop(first, None)
    elif rest and new is DELETE and first not in out:
        return out
    else:
        out[first] = write_path(out.get(first), rest, new)
    return out
