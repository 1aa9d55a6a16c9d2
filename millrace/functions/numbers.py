"""Numbers: coercions and mathematics."""

from __future__ import annotations

import math

from millrace.functions.registry import function, method
from millrace.lang.values import MappingError, as_array, as_int, as_number, as_string, is_number, kind

_NONE = object()


def parse_number(text: str) -> float:
    try:
        if "_" in text:
            raise ValueError
        return float.fromhex(text) if text.lower().lstrip("+-").startswith("0x") and "p" in text.lower() else float(text)
    except ValueError:
        raise MappingError(f"could not parse {text!r} as a number") from None


@method("number")
def number(v, default=_NONE):
    try:
        if is_number(v):
            return as_number(v)
        if isinstance(v, (str, bytes)):
            return parse_number(as_string(v).strip())
        raise MappingError(f"expected number value, got {kind(v)}")
    except MappingError:
        if default is _NONE:
            raise
        return default


def _whole(v, low: int, high: int) -> int:
    if isinstance(v, (str, bytes)):
        text = as_string(v).strip()
        try:
            digits = text.lstrip("+-")
            n = int(text, 8) if len(digits) > 1 and digits[0] == "0" and digits[1].isdigit() else int(text, 0)
        except ValueError:
            raise MappingError(f"could not parse {text!r} as an integer") from None
    elif is_number(v):
        f = as_number(v)
        if isinstance(f, float) and (not math.isfinite(f) or f != int(f)):
            raise MappingError(f"value {f} is not a whole number")
        n = int(f)
    else:
        raise MappingError(f"expected number value, got {kind(v)}")
    if not low <= n <= high:
        raise MappingError(f"value {n} is out of range")
    return n


def _register_whole(name: str, low: int, high: int) -> None:
    method(name, about=f"whole number of {name.lstrip('uint')} bits")(lambda v: _whole(v, low, high))


for _bits in (8, 16, 32, 64):
    _register_whole(f"int{_bits}", -(1 << (_bits - 1)), (1 << (_bits - 1)) - 1)
    _register_whole(f"uint{_bits}", 0, (1 << _bits) - 1)


@method("float64")
def float64(v):
    return parse_number(as_string(v).strip()) if isinstance(v, (str, bytes)) else float(as_number(v))


@method("float32")
def float32(v):
    import struct

    try:
        return struct.unpack("f", struct.pack("f", float64(v)))[0]
    except OverflowError:
        raise MappingError(f"value {v} is out of range") from None


def _fitting(x: float):
    return int(x) if math.isfinite(x) and abs(x) < 2**63 else x


@method("ceil")
def ceil(v):
    n = as_number(v)
    return n if isinstance(n, int) else _fitting(math.ceil(n)) if math.isfinite(n) else n


@method("floor")
def floor(v):
    n = as_number(v)
    return n if isinstance(n, int) else _fitting(math.floor(n)) if math.isfinite(n) else n


@method("round")
def round_(v):
    n = as_number(v)
    return n if isinstance(n, int) or not math.isfinite(n) else _fitting(math.copysign(math.floor(abs(n) + 0.5), n))


@method("abs")
def abs_(v):
    n = abs(as_number(v))
    return min(n, (1 << 63) - 1) if isinstance(n, int) else n


def _real(f, v):
    try:
        return f(float(as_number(v)))
    except ValueError:
        n = float(as_number(v))
        return -math.inf if n == 0 else math.nan


@method("log")
def log(v):
    return _real(math.log, v)


@method("log10")
def log10(v):
    return _real(math.log10, v)


@method("pow")
def pow_(v, exponent):
    try:
        return math.pow(as_number(v), as_number(exponent))
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


@method("sin")
def sin(v):
    return math.sin(as_number(v))


@method("cos")
def cos(v):
    return math.cos(as_number(v))


@method("tan")
def tan(v):
    return math.tan(as_number(v))


def _numbers(v) -> list:
    items = as_array(v)
    if not items:
        raise MappingError("the array was empty")
    for x in items:
        if not is_number(x):
            raise MappingError(f"expected number value in array, got {kind(x)}")
    return [as_number(x) for x in items]


@method("max")
def max_(v):
    return max(_numbers(v))


@method("min")
def min_(v):
    return min(_numbers(v))


@method("bitwise_and")
def bitwise_and(v, value):
    return as_int(v) & as_int(value)


@method("bitwise_or")
def bitwise_or(v, value):
    return as_int(v) | as_int(value)


@method("bitwise_xor")
def bitwise_xor(v, value):
    return as_int(v) ^ as_int(value)


@function("pi")
def pi():
    return math.pi
