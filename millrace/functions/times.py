"""Timestamps and durations. Durations are whole nanoseconds; timestamps keep microseconds and a zone."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from millrace.functions.registry import function, method
from millrace.lang.values import UTC, MappingError, as_int, as_string, as_timestamp, rfc3339

_NONE = object()
#: The layout's reference date pieces, longest first, and the strftime directive of each.
LAYOUT = (
    ("January", "%B"), ("Monday", "%A"), ("2006", "%Y"), ("Z07:00", "%:zZ"), ("-07:00", "%:z"), ("Z0700", "%zZ"), ("-0700", "%z"),
    ("MST", "%Z"), ("Jan", "%b"), ("Mon", "%a"), ("002", "%j"), ("-07", "%hz"), ("01", "%m"), ("02", "%d"), ("03", "%I"), ("04", "%M"),
    ("05", "%S"), ("06", "%y"), ("15", "%H"), ("_2", "%e"), ("PM", "%p"), ("pm", "%P"), ("1", "%-m"), ("2", "%-d"), ("3", "%-I"), ("4", "%-M"), ("5", "%-S"),
)
RFC3339_NANO = "2006-01-02T15:04:05.999999999Z07:00"


def layout_parts(layout: str) -> list[tuple[str, str]]:
    """A layout as ('lit', text), ('dir', directive) and ('frac', digits with 0 or 9)."""
    out, at = [], 0
    while at < len(layout):
        if m := re.match(r"[.,](0+|9+)(?!\d)", layout[at:]):
            out.append(("frac", m[0]))
            at += m.end()
            continue
        for text, directive in LAYOUT:
            if layout.startswith(text, at) and not (text == "Jan" and layout.startswith("January", at)):
                out.append(("dir", directive))
                at += len(text)
                break
        else:
            out.append(("lit", layout[at]))
            at += 1
    return out


def strftime_parts(text: str) -> list[tuple[str, str]]:
    out = []
    for m in re.finditer(r"%(:z|-?[A-Za-z%])|([^%]+)|(%)", text):
        if m[1]:
            d = "%" + m[1]
            if d == "%%":
                out.append(("lit", "%"))
            elif d == "%f":
                out.append(("frac", "f000000"))
            elif d in ("%D", "%F", "%T", "%R", "%c", "%v", "%h", "%n", "%t", "%x", "%X", "%r"):
                wide = {"%D": "%m/%d/%y", "%F": "%Y-%m-%d", "%T": "%H:%M:%S", "%R": "%H:%M", "%c": "%v %X", "%v": "%e-%b-%Y", "%h": "%b", "%x": "%m/%d/%y", "%X": "%H:%M:%S", "%r": "%I:%M:%S %p"}
                out += [("lit", "\n")] if d == "%n" else [("lit", "\t")] if d == "%t" else strftime_parts(wide[d])
            else:
                out.append(("dir", d))
        else:
            out.append(("lit", m[2] or m[3]))
    return out


def zone(name: str):
    if name in ("UTC", ""):
        return UTC
    if name == "Local":
        return datetime.now().astimezone().tzinfo
    try:
        return ZoneInfo(name)
    except Exception:
        raise MappingError(f"unknown time zone {name}") from None


def _offset(t: datetime, colon: bool, hours: bool = False) -> str:
    minutes = int((t.utcoffset() or timedelta(0)).total_seconds() // 60)
    sign, minutes = "-" if minutes < 0 else "+", abs(minutes)
    return f"{sign}{minutes // 60:02d}" + ("" if hours else f"{':' if colon else ''}{minutes % 60:02d}")


def render(t: datetime, parts: list[tuple[str, str]]) -> str:
    out = []
    for what, text in parts:
        if what == "lit":
            out.append(text)
        elif what == "frac":
            digits = f"{t.microsecond:06d}000"[: len(text) - 1]
            if text[0] == "f":
                out.append(digits)
            elif text[1] == "9":
                digits = digits.rstrip("0")
                out.append(text[0] + digits if digits else "")
            else:
                out.append(text[0] + digits)
        elif text in ("%:z", "%:zZ", "%zZ", "%hz", "%z"):
            out.append("Z" if text.endswith("Z") and not t.utcoffset() else _offset(t, ":" in text, "h" in text))
        elif text == "%Z":
            out.append(t.tzname() or "UTC")
        elif text == "%e":
            out.append(f"{t.day:2d}")
        elif text == "%P":
            out.append(t.strftime("%p").lower())
        else:
            out.append(t.strftime(text))
    return "".join(out)


_READ = {
    "%Y": r"(?P<Y>\d{4})", "%y": r"(?P<y>\d{2})", "%m": r"(?P<m>\d{2})", "%-m": r"(?P<m>\d{1,2})", "%d": r"(?P<d>\d{1,2})", "%-d": r"(?P<d>\d{1,2})", "%e": r" ?(?P<d>\d{1,2})",
    "%H": r"(?P<H>\d{1,2})", "%I": r"(?P<I>\d{2})", "%-I": r"(?P<I>\d{1,2})", "%M": r"(?P<M>\d{2})", "%-M": r"(?P<M>\d{1,2})", "%S": r"(?P<S>\d{2})", "%-S": r"(?P<S>\d{1,2})",
    "%b": r"(?P<b>[A-Za-z]{3})", "%B": r"(?P<b>[A-Za-z]+)", "%a": r"[A-Za-z]{3}", "%A": r"[A-Za-z]+", "%p": r"(?P<p>[AaPp][Mm])", "%P": r"(?P<p>[AaPp][Mm])", "%j": r"(?P<j>\d{3})",
    "%z": r"(?P<z>Z|[+-]\d{2}:?\d{2})", "%zZ": r"(?P<z>Z|[+-]\d{4})", "%:z": r"(?P<z>[+-]\d{2}:\d{2})", "%:zZ": r"(?P<z>Z|[+-]\d{2}:\d{2})", "%hz": r"(?P<z>[+-]\d{2})", "%Z": r"(?P<Z>[A-Za-z/_+-]+\d*)", "%s": r"(?P<s>\d+)",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def read_time(text: str, parts: list[tuple[str, str]], shown: str) -> datetime:
    pattern, seconds = "", False
    for what, x in parts:
        if what == "lit":
            pattern += re.escape(x)
        elif what == "frac":
            pattern += r"(?P<f>\d{1,9})" if x[0] == "f" else r"(?:[.,](?P<f>\d{1,9}))?"
            seconds = False
        else:
            if x not in _READ:
                raise MappingError(f"directive {x} cannot be parsed")
            pattern += _READ[x]
            seconds = x in ("%S", "%-S")
            if seconds and not (parts.index((what, x)) + 1 < len(parts) and parts[parts.index((what, x)) + 1][0] == "frac"):
                pattern += r"(?:[.,](?P<f>\d{1,9}))?" if "(?P<f>" not in pattern else ""
    m = re.fullmatch(pattern, text)
    if not m:
        raise MappingError(f"parsing time {text!r} as {shown!r}: cannot parse")
    g = m.groupdict()
    if g.get("s"):
        return datetime.fromtimestamp(int(g["s"]), UTC)
    year = int(g["Y"]) if g.get("Y") else (lambda y: y + (1900 if y >= 69 else 2000))(int(g["y"])) if g.get("y") else 0
    month = int(g["m"]) if g.get("m") else 1
    if g.get("b"):
        if g["b"][:3].lower() not in _MONTHS:
            raise MappingError(f"parsing time {text!r}: unknown month")
        month = _MONTHS.index(g["b"][:3].lower()) + 1
    hour = int(g["H"]) if g.get("H") else int(g.get("I") or 0)
    if g.get("p"):
        hour = hour % 12 + (12 if g["p"].lower() == "pm" else 0)
    tz = UTC
    if g.get("z") and g["z"] != "Z":
        digits = g["z"][1:].replace(":", "").ljust(4, "0")
        tz = timezone((-1 if g["z"][0] == "-" else 1) * timedelta(hours=int(digits[:2]), minutes=int(digits[2:])))
    elif g.get("Z") and g["Z"] not in ("UTC", "GMT", "Z"):
        try:
            tz = zone(g["Z"])
        except MappingError:
            tz = UTC
    micro = int((g.get("f") or "0")[:6].ljust(6, "0"))
    try:
        t = datetime(max(year, 1), month, int(g.get("d") or 1), hour, int(g.get("M") or 0), int(g.get("S") or 0), micro, tz)
    except ValueError as e:
        raise MappingError(f"parsing time {text!r}: {e}") from None
    return t + timedelta(days=int(g["j"]) - 1) if g.get("j") else t


@method("timestamp")
def timestamp(v, default=_NONE):
    try:
        return as_timestamp(v)
    except MappingError:
        if default is _NONE:
            raise
        return default


@method("ts_parse")
def ts_parse(v, format):
    return read_time(as_string(v), layout_parts(format), format)


@method("parse_timestamp")
def parse_timestamp(v, format):
    return rfc3339(ts_parse(v, format))


@method("ts_strptime")
def ts_strptime(v, format):
    return read_time(as_string(v), strftime_parts(format), format)


@method("parse_timestamp_strptime")
def parse_timestamp_strptime(v, format):
    return rfc3339(ts_strptime(v, format))


def _in_zone(v, tz):
    t = as_timestamp(v)
    return t if tz is None else t.astimezone(zone(as_string(tz)))


@method("ts_format", "format_timestamp")
def ts_format(v, format=RFC3339_NANO, tz=None):
    return render(_in_zone(v, tz), layout_parts(format))


@method("ts_strftime", "format_timestamp_strftime")
def ts_strftime(v, format, tz=None):
    return render(_in_zone(v, tz), strftime_parts(format))


def unix_micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


@method("ts_unix", "format_timestamp_unix")
def ts_unix(v):
    return unix_micros(as_timestamp(v)) // 1_000_000


@method("ts_unix_milli", "format_timestamp_unix_milli")
def ts_unix_milli(v):
    return unix_micros(as_timestamp(v)) // 1000


@method("ts_unix_micro", "format_timestamp_unix_micro")
def ts_unix_micro(v):
    return unix_micros(as_timestamp(v))


@method("ts_unix_nano", "format_timestamp_unix_nano")
def ts_unix_nano(v):
    return unix_micros(as_timestamp(v)) * 1000


@method("ts_sub")
def ts_sub(v, t2):
    return (unix_micros(as_timestamp(v)) - unix_micros(as_timestamp(t2))) * 1000


#: Microseconds from the first day of year 1 to 1970: rounding counts from there.
YEAR_ONE = 62_135_596_800_000_000


@method("ts_round")
def ts_round(v, duration):
    t, step = as_timestamp(v), as_int(duration)
    if step <= 0:
        return t
    nanos = (unix_micros(t) + YEAR_ONE) * 1000
    low = nanos // step * step
    rounded = low + step if 2 * (nanos - low) >= step else low
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=rounded // 1000 - YEAR_ONE)).astimezone(t.tzinfo)


@method("ts_tz")
def ts_tz(v, tz):
    return as_timestamp(v).astimezone(zone(as_string(tz)))


_ISO = re.compile(r"(-)?P(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?")


def iso_period(text: str) -> list[float]:
    """Years, months, weeks, days, hours, minutes, seconds."""
    m = _ISO.fullmatch(text)
    if not m or not any(m.groups()[1:]):
        raise MappingError(f"invalid ISO 8601 duration {text!r}")
    sign = -1 if m[1] else 1
    return [sign * float(x or 0) for x in m.groups()[1:]]


def _shift(t: datetime, period: list[float], sign: int) -> datetime:
    years, months, weeks, days, hours, minutes, seconds = (sign * x for x in period)
    whole = t.year * 12 + t.month - 1 + int(years * 12 + months)
    first = t.replace(year=whole // 12, month=whole % 12 + 1, day=1)
    return first + timedelta(days=t.day - 1 + 7 * weeks + days, hours=hours, minutes=minutes, seconds=seconds)  # a day past the month's end runs on


@method("ts_add_iso8601")
def ts_add_iso8601(v, duration):
    return _shift(as_timestamp(v), iso_period(as_string(duration)), 1)


@method("ts_sub_iso8601")
def ts_sub_iso8601(v, duration):
    return _shift(as_timestamp(v), iso_period(as_string(duration)), -1)


#: Nanoseconds of a unit.
UNITS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def duration_nanos(text: str) -> int:
    m = re.fullmatch(r"([+-])?((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+|([+-])?0", text)
    if not m:
        raise MappingError(f"invalid duration {text!r}")
    total = sum(round(float(n) * UNITS[u]) for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", text))
    return -total if text.startswith("-") else total


@method("parse_duration")
def parse_duration(v):
    return duration_nanos(as_string(v))


@method("parse_duration_iso8601")
def parse_duration_iso8601(v):
    years, months, weeks, days, hours, minutes, seconds = iso_period(as_string(v))
    day = 86400.0
    return math.floor((years * 365.2425 * day + months * 365.2425 * day / 12 + weeks * 7 * day + days * day + hours * 3600 + minutes * 60 + seconds) * 1e9 + 0.5)


@function("now")
def now():
    return rfc3339(datetime.now(UTC))


@function("timestamp_unix")
def timestamp_unix():
    return unix_micros(datetime.now(UTC)) // 1_000_000


@function("timestamp_unix_milli")
def timestamp_unix_milli():
    return unix_micros(datetime.now(UTC)) // 1000


@function("timestamp_unix_micro")
def timestamp_unix_micro():
    return unix_micros(datetime.now(UTC))


@function("timestamp_unix_nano")
def timestamp_unix_nano():
    return unix_micros(datetime.now(UTC)) * 1000
