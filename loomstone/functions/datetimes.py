"""Date and time functions. Instants are texts in ISO form or timestamps, in UTC."""

from __future__ import annotations

import re

from .strings import quote, text, unquote

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__.rstrip("_")] = f
    return f


#: Names of date parts and what they stand for.
PARTS = {
    "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter",
    "month": "month", "mm": "month", "m": "month", "dayofyear": "dayofyear", "dy": "dayofyear", "y": "dayofyear",
    "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week", "weekday": "weekday", "dw": "weekday", "w": "weekday",
    "iso_week": "iso_week", "isowk": "iso_week", "isoww": "iso_week", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute",
    "second": "second", "ss": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond", "microsecond": "microsecond", "mcs": "microsecond",
}
ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}


def part_of(p: str) -> str:
    name = (unquote(p) or p).strip().lower()
    if name not in PARTS:
        raise ValueError(f"unknown date part {name}")
    return PARTS[name]


def ts(x: str) -> str:
    """Strict: raises on text that is no instant.

    Texts may also be ``yyyyMMdd`` or ``MM/dd/yyyy``, whole numbers are days since 1900-01-01. The type is
    known when the query is planned, so that for timestamps and dates only the cast is left.
    """
    if not re.fullmatch(r"[\w.`]+|'[^']*'|-?[0-9]+", x.strip()):
        return f"cast({x} as timestamp)"
    t = text(x)
    return (
        f"(case when typeof({x}) in ('tinyint', 'smallint', 'int', 'bigint') then timestamp_micros((try_cast({t} as bigint) - 25567) * 86400000000)"
        f" when typeof({x}) = 'string' and {t} rlike '^[0-9]{{8}}$' then to_timestamp({t}, 'yyyyMMdd')"
        f" when typeof({x}) = 'string' and {t} rlike '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$' then to_timestamp({t}, 'M/d/yyyy') else cast({x} as timestamp) end)"
    )


def soft(x: str) -> str:
    """Null on text that is no instant."""
    return f"try_cast({x} as timestamp)"


def iso_ms(x: str) -> str:
    return f"date_format({x}, {quote(ISO_MS)})"


def render(x: str, like: str | None = None) -> str:
    """An instant as text; a date alone where ``like`` is a date or a date's text."""
    part = f"pmod(unix_micros({x}), 1000000)"
    whole = f"(case when {part} = 0 then date_format({x}, 'yyyy-MM-dd HH:mm:ss') when {part} % 1000 = 0 then date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSS') else date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') end)"
    if like is None:
        return whole
    return f"(case when char_length(trim({text(like)})) <= 10 then date_format({x}, 'yyyy-MM-dd') else {whole} end)"


@rule
def now_ms():
    return "unix_millis(current_timestamp())"


@rule
def now_us():
    return "unix_micros(current_timestamp())"


@rule
def now_iso():
    return iso_ms("current_timestamp()")


for _name in ("getdate", "sysdatetime", "getutcdate", "sysutcdatetime"):
    FUNCTIONS[_name] = now_iso


@rule
def sysdatetimeoffset():
    return f"concat({now_iso()}, '+00:00')"


@rule
def epoch_ms(x):
    return f"unix_millis({soft(x)})"


@rule
def from_epoch_ms(n):
    return iso_ms(f"timestamp_millis({n})")


@rule
def date_part(p, x):
    name, t = (unquote(p) or p).lower(), soft(x)
    found = {"year": f"year({t})", "month": f"month({t})", "day": f"day({t})", "hour": f"hour({t})", "minute": f"minute({t})", "second": f"second({t})", "millisecond": f"pmod(unix_millis({t}), 1000)", "dow": f"dayofweek({t}) - 1", "doy": f"dayofyear({t})", "epoch": f"unix_seconds({t})"}
    return f"cast({found.get(name, 'null')} as bigint)"


@rule
def date_trunc(p, x):
    name = (unquote(p) or p).lower()
    if name not in ("year", "month", "day", "hour", "minute", "second"):
        return "cast(null as string)"
    return iso_ms(f"date_trunc('{name}', {soft(x)})")


@rule
def age_ms(a, b):
    return f"(unix_millis({soft(a)}) - unix_millis({soft(b)}))"


@rule
def year(x):
    return f"year({ts(x)})"


@rule
def month(x):
    return f"month({ts(x)})"


@rule
def day(x):
    return f"day({ts(x)})"


@rule
def unix_timestamp(x="current_timestamp()"):
    return f"unix_seconds({ts(x)})"


@rule
def datefromparts(y, m, d):
    return f"format_string('%04d-%02d-%02d', {y}, {m}, {d})"


@rule
def timefromparts(h, m, s, f="0", p="0"):
    fraction = f", if({p} > 0, concat('.', lpad(cast({f} as string), {p}, '0')), '')"
    return f"concat(format_string('%02d:%02d:%02d', {h}, {m}, {s}){fraction if p != '0' else ''})"


@rule
def datetimefromparts(y, mo, d, h, mi, s, ms="0"):
    return f"format_string('%04d-%02d-%02d %02d:%02d:%02d.%03d', {y}, {mo}, {d}, {h}, {mi}, {s}, {ms})"


@rule
def datepart(p, x):
    t = ts(x)
    sub = f"pmod(unix_micros({t}), 1000000)"
    return {
        "year": f"year({t})", "quarter": f"quarter({t})", "month": f"month({t})", "dayofyear": f"dayofyear({t})", "day": f"day({t})",
        "week": f"cast(floor((dayofyear({t}) + dayofweek(trunc({t}, 'YEAR')) - 2) / 7) + 1 as int)", "weekday": f"dayofweek({t})", "iso_week": f"weekofyear({t})",
        "hour": f"hour({t})", "minute": f"minute({t})", "second": f"second({t})", "millisecond": f"cast({sub} div 1000 as int)", "microsecond": f"cast({sub} as int)",
    }[part_of(p)]


@rule
def datename(p, x):
    kind = part_of(p)
    names = {"month": "MMMM", "weekday": "EEEE"}
    return f"date_format({ts(x)}, '{names[kind]}')" if kind in names else text(datepart(p, x))


def _added(kind: str, n: str, t: str) -> str:
    months = {"year": 12, "quarter": 3, "month": 1}.get(kind)
    if months:
        # add_months keeps the month's end; the time of day goes along in microseconds
        return f"timestamp_micros(unix_micros(cast(add_months(to_date({t}), cast({n} as int) * {months}) as timestamp)) + unix_micros({t}) - unix_micros(date_trunc('DAY', {t})))"
    step = _MICROS[{"dayofyear": "day", "weekday": "day", "iso_week": "week"}.get(kind, kind)]
    return f"timestamp_micros(unix_micros({t}) + cast({n} as bigint) * {step})"


@rule
def dateadd(p, n, x):
    kind = part_of(p)
    out = _added(kind, n, ts(x))
    return render(out, x if kind not in ("hour", "minute", "second", "millisecond", "microsecond") else None)


@rule
def datediff(p, a, b):
    """Boundaries crossed from a to b."""
    kind, s, e = part_of(p), ts(a), ts(b)

    def ordinal(t):
        if kind == "year":
            return f"year({t})"
        if kind == "quarter":
            return f"(year({t}) * 4 + quarter({t}))"
        if kind == "month":
            return f"(year({t}) * 12 + month({t}))"
        if kind in ("week", "iso_week"):
            return f"floor((unix_date(to_date({t})) + {4 if kind == 'week' else 3}) / 7)"
        if kind in ("day", "dayofyear", "weekday"):
            return f"unix_date(to_date({t}))"
        return f"floor(unix_micros({t}) / {_MICROS[kind]})"

    return f"cast({ordinal(e)} - {ordinal(s)} as bigint)"


FUNCTIONS["datediff_big"] = datediff


@rule
def eomonth(x, n="0"):
    return f"date_format(last_day(add_months(to_date({ts(x)}), {n})), 'yyyy-MM-dd')"


@rule
def datetrunc(p, x):
    kind, t = part_of(p), ts(x)
    if kind == "week":
        return f"date_format(timestamp_micros(unix_micros(date_trunc('WEEK', timestamp_micros(unix_micros({t}) + {_MICROS['day']}))) - {_MICROS['day']}), 'yyyy-MM-dd HH:mm:ss')"
    unit = {"iso_week": "WEEK", "dayofyear": "DAY", "weekday": "DAY"}.get(kind, kind.upper())
    return render(f"date_trunc('{unit}', {t})")


@rule
def date_bucket(p, n, x, origin="'1900-01-01'"):
    """Start of the tumbling bucket of n parts that holds x, counted from the origin."""
    kind, t, o = part_of(p), ts(x), ts(origin)
    months = {"year": 12, "quarter": 3, "month": 1}.get(kind)
    if months:
        size = f"({n} * {months})"
        gone = f"floor(cast(floor(months_between(date_trunc('DAY', {t}), {o})) as bigint) / {size})"
        return render(f"cast(add_months(to_date({o}), cast({gone} * {size} as int)) as timestamp)", x)
    size = f"({n} * {_MICROS[{'dayofyear': 'day', 'weekday': 'day', 'iso_week': 'week'}.get(kind, kind)]}L)"
    return render(f"timestamp_micros(unix_micros({o}) + floor((unix_micros({t}) - unix_micros({o})) / {size}) * {size})", x)


@rule
def isdate(x):
    return f"cast(coalesce(year({soft(x)}) between 1753 and 9999, false) as int)"


#: CONVERT styles of dates and times as patterns (fixed values).
STYLES = {
    0: "MMM dd yyyy hh:mma", 100: "MMM dd yyyy hh:mma", 1: "MM/dd/yy", 101: "MM/dd/yyyy", 2: "yy.MM.dd", 102: "yyyy.MM.dd", 3: "dd/MM/yy", 103: "dd/MM/yyyy",
    4: "dd.MM.yy", 104: "dd.MM.yyyy", 5: "dd-MM-yy", 105: "dd-MM-yyyy", 6: "dd MMM yy", 106: "dd MMM yyyy", 7: "MMM dd, yy", 107: "MMM dd, yyyy", 8: "HH:mm:ss", 108: "HH:mm:ss", 24: "HH:mm:ss",
    10: "MM-dd-yy", 110: "MM-dd-yyyy", 11: "yy/MM/dd", 111: "yyyy/MM/dd", 12: "yyMMdd", 112: "yyyyMMdd", 14: "HH:mm:ss:SSS", 114: "HH:mm:ss:SSS",
    20: "yyyy-MM-dd HH:mm:ss", 120: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 25: "yyyy-MM-dd HH:mm:ss.SSS", 121: "yyyy-MM-dd HH:mm:ss.SSS", 22: "MM/dd/yy hh:mm:ss a", 23: "yyyy-MM-dd", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 127: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
}


@rule
def convert_date_style(x, style):
    """A date or time as text in a numbered style."""
    if int(style) not in STYLES:
        raise ValueError(f"unsupported style {style}")
    return f"date_format({ts(x)}, {quote(STYLES[int(style)])})"


@rule
def parse_date_style(x, style):
    if int(style) not in STYLES:
        raise ValueError(f"unsupported style {style}")
    return f"to_timestamp({x}, {quote(STYLES[int(style)])})"


#: MySQL date format letters as patterns (fixed values).
MYSQL_FORMAT = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss"}
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}


def _pattern(fmt: str, letters: dict[str, str]) -> str:
    v, out, i = unquote(fmt), "", 0
    if v is None:
        raise ValueError("a date format must be a literal")
    while i < len(v):
        if v[i] == "%" and i + 1 < len(v):
            if v[i + 1] != "%" and v[i + 1] not in letters:
                raise ValueError(f"unsupported date format letter {v[i + 1]}")
            out += letters.get(v[i + 1], "%")
            i += 2
        else:
            out += "''" if v[i] == "'" else f"'{v[i]}'" if v[i].isalpha() else v[i]
            i += 1
    return out


@rule
def date_format(x, fmt):
    return f"date_format({ts(x)}, {quote(_pattern(fmt, MYSQL_FORMAT))})"


def _modified(x: str, modifiers) -> str:
    t = "current_timestamp()" if unquote(x) == "now" else ts(x)
    for m in modifiers:
        words = (unquote(m) or "").strip().lower().split()
        if len(words) == 2 and words[0].lstrip("+-").isdigit():
            t = _added(part_of(quote(words[1].rstrip("s"))), words[0].lstrip("+"), t)
        elif words[:2] == ["start", "of"] and words[2] in ("year", "month", "day"):
            t = f"date_trunc('{words[2]}', {t})"
        elif words and words != ["utc"]:
            raise ValueError(f"unsupported date modifier {m}")
    return t


@rule
def strftime(fmt, x="'now'", *modifiers):
    t = _modified(x, modifiers)
    special = {"%w": f"cast(dayofweek({t}) - 1 as string)", "%s": f"cast(unix_seconds({t}) as string)", "%W": f"lpad(cast(floor((dayofyear({t}) + 6 - pmod(dayofweek({t}) - 2, 7)) / 7) as string), 2, '0')"}
    return special.get(unquote(fmt)) or f"date_format({t}, {quote(_pattern(fmt, STRFTIME))})"


@rule
def date(x="'now'", *modifiers):
    return f"date_format({_modified(x, modifiers)}, 'yyyy-MM-dd')"


@rule
def time(x="'now'", *modifiers):
    return f"date_format({_modified(x, modifiers)}, 'HH:mm:ss')"


@rule
def datetime(x="'now'", *modifiers):
    return f"date_format({_modified(x, modifiers)}, 'yyyy-MM-dd HH:mm:ss')"


@rule
def julianday(x="'now'", *modifiers):
    return f"(unix_micros({_modified(x, modifiers)}) / 86400000000D + 2440587.5D)"


@rule
def unixepoch(x="'now'", *modifiers):
    return f"unix_seconds({_modified(x, modifiers)})"
