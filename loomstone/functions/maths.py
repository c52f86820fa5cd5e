"""Numeric, geographic, conversion and miscellaneous functions."""

from __future__ import annotations

import re

from . import datetimes
from .strings import quote, text, unquote

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__.rstrip("_")] = f
    return f


def _guarded(name: str, x: str, ok: str, out: str) -> str:
    return f"(case when {x} is null then null when {ok} then {out} else raise_error('{name} is not defined for this argument') end)"


@rule
def pi():
    return "pi()"


@rule
def power(x, y):
    return f"pow({x}, {y})"


FUNCTIONS["pow"] = power


@rule
def sqrt(x):
    return _guarded("SQRT", x, f"{x} >= 0", f"sqrt({x})")


@rule
def ln(x):
    return _guarded("LN", x, f"{x} > 0", f"ln({x})")


@rule
def log10(x):
    return _guarded("LOG10", x, f"{x} > 0", f"log10({x})")


@rule
def log2(x):
    return _guarded("LOG2", x, f"{x} > 0", f"log2({x})")


@rule
def log(x, base=None):
    return ln(x) if base is None else f"({ln(x)} / {ln(base)})"


for _name in ("cbrt", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "degrees", "radians", "cot"):
    FUNCTIONS[_name] = lambda *a, n=_name: f"{n}({', '.join(a)})"
FUNCTIONS["atn2"] = FUNCTIONS["atan2"]


@rule
def floor(x):
    return f"cast(floor({x}) as double)"


@rule
def ceil(x):
    return f"cast(ceil({x}) as double)"


FUNCTIONS["ceiling"] = ceil


@rule
def trunc(x):
    return f"cast(case when {x} < 0 then ceil({x}) else floor({x}) end as double)"


@rule
def sign(x):
    return f"cast(sign({x}) as int)"


@rule
def mod(a, b):
    return f"mod({a}, {b})"


@rule
def abs_(x):
    return f"abs({x})"


@rule
def round_(x, n="0"):
    return f"round({x}, {n})"


@rule
def square(x):
    return f"(({x}) * ({x}))"


@rule
def divide(a, b):
    """Null on a zero divisor; cut towards zero where both sides are integers."""
    whole = f"(typeof({a}) in ('tinyint', 'smallint', 'int', 'bigint') and typeof({b}) in ('tinyint', 'smallint', 'int', 'bigint'))"
    q = f"try_divide({a}, {b})"
    return f"(case when {whole} then cast(case when {q} < 0 then ceil({q}) else floor({q}) end as double) else cast({q} as double) end)"


@rule
def int_divide(a, b):
    return f"(case when {b} = 0 then null else ({a}) div ({b}) end)"


@rule
def modulo(a, b):
    return f"try_mod({a}, {b})"


def _haversine(a, b, c, d, radius):
    lat1, lat2, dlat, dlon = f"radians({a})", f"radians({c})", f"radians(({c}) - ({a}))", f"radians(({d}) - ({b}))"
    h = f"(pow(sin({dlat} / 2), 2) + cos({lat1}) * cos({lat2}) * pow(sin({dlon} / 2), 2))"
    return f"({radius} * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


@rule
def geo_haversine_distance(a, b, c, d):
    """Metres between (latitude, longitude) a, b and c, d."""
    return _haversine(a, b, c, d, "6371000D")


@rule
def geo_distance_km(a, b, c, d):
    return _haversine(a, b, c, d, "6371D")


@rule
def greatest(*a):
    return f"greatest({', '.join(a)})"


@rule
def least(*a):
    return f"least({', '.join(a)})"


def _strict(name, a):
    nulls = " or ".join(f"{x} is null" for x in a)
    return f"(case when {nulls} then null else {name}({', '.join(a)}) end)"


@rule
def scalar_max(*a):
    """Null if any argument is."""
    return _strict("greatest", a)


@rule
def scalar_min(*a):
    return _strict("least", a)


@rule
def rand(seed=None):
    return f"rand({seed})" if seed and re.fullmatch(r"\d+", seed) else "rand()"


@rule
def checksum(*a):
    """A stable 32-bit checksum of the arguments."""
    return f"hash({', '.join(a)})"


FUNCTIONS["binary_checksum"] = checksum


@rule
def compress(x):
    return f"ls_compress(cast({x} as binary))"


@rule
def decompress(x):
    return f"ls_decompress({x})"


@rule
def point(x, y, srid="0"):
    return f"concat('POINT (', {text(x)}, ' ', {text(y)}, ')')"


FUNCTIONS["tsql_point"] = point


@rule
def hierarchy_level(p):
    return f"(char_length({p}) - char_length(replace({p}, '/', '')) - 1)"


@rule
def hierarchy_is_descendant(p, of):
    return f"cast(startswith({p}, {of}) as int)"


@rule
def isnumeric(x):
    return f"cast(try_cast(trim({text(x)}) as double) is not null as int)"


@rule
def isnull(a, b):
    return f"coalesce({a}, {b})"


FUNCTIONS["ifnull"] = FUNCTIONS["nvl"] = isnull


@rule
def iif(c, a, b):
    return f"if(cast({c} as boolean), {a}, {b})"


FUNCTIONS["if"] = iif


@rule
def choose(i, *values):
    return f"get(array({', '.join(values)}), cast({i} as int) - 1)"


FUNCTIONS["elt"] = choose

#: Declared types of the dialects and the Spark types that hold them (fixed values).
TYPES = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint", "mediumint": "bigint", "int2": "bigint", "int4": "bigint", "int8": "bigint", "signed": "bigint", "unsigned": "bigint", "serial": "bigint", "bigserial": "bigint",
    "bit": "boolean", "bool": "boolean", "boolean": "boolean", "real": "double", "float": "double", "float4": "double", "float8": "double", "double": "double", "decimal": "double", "numeric": "double", "money": "double", "smallmoney": "double",
    "text": "string", "varchar": "string", "nvarchar": "string", "char": "string", "nchar": "string", "ntext": "string", "clob": "string", "sysname": "string", "json": "string", "jsonb": "string", "xml": "string", "uniqueidentifier": "string", "uuid": "string", "sql_variant": "string", "enum": "string", "name": "string",
    "blob": "binary", "varbinary": "binary", "binary": "binary", "image": "binary", "bytea": "binary", "date": "date", "datetime": "timestamp", "datetime2": "timestamp", "smalldatetime": "timestamp", "timestamp": "timestamp", "timestamptz": "timestamp", "datetimeoffset": "timestamp", "time": "string",
}
#: Ranges of the integer types (fixed values).
RANGES = {"tinyint": (0, 255), "smallint": (-32768, 32767), "int": (-2147483648, 2147483647), "integer": (-2147483648, 2147483647)}


def type_name(declared: str) -> tuple[str, str, int | None]:
    """Base name, Spark type and length of a declared type."""
    m = re.fullmatch(r"\s*(\w+)(?:\s+(?:precision|varying|integer))?\s*(?:\(\s*(\w+)\s*(?:,\s*\w+\s*)?\))?\s*", declared.lower())
    if not m or m[1] not in TYPES:
        raise ValueError(f"unknown type {declared.strip()}")
    return m[1], TYPES[m[1]], int(m[2]) if m[2] and m[2].isdigit() else None


def render_text(x: str) -> str:
    """A value as text, instants in ISO form."""
    return f"cast({x} as string)"


def cast(x: str, declared: str) -> str:
    """A lossy CAST: numbers are read from the front of a text (0 if there is none), dates are strict."""
    base, spark, n = type_name(declared)
    if spark == "bigint":
        number = f"regexp_extract(cast({x} as string), '^\\\\s*([+-]?[0-9]+)', 1)"
        return f"(case when {x} is null then null when typeof({x}) = 'string' then coalesce(try_cast(nullif({number}, '') as bigint), 0) else try_cast({x} as bigint) end)"
    if spark == "double":
        number = f"regexp_extract(cast({x} as string), '^\\\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
        return f"(case when {x} is null then null when typeof({x}) = 'string' then coalesce(try_cast(nullif({number}, '') as double), 0D) else try_cast({x} as double) end)"
    if spark == "string" and n:
        return f"left({render_text(x)}, {n})"
    return f"cast({x} as {spark})"


def try_cast(x: str, declared: str) -> str:
    """Null where the value doesn't fit the type."""
    base, spark, n = type_name(declared)
    if spark == "bigint":
        number = f"try_cast(trim({text(x)}) as decimal(38,6))"
        whole = f"(case when typeof({x}) = 'string' and not trim({text(x)}) rlike '^[+-]?[0-9]+$' then null else cast({number} as bigint) end)"
        if base in RANGES:
            lo, hi = RANGES[base]
            return f"(case when {whole} between {lo} and {hi} then {whole} end)"
        return whole
    if spark == "string":
        if base in ("uniqueidentifier", "uuid"):
            return f"(case when {text(x)} rlike '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$' then upper({text(x)}) end)"
        return f"left({render_text(x)}, {n})" if n else render_text(x)
    return f"try_cast({x} as {spark})"


def convert(declared: str, x: str, style: str | None = None) -> str:
    """CONVERT with a style: instants to text, text to instants."""
    base, spark, n = type_name(declared)
    if style is None:
        return cast(x, declared)
    number = int(style)
    if spark == "string":
        out = datetimes.convert_date_style(x, number)
        if number in (0, 1, 2):
            # of a number: 2 decimals, with commas, or 4 decimals; the type is known when the query is planned
            value = f"try_cast({text(x)} as double)"
            shown = f"format_number({value}, {4 if number == 2 else 2})"
            shown = shown if number == 1 else f"replace({shown}, ',', '')"
            out = f"(case when typeof({x}) in ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') or typeof({x}) like 'decimal%' then {shown} else {out} end)"
        return f"left({out}, {n})" if n else out
    if spark in ("date", "timestamp"):
        return f"cast({datetimes.parse_date_style(x, number)} as {spark})"
    return cast(x, declared)


@rule
def format_(v, fmt, culture="'en-US'"):
    """.NET-like formats: N, F, P, C, D, X, E with digits on the JVM, others and date patterns by UDF."""
    f, c = unquote(fmt), unquote(culture)
    m = re.fullmatch(r"([NFPDXEC])(\d*)", f or "", re.I)
    if m and c == "en-US":
        kind, digits = m[1].upper(), m[2]
        n = digits or "2"
        if kind == "N":
            return f"format_number(cast({v} as double), {n})"
        if kind == "F":
            return f"replace(format_number(cast({v} as double), {n}), ',', '')"
        if kind == "P":
            return f"concat(format_number(cast({v} as double) * 100, {n}), '%')"
        if kind == "C":
            return f"concat(if({v} < 0, '-', ''), '$', format_number(abs(cast({v} as double)), {n}))"
        if kind == "D":
            return f"format_string('%0{digits or 1}d', cast({v} as bigint))"
        if kind == "X":
            return f"format_string('%{'0' + digits if digits else ''}{m[1]}', cast({v} as bigint))"
        if kind == "E":
            return f"ls_format(cast({v} as string), {fmt}, {culture})"
    if f and re.search(r"[yMdHhms]", f) and not re.search(r"[0#]", f):
        return f"date_format({datetimes.ts(v)}, {quote(f.replace('tt', 'a').replace('dddd', 'EEEE').replace('ddd', 'EEE').replace('fff', 'SSS'))})"
    return f"ls_format(cast({v} as string), {fmt}, {culture})"


for _name, _value in {"db_name": "current_database()", "current_timezone": "'UTC'", "schema_id": "1", "schema_name": "'dbo'", "original_db_name": "'master'", "current_database": "current_database()", "current_schema": "'public'", "current_user": "current_user()", "database": "current_database()", "version": "version()", "connection_id": "1", "user": "current_user()"}.items():
    FUNCTIONS[_name] = lambda *a, v=_value: v


@rule
def serverproperty(name):
    known = {"productversion": "version()", "edition": "'Loomstone'", "engineedition": "'3'", "servername": "'localhost'", "collation": "'UTF8_BINARY'"}
    return known.get((unquote(name) or "").lower(), "cast(null as string)")


def _unsupported(name):
    def refuse(*_):
        raise ValueError(f"{name} is not supported")

    return refuse


for _name in ("databasepropertyex", "sessionproperty", "columnproperty", "indexproperty", "file_name", "file_idex", "type_id", "type_name", "nextval", "setval"):
    FUNCTIONS[_name] = _unsupported(_name)
