"""Arrow-batched pandas UDFs for what no built-in expression can say."""

from __future__ import annotations

import gzip
import hashlib
import hmac
import json
import re
import struct

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _each(f, *series: pd.Series) -> pd.Series:
    """f over the rows; null where any argument is null."""
    return pd.Series([None if any(x is None or x is pd.NA or (isinstance(x, float) and x != x) for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)


def _dump(value, indent=None) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=indent, separators=None if indent else (",", ":"))


def _parse(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def json_pretty(j: str) -> str | None:
    ok, v = _parse(j)
    return _dump(v, 2) if ok else None


def json_minify(j: str) -> str | None:
    ok, v = _parse(j)
    return _dump(v) if ok else None


def merged(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def json_merge_patch(a: str, b: str) -> str | None:
    (ok, x), (fine, y) = _parse(a), _parse(b)
    return _dump(merged(x, y)) if ok and fine else None


def contains(whole, part) -> bool:
    if isinstance(whole, dict) and isinstance(part, dict):
        return all(k in whole and contains(whole[k], v) for k, v in part.items())
    if isinstance(whole, list):
        return all(x in whole for x in part) if isinstance(part, list) else part in whole
    return whole == part


def json_contains(a: str, b: str) -> int | None:
    (ok, x), (fine, y) = _parse(a), _parse(b)
    return int(contains(x, y)) if ok and fine else None


def stripped(v):
    if isinstance(v, dict):
        return {k: stripped(x) for k, x in v.items() if x is not None}
    return [stripped(x) for x in v] if isinstance(v, list) else v


def json_strip_nulls(j: str) -> str | None:
    ok, v = _parse(j)
    return _dump(stripped(v)) if ok else None


def _steps(path: str) -> list:
    return [int(i) if i else k for k, i in re.findall(r'\.(?:"?([^."\[]+)"?)|\[(\d+)\]', path)]


def changed(v, path: str, new, mode: str):
    """The value with the place of the path set, inserted, replaced or removed."""
    steps = _steps(path)
    if not steps:
        return new if mode in ("set", "replace") else v
    at = v
    for s in steps[:-1]:
        if isinstance(at, dict) and s not in at and mode in ("set", "insert"):
            at[s] = {}
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return v
    s = steps[-1]
    there = (isinstance(at, dict) and s in at) or (isinstance(at, list) and isinstance(s, int) and s < len(at))
    if mode == "remove":
        if there:
            del at[s]
    elif there:
        if mode != "insert":
            at[s] = new
    elif mode != "replace":
        if isinstance(at, dict):
            at[s] = new
        elif isinstance(at, list):
            at.append(new)
    return v


def _changer(mode: str):
    def f(j, path, new="null"):
        ok, v = _parse(j)
        if not ok:
            return None
        fine, value = _parse(new)
        return _dump(changed(v, path, value if fine and not isinstance(value, str) else new, mode))

    return f


def json_quote(t: str) -> str:
    return json.dumps(t, ensure_ascii=False)


def parsename(name: str, i: int) -> str | None:
    """The i-th part of a dotted name from the right; parts may be bracketed or quoted."""
    parts = re.findall(r'(?:^|\.)(?:\[((?:[^\]]|\]\])*)\]|"((?:[^"]|"")*)"|([^.\[\]"]*))', name)
    values = [a.replace("]]", "]") or b.replace('""', '"') or c for a, b, c in parts]
    return values[-int(i)] or None if 1 <= i <= len(values) <= 4 else None


def json_depth(t: str) -> int | None:
    """Levels of nesting; scalars and empty containers are one."""
    ok, value = _parse(t)

    def depth(v) -> int:
        return 1 + max(map(depth, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, dict | list) else 1

    return depth(value) if ok else None


def json_length_deep(t: str) -> int | None:
    """Scalars at any level."""
    ok, value = _parse(t)

    def leaves(v) -> int:
        return sum(map(leaves, v.values() if isinstance(v, dict) else v)) if isinstance(v, dict | list) else 1

    return leaves(value) if ok else None


def unistr(t: str) -> str:
    r"""\XXXX, \+XXXXXX and \\ as characters."""
    return re.sub(r"\\(\\|\+[0-9A-Fa-f]{6}|[0-9A-Fa-f]{4})", lambda m: "\\" if m[1] == "\\" else chr(int(m[1].lstrip("+"), 16)), t)


def regexp_instr(t, p, start, occurrence, end, group) -> int:
    for n, m in enumerate(re.compile(p).finditer(t, max(int(start) - 1, 0)), 1):
        if n == occurrence:
            return (m.end(int(group)) if end else m.start(int(group))) + 1
    return 0


def regexp_replace(t, p, r, start, occurrence) -> str:
    n, begin = 0, max(int(start) - 1, 0)

    def one(m):
        nonlocal n
        n += 1
        return m.expand(r) if n == occurrence else m[0]

    return t[:begin] + re.sub(p, one, t[begin:])


#: Thousands and decimal marks of cultures (fixed values).
MARKS = {"en-us": ",.", "en-gb": ",.", "vi-vn": ".,", "de-de": ".,", "id-id": ".,", "es-es": ".,", "it-it": ".,", "nl-nl": ".,", "fr-fr": " ,"}
CURRENCY = {"en-us": "${}", "en-gb": "£{}", "vi-vn": "{} ₫", "de-de": "{} €", "id-id": "Rp{}", "es-es": "{} €", "it-it": "{} €", "nl-nl": "€ {}", "fr-fr": "{} €"}


def format_number(v: str, fmt: str, culture: str) -> str | None:
    """.NET-like number formats in a culture."""
    c = culture.lower()
    if c not in MARKS:
        raise ValueError(f"unsupported culture {culture}")
    try:
        x = float(v)
    except ValueError:
        return None
    m = re.fullmatch(r"([NFPCEG])(\d*)", fmt, re.I)

    def local(s):
        return s.translate(str.maketrans(",.", MARKS[c]))

    if m:
        kind, n = m[1].upper(), int(m[2] or 2)
        if kind == "E":
            mantissa, exponent = f"{x:.{int(m[2] or 6)}E}".split("E")
            return f"{local(mantissa)}{m[1]}{exponent[0]}{int(exponent[1:]):03d}"
        if kind == "G":
            return local(f"{x:.{m[2] or 15}g}")
        body = local(f"{abs(x) * (100 if kind == 'P' else 1):{',' if kind != 'F' else ''}.{n}f}")
        body = body + "%" if kind == "P" else CURRENCY[c].format(body) if kind == "C" else body
        return ("-" if x < 0 else "") + body
    whole, _, part = fmt.partition(".")
    percent = "%" in fmt
    zeros, places = whole.count("0"), len(re.findall("[0#]", part))
    body = f"{abs(x) * (100 if percent else 1):{',' if ',' in whole else ''}.{places}f}"
    head, _, tail = body.partition(".")
    keep = part.rstrip("%").count("0")
    while len(tail) > keep and tail.endswith("0"):
        tail = tail[:-1]
    head = head.zfill(zeros)
    return ("-" if x < 0 else "") + local(head + ("." + tail if tail else "")) + "%" * percent


def register(spark: SparkSession) -> None:
    """Register all UDFs in the session."""
    for name, (f, kind, n) in TABLE.items():
        spark.udf.register(name, F.pandas_udf(_series(f, n), kind))


def _series(f, n):
    # one function for each number of arguments, as pandas_udf reads the type hints
    if n == 1:

        def run(a: pd.Series) -> pd.Series:
            return _each(f, a)

    elif n == 2:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return _each(f, a, b)

    elif n == 3:

        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return _each(f, a, b, c)

    elif n == 5:

        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
            return _each(f, a, b, c, d, e)

    else:

        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, g: pd.Series) -> pd.Series:
            return _each(f, a, b, c, d, e, g)

    return run


TABLE = {
    "ls_json_pretty": (json_pretty, "string", 1),
    "ls_json_minify": (json_minify, "string", 1),
    "ls_json_merge_patch": (json_merge_patch, "string", 2),
    "ls_json_contains": (json_contains, "int", 2),
    "ls_json_strip_nulls": (json_strip_nulls, "string", 1),
    "ls_json_set": (_changer("set"), "string", 3),
    "ls_json_insert": (_changer("insert"), "string", 3),
    "ls_json_replace": (_changer("replace"), "string", 3),
    "ls_json_remove": (_changer("remove"), "string", 2),
    "ls_json_quote": (json_quote, "string", 1),
    "ls_json_depth": (json_depth, "int", 1),
    "ls_json_length_deep": (json_length_deep, "int", 1),
    "ls_parsename": (parsename, "string", 2),
    "ls_unistr": (unistr, "string", 1),
    "ls_regexp_instr": (regexp_instr, "int", 6),
    "ls_regexp_replace": (regexp_replace, "string", 5),
    "ls_format": (format_number, "string", 3),
    "ls_compress": (lambda b: gzip.compress(b, mtime=0), "binary", 1),
    "ls_decompress": (lambda b: gzip.decompress(b), "binary", 1),
    "ls_hmac_sha256": (lambda k, m: hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest(), "string", 2),
    "ls_vector_to_blob": (lambda v: struct.pack(f"<{len(v)}f", *v), "binary", 1),
    "ls_vector_from_blob": (lambda b: list(struct.unpack(f"<{len(b) // 4}f", b)) if len(b) % 4 == 0 else None, "array<double>", 1),
}
