"""String functions."""

from __future__ import annotations

import re

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__.rstrip("_")] = f
    return f


def text(x: str) -> str:
    """The argument as text."""
    return f"cast({x} as string)"


def quote(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquote(x: str) -> str | None:
    """The value of a SQL string literal, None for anything else."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", x.strip(), re.S)
    return re.sub(r"\\(.)", r"\1", m[1]) if m else None


def flag(x: str) -> str:
    return f"cast({x} as int)"


def _flags(flags: str | None) -> str:
    f = unquote(flags) if flags else ""
    if f is None or set(f) - set("icms"):
        raise ValueError("regular expression flags must be a literal of i, c, m and s")
    f = re.sub("i(?=.*c)|c(?=.*i)", "", f).replace("c", "")
    return f"(?{f})" if f else ""


def _pattern(p: str, flags: str | None = None) -> str:
    f = _flags(flags)
    if not f:
        return p
    v = unquote(p)
    return quote(f + v) if v is not None else f"concat('{f}', {p})"


@rule
def regexp(p, t):
    return flag(f"{text(t)} rlike {p}")


@rule
def ilike(t, p):
    v = unquote(p)
    if v is not None:
        regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in v.lower())
        return flag(f"lower({text(t)}) rlike {quote('(?s)^' + regex + '$')}")
    return flag(f"lower({text(t)}) like lower(replace({p}, '\\\\', '\\\\\\\\'))")


@rule
def glob(t, p):
    """Case-sensitive pattern of * ? and [..], a literal."""
    v = unquote(p)
    if v is None:
        raise ValueError("a GLOB pattern must be a literal")
    out, i = "", 0
    while i < len(v):
        c = v[i]
        if c == "[" and (end := v.find("]", i + 2)) > 0:
            inner = v[i + 1 : end].replace("\\", "\\\\")
            out += f"[{inner}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return flag(f"{text(t)} rlike {quote('(?s)^' + out + '$')}")


@rule
def len_(t):
    return f"char_length({text(t)})"


@rule
def reverse(t):
    return f"reverse({text(t)})"


@rule
def replicate(t, n):
    return f"repeat({text(t)}, greatest(least(cast({n} as int), 10000), 0))"


FUNCTIONS["repeat"] = replicate


@rule
def left(t, n):
    return f"(case when {n} < 0 then substring({text(t)}, 1, greatest(char_length({text(t)}) + ({n}), 0)) else substring({text(t)}, 1, {n}) end)"


@rule
def right(t, n):
    n_of = f"greatest(case when {n} < 0 then char_length({text(t)}) + ({n}) else {n} end, 0)"
    return f"right({text(t)}, {n_of})"


@rule
def split_part(t, d, i):
    return f"(case when {i} < 1 then '' else split_part({text(t)}, {d}, greatest({i}, 1)) end)"


@rule
def lpad(t, n, fill="' '"):
    return f"lpad({text(t)}, greatest({n}, 0), {fill})"


@rule
def rpad(t, n, fill="' '"):
    return f"rpad({text(t)}, greatest({n}, 0), {fill})"


@rule
def starts_with(t, p):
    return flag(f"startswith({text(t)}, {p})")


@rule
def ends_with(t, p):
    return flag(f"endswith({text(t)}, {p})")


@rule
def encode_hex(t):
    return f"lower(hex({t}))"


@rule
def char_length(t):
    return f"char_length({text(t)})"


@rule
def octet_length(t):
    return f"octet_length({t})"


@rule
def initcap(t):
    """The first letter after the start, white space, _ or - in upper case, others in lower case."""
    return f"array_join(transform(regexp_extract_all({text(t)}, '[^\\\\s_-]+|[\\\\s_-]', 0), w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), '')"


@rule
def translate(t, a, b):
    return f"if(char_length({a}) = char_length({b}), translate({text(t)}, {a}, {b}), raise_error('TRANSLATE needs lists of one length'))"


@rule
def string_escape(t, kind="'json'"):
    if (unquote(kind) or "").lower() != "json":
        raise ValueError("STRING_ESCAPE knows the type json only")
    whole = f"to_json(named_struct('v', {text(t)}))"
    return f"(case when {t} is null then null else replace(substring({whole}, 7, char_length({whole}) - 8), '/', '\\\\/') end)"


def like_regex(pattern: str) -> str:
    """A regular expression for a LIKE pattern with classes, unanchored where it starts or ends with %."""
    start, end = not pattern.startswith("%"), not pattern.endswith("%")
    out, i, p = "", 0, pattern.strip("%") if len(pattern) > 1 else pattern
    while i < len(p):
        c = p[i]
        if c == "[" and (close := p.find("]", i + 2)) > 0:
            out += "[" + p[i + 1 : close].replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"%": ".*?", "_": "."}.get(c) or re.escape(c)
        i += 1
    return "(?is)" + "^" * start + out + "$" * end


@rule
def patindex(p, t):
    v = unquote(p)
    if v is None:
        raise ValueError("a PATINDEX pattern must be a literal")
    r = like_regex(v)
    before = quote("(?is)^(.*?)(?:" + r[5:].lstrip("^") + ")") if not r.startswith("(?is)^") else quote("^()")
    return f"(case when {t} is null then null when {text(t)} rlike {quote(r)} then char_length(regexp_extract({text(t)}, {before}, 1)) + 1 else 0 end)"


@rule
def charindex(a, t, start="1"):
    return f"locate({a}, {text(t)}, greatest({start}, 1))"


FUNCTIONS["locate"] = charindex


@rule
def instr(t, a):
    return f"instr({text(t)}, {a})"


@rule
def strpos(t, a):
    return f"instr({text(t)}, {a})"


@rule
def unistr(t):
    return f"ls_unistr({t})"


@rule
def regexp_like(t, p, flags=None):
    return flag(f"{text(t)} rlike {_pattern(p, flags)}")


@rule
def regexp_count(t, p, start="1", flags=None):
    return f"regexp_count(substring({text(t)}, {start}), {_pattern(p, flags)})"


@rule
def regexp_substr(t, p, start="1", occurrence="1", flags=None, group="0"):
    found = f"regexp_extract_all(substring({text(t)}, {start}), {_pattern(p, flags)}, {group})"
    return f"get({found}, {occurrence} - 1)"


@rule
def regexp_instr(t, p, start="1", occurrence="1", end="0", flags=None, group="0"):
    if (start, occurrence, end, flags, group) == ("1", "1", "0", None, "0"):
        return f"regexp_instr({text(t)}, {p})"
    return f"ls_regexp_instr({text(t)}, {_pattern(p, flags)}, {start}, {occurrence}, {end}, {group})"


@rule
def regexp_replace(t, p, r="''", start="1", occurrence="0", flags=None):
    v = unquote(r)
    if v is None:
        raise ValueError("a REGEXP_REPLACE replacement must be a literal")
    java = quote(re.sub(r"\\(\d)", r"$\1", v))
    if occurrence == "0":
        return f"regexp_replace({text(t)}, {_pattern(p, flags)}, {java}, {start})" if start != "1" else f"regexp_replace({text(t)}, {_pattern(p, flags)}, {java})"
    return f"ls_regexp_replace({text(t)}, {_pattern(p, flags)}, {quote(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], v))}, {start}, {occurrence})"


@rule
def parsename(t, i):
    return f"ls_parsename({text(t)}, {i})"


@rule
def quotename(t, q="'['"):
    pair = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", "<": "<>", "{": "{}", "`": "``"}.get(unquote(q) or "")
    if not pair:
        raise ValueError("QUOTENAME knows the quotes [ ' \" ( < { and `")
    return f"concat({quote(pair[0])}, replace({text(t)}, {quote(pair[1])}, {quote(pair[1] * 2)}), {quote(pair[1])})"


@rule
def stuff(t, start, n, new):
    return f"(case when {start} < 1 or {start} > char_length({text(t)}) or {n} < 0 then null else concat(substring({text(t)}, 1, {start} - 1), coalesce({new}, ''), substring({text(t)}, {start} + {n})) end)"


@rule
def space(n):
    return f"repeat(' ', greatest({n}, 0))"


@rule
def datalength(t):
    return f"char_length({text(t)})"


@rule
def unicode(t):
    return f"ascii({text(t)})"


@rule
def nchar(n):
    return f"decode(unhex(lpad(hex(cast({n} as bigint)), 8, '0')), 'UTF-32')"


FUNCTIONS["char"] = FUNCTIONS["chr"] = nchar


@rule
def concat(*args):
    """Null counts as empty."""
    return f"concat_ws('', {', '.join(map(text, args))})"


@rule
def concat_strict(*args):
    return f"concat({', '.join(map(text, args))})"


@rule
def concat_ws(sep, *args):
    return f"concat_ws({sep}, {', '.join(map(text, args))})"


@rule
def typeof(x):
    kinds = {"null": ["void"], "integer": ["tinyint", "smallint", "int", "bigint", "boolean"], "real": ["float", "double"], "blob": ["binary"]}
    cases = " ".join(f"when typeof({x}) in ({', '.join(map(quote, v))}) then '{k}'" for k, v in kinds.items())
    return f"(case when {x} is null then 'null' {cases} when typeof({x}) like 'decimal%' then 'real' else 'text' end)"


@rule
def substr(t, start, n=None):
    return f"substring({text(t)}, {start}{'' if n is None else f', {n}'})"


FUNCTIONS["substring"] = FUNCTIONS["mid"] = substr


@rule
def lcase(t):
    return f"lower({text(t)})"


@rule
def ucase(t):
    return f"upper({text(t)})"
