"""JSON functions over text."""

from __future__ import annotations

from .strings import quote, text, unquote

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__.rstrip("_")] = f
    return f


@rule
def json_valid(j):
    return f"cast(try_parse_json({text(j)}) is not null as int)"


FUNCTIONS["isjson"] = FUNCTIONS["json_valid_strict"] = json_valid


@rule
def json_extract(j, *paths):
    if len(paths) == 1:
        return f"get_json_object({text(j)}, {paths[0]})"
    return f"to_json(array({', '.join(f'get_json_object({text(j)}, {p})' for p in paths)}))"


FUNCTIONS["json_query"] = lambda j, p="'$'": json_extract(j, p)


@rule
def json_value(j, p="'$'"):
    """A scalar as text; truth values as 1 and 0."""
    v = json_extract(j, p)
    kind = f"schema_of_variant(try_variant_get(try_parse_json({text(j)}), {p}, 'variant'))"
    return f"(case when {v} in ('true', 'false') and {kind} = 'BOOLEAN' then if({v} = 'true', '1', '0') else {v} end)"


@rule
def json_get(j, key):
    """The value under a key or index, as JSON text's value."""
    v = unquote(key)
    path = f"$[{key}]" if v is None else v if v.startswith("$") else f"$.{v}"
    return f"get_json_object({text(j)}, {quote(path)})"


@rule
def json_unquote(j):
    return f"coalesce(get_json_object({text(j)}, '$'), {text(j)})"


@rule
def json_path_exists(j, p):
    return f"cast(get_json_object({text(j)}, {p}) is not null as int)"


@rule
def json_keys(j):
    return f"to_json(array_sort(json_object_keys({text(j)})))"


@rule
def json_array_length(j):
    return f"json_array_length({text(j)})"


@rule
def json_object_length(j):
    return f"size(json_object_keys({text(j)}))"


@rule
def json_typeof(j):
    s = f"schema_of_variant(try_parse_json({text(j)}))"
    return f"(case when {s} = 'VOID' then 'null' when {s} like 'OBJECT%' then 'object' when {s} like 'ARRAY%' then 'array' when {s} = 'STRING' then 'string' when {s} = 'BOOLEAN' then 'boolean' when {s} is not null then 'number' end)"


FUNCTIONS["json_type"] = json_typeof


@rule
def json_array(*a):
    return f"concat('[', array_join(transform(array({', '.join(f'to_json(named_struct({quote(chr(118))}, {x}))' for x in a)}), s -> if(s = '{{}}', 'null', substring(s, 6, char_length(s) - 6))), ','), ']')"


@rule
def json_object(*a):
    """Key and value in turn; keys are literals."""
    pairs = ", ".join(f"{k}, {v}" for k, v in zip(a[::2], a[1::2], strict=True))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))"


FUNCTIONS["json_build_object"] = FUNCTIONS["jsonb_build_object"] = json_object

for _name, _udf in {"json_pretty": "ls_json_pretty", "json_merge_patch": "ls_json_merge_patch", "json_contains": "ls_json_contains", "json_strip_nulls": "ls_json_strip_nulls", "json_modify": "ls_json_set", "json_set": "ls_json_set", "json_insert": "ls_json_insert", "json_replace": "ls_json_replace", "json_remove": "ls_json_remove", "json_minify": "ls_json_minify", "json": "ls_json_minify", "json_quote": "ls_json_quote", "json_depth": "ls_json_depth", "json_length_deep": "ls_json_length_deep"}.items():
    FUNCTIONS[_name] = lambda *a, u=_udf: f"{u}({', '.join(text(x) for x in a)})"
FUNCTIONS["json_patch"] = FUNCTIONS["json_merge_patch"]
