"""Exact vector functions over arrays, or over text of a JSON array or of comma-separated numbers.

Vectors of unequal or no dimensions give null.
"""

from __future__ import annotations

from .strings import text

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__] = f
    return f


def parsed(v: str) -> str:
    """The array of a vector given as text."""
    return f"from_json(concat('[', regexp_replace({text(v)}, '[\\\\[\\\\]]', ''), ']'), 'array<double>')"


def _fold(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def _ok(a: str, b: str, out: str) -> str:
    return f"(case when size({a}) = size({b}) and size({a}) > 0 then {out} end)"


def _arg(v: str) -> str:
    return parsed(v) if v.strip().startswith("'") else v


@rule
def vector_dot_product(a, b):
    a, b = _arg(a), _arg(b)
    return _ok(a, b, _fold(a, b))


@rule
def vector_cosine_similarity(a, b):
    a, b = _arg(a), _arg(b)
    norms = f"sqrt({_fold(a, a)}) * sqrt({_fold(b, b)})"
    return _ok(a, b, f"coalesce(greatest(-1D, least(1D, try_divide({_fold(a, b)}, {norms}))), 0D)")


@rule
def vector_cosine_distance(a, b):
    return f"(1D - {vector_cosine_similarity(a, b)})"


@rule
def vector_l2_distance(a, b):
    a, b = _arg(a), _arg(b)
    return _ok(a, b, f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> pow(cast(x as double) - cast(y as double), 2)), 0D, (s, x) -> s + x))")


@rule
def vector_norm(a):
    a = _arg(a)
    return f"(case when size({a}) > 0 then sqrt({_fold(a, a)}) end)"


@rule
def vector_dim(a):
    return f"size({_arg(a)})"


@rule
def vector_normalize(a):
    a = _arg(a)
    return f"transform({a}, x -> coalesce(try_divide(cast(x as double), sqrt({_fold(a, a)})), 0D))"


@rule
def vector_to_blob(a):
    return f"ls_vector_to_blob(transform({_arg(a)}, x -> cast(x as double)))"


@rule
def vector_from_blob(b):
    return f"ls_vector_from_blob({b})"
