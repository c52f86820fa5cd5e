"""Aggregate functions; those of the standard keep their names."""

from __future__ import annotations

FUNCTIONS = {}


def rule(f):
    FUNCTIONS[f.__name__] = f
    return f


@rule
def total(x):
    return f"coalesce(sum(cast({x} as double)), 0D)"


@rule
def count_big(x):
    return f"count({x})"


@rule
def approx_count_distinct(x):
    """Exact."""
    return f"count(distinct {x})"


@rule
def string_agg(x, sep="','"):
    return f"listagg(cast({x} as string), {sep})"


@rule
def group_concat(x, sep="','"):
    return f"listagg(cast({x} as string), {sep})"


@rule
def json_agg(x):
    """JSON array of all values, nulls too."""
    return f"(case when count(1) > 0 then to_json(transform(collect_list(struct({x} as v)), s -> s.v)) end)"


FUNCTIONS["array_agg"] = FUNCTIONS["json_group_array"] = FUNCTIONS["json_arrayagg"] = FUNCTIONS["jsonb_agg"] = json_agg


@rule
def json_object_agg(k, v):
    """JSON object in the order of keys."""
    return f"to_json(map_from_entries(array_sort(collect_list(struct(cast({k} as string) as k, {v} as v)))), map('ignoreNullFields', 'false'))"


FUNCTIONS["json_group_object"] = FUNCTIONS["json_objectagg"] = FUNCTIONS["jsonb_object_agg"] = json_object_agg


@rule
def bool_and(x):
    return f"cast(bool_and(cast({x} as boolean)) as int)"


FUNCTIONS["every"] = bool_and


@rule
def bool_or(x):
    return f"cast(bool_or(cast({x} as boolean)) as int)"


@rule
def stdev(x):
    return f"stddev_samp({x})"


@rule
def stdevp(x):
    return f"stddev_pop({x})"


@rule
def var(x):
    return f"var_samp({x})"


@rule
def varp(x):
    return f"var_pop({x})"


@rule
def product(x):
    """Product of the non-null values; null for none."""
    v = f"cast({x} as double)"
    zero, odd = f"max(cast({v} = 0 as int))", f"sum(cast({v} < 0 as int)) % 2"
    return f"(case when count({v}) = 0 then null when {zero} = 1 then 0D else exp(sum(ln(nullif(abs({v}), 0)))) * if({odd} = 1, -1, 1) end)"


@rule
def checksum_agg(x):
    return f"coalesce(bit_xor(cast({x} as int)), 0)"


@rule
def percentile_cont(p, x, descending="0"):
    return f"percentile_cont({p}) within group (order by {x}{' desc' if descending != '0' else ''})"


@rule
def percentile_disc(p, x, descending="0"):
    return f"percentile_disc({p}) within group (order by {x}{' desc' if descending != '0' else ''})"


FUNCTIONS["approx_percentile_cont"], FUNCTIONS["approx_percentile_disc"] = percentile_cont, percentile_disc
