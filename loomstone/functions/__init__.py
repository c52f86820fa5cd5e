"""The function library.

A function is a rule that turns the SQL texts of its arguments into the SQL text of a Spark
expression, so that calls end up as built-in expressions inside Catalyst, whatever the argument
types. ``call`` makes a Column of it; the dialect front-ends use the same rules. What no built-in
can express is an Arrow-batched pandas UDF, registered by ``register``.

Null arguments give null, numbers are cast to text where text is wanted, truth values are 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import aggregates, crypto, datetimes, jsons, maths, strings, udfs, vectors

FUNCTIONS = {**strings.FUNCTIONS, **datetimes.FUNCTIONS, **maths.FUNCTIONS, **jsons.FUNCTIONS, **crypto.FUNCTIONS, **vectors.FUNCTIONS, **aggregates.FUNCTIONS}


def sql(name: str, *args: str) -> str:
    """The Spark SQL text of a call; arguments are SQL texts."""
    try:
        rule = FUNCTIONS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown function {name}") from None
    return rule(*args)


def call(name: str, *args) -> Column:
    """A Column for a call; arguments are column names or SQL texts, or Python numbers."""
    return F.expr(sql(name, *(a if isinstance(a, str) else repr(a) for a in args)))


def register(spark: SparkSession) -> None:
    """Register the pandas UDFs that some functions need."""
    udfs.register(spark)
