"""Changes of tables as DataFrame pipelines: each gives the new table; the caller writes it.

Keys of the source are taken to be few rows a key; joins are equi-joins on the key columns, so that
Catalyst can broadcast a small source or sort-merge a large one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lexer import DialectError


def insert(target: DataFrame, source: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """The target and the source's rows; columns that the source lacks get their default (a SQL text) or null."""
    defaults = defaults or {}
    extra = set(source.columns) - set(target.columns)
    if extra:
        raise DialectError(f"no such columns: {sorted(extra)}")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in source.columns else F.expr(defaults.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in target.schema]
    return target.unionByName(source.select(*columns))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: dict[str, str] | Sequence[str] | None = None, nothing: bool = False) -> DataFrame:
    """INSERT .. ON CONFLICT (keys) DO UPDATE or DO NOTHING.

    ``update`` names columns to take from the source (default: all others), or maps columns to SQL
    texts over ``old`` and ``new``. Of source rows with one key any single one counts; pass a source without repeats.
    """
    source = source.dropDuplicates(list(keys))
    old, new = target.alias("old"), source.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = old.join(new, on, "full")
    here, there = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()
    rules = update if isinstance(update, dict) else {c: f"new.{c}" for c in (update or [c for c in source.columns if c not in keys])}
    out = []
    for f in target.schema:
        fresh = F.col(f"new.{f.name}").cast(f.dataType) if f.name in source.columns else F.lit(None).cast(f.dataType)
        held = F.col(f"old.{f.name}")
        changed = F.expr(rules[f.name]).cast(f.dataType) if f.name in rules and not nothing else held
        out.append(F.when(here & there, changed).when(here, held).otherwise(fresh).alias(f.name))
    return both.select(*out)


def update(target: DataFrame, values: dict[str, str], where: str | Column | None = None) -> DataFrame:
    """UPDATE target SET .. WHERE ..: rows for which the condition isn't true stay as they are."""
    cond = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    hit = F.coalesce(cond, F.lit(False))
    return target.select(*(F.when(hit, F.expr(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in target.schema))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], values: dict[str, str], where: str | None = None) -> DataFrame:
    """UPDATE .. FROM a source with at most one row a key; texts are over ``t`` and ``s``."""
    both = target.alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left")
    hit = F.coalesce(F.col("s.__hit") & (F.expr(where) if where else F.lit(True)), F.lit(False))
    return both.select(*(F.when(hit, F.expr(values[f.name]).cast(f.dataType)).otherwise(F.col(f"t.{f.name}")).alias(f.name) if f.name in values else F.col(f"t.{f.name}") for f in target.schema))


def delete(target: DataFrame, where: str | Column | None = None) -> DataFrame:
    """DELETE: rows go for which the condition is true."""
    if where is None:
        return target.limit(0)
    cond = F.expr(where) if isinstance(where, str) else where
    return target.filter(~F.coalesce(cond, F.lit(False)))


def delete_matching(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DELETE .. FROM .. JOIN on keys."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns)


def delete_top(target: DataFrame, n: int, order: Sequence[str], key: str, where: str | None = None) -> DataFrame:
    """DELETE TOP (n) in an order, by a unique key."""
    chosen = (target.filter(where) if where else target).orderBy(*order).limit(n).select(key)
    return target.join(F.broadcast(chosen) if n <= 100_000 else chosen, key, "left_anti").select(*target.columns)


@dataclass
class When:
    """A clause of MERGE. kind: matched, not_matched or not_matched_by_source; action: update, delete or insert."""

    kind: str
    action: str
    values: dict[str, str] = field(default_factory=dict)
    condition: str | None = None


def merge(target: DataFrame, source: DataFrame, on: str | Sequence[str], clauses: Sequence[When], with_action: bool = False) -> DataFrame:
    """MERGE INTO target USING source: the new target, by one full outer join.

    ``on`` is key columns or a condition over ``t`` and ``s``; texts of clauses are over the same. The
    first clause of a kind whose condition is true decides. ``with_action`` keeps deleted rows and adds
    ``merge_action`` (INSERT, UPDATE, DELETE or null), as an OUTPUT clause would show it. Rows of the
    source that match one target row more than once are an error, as they would change it twice.
    """
    t, s = target.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    cond = F.expr(on) if isinstance(on, str) else [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
    if isinstance(on, str):
        # whether a target row is met twice is seen by its number; rows without one are spread
        t = target.withColumn("__t", F.lit(True)).withColumn("__at", F.monotonically_increasing_id()).alias("t")
        both = t.join(s, cond, "full").withColumn("__at", F.coalesce("t.__at", -1 - F.monotonically_increasing_id()))
        both = both.withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy("__at")))
    else:
        # the same partitioning as that of the join: no further shuffle
        s = source.withColumn("__s", F.lit(True)).withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy(*on))).alias("s")
        both = t.join(s, cond, "full").withColumn("__times", F.coalesce("s.__times", F.lit(1)))
    kinds = {"matched": F.col("t.__t") & F.col("s.__s"), "not_matched": F.col("t.__t").isNull(), "not_matched_by_source": F.col("s.__s").isNull()}
    chosen = F.lit(None).cast("int")
    for i in reversed(range(len(clauses))):
        c = clauses[i]
        hit = kinds[c.kind] & (F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True))
        chosen = F.when(F.coalesce(hit, F.lit(False)), F.lit(i)).otherwise(chosen)
    twice = kinds["matched"] & (F.col("__times") > 1) & chosen.isNotNull()
    both = both.withColumn("__clause", F.when(twice, F.raise_error(F.lit("MERGE would change a row more than once")).cast("int")).otherwise(chosen))
    columns = []
    for f in target.schema:
        value = F.col(f"t.{f.name}")
        for i, c in enumerate(clauses):
            if c.action in ("update", "insert") and (f.name in c.values or c.action == "insert"):
                new = F.expr(c.values[f.name]) if f.name in c.values else F.lit(None)
                value = F.when(F.col("__clause") == i, new.cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    action = F.lit(None).cast("string")
    for i, c in enumerate(clauses):
        action = F.when(F.col("__clause") == i, F.lit(c.action.upper())).otherwise(action)
    out = both.filter(F.col("t.__t").isNotNull() | F.col("__clause").isNotNull()).select(*columns, action.alias("merge_action"))
    if with_action:
        return out
    return out.filter(~F.col("merge_action").eqNullSafe("DELETE")).drop("merge_action")


def violations(df: DataFrame, unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (), checks: dict[str, str] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, n) of the constraints that rows break: unique keys, NOT NULL, CHECK and foreign keys."""
    parts = []
    for keys in unique:
        bad = df.filter(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)).groupBy(*keys).count().filter("count > 1")
        parts.append(bad.agg(F.lit(f"unique({', '.join(keys)})").alias("rule"), F.count(F.lit(1)).alias("n")))
    rules = {f"not null {c}": F.col(c).isNull() for c in not_null} | {f"check {k}": ~F.coalesce(F.expr(v), F.lit(True)) for k, v in (checks or {}).items()}
    if rules:
        counted = df.agg(*(F.sum(bad.cast("long")).alias(k) for k, bad in rules.items()))
        parts.append(counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("n")) for k in rules))).alias("x")).select("x.rule", "x.n"))
    for column, (parent, key) in (references or {}).items():
        bad = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")).distinct(), F.col(column) == F.col("__key"), "left_anti")
        parts.append(bad.agg(F.lit(f"references {column}").alias("rule"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")
