"""Relational operators beyond the plain DataFrame methods."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of one group that a task ranks by itself, and keys that are broadcast.
RANKED_AT_ONCE, KEYS_TO_ALL = 250_000, 100_000


class ResultTooLarge(ValueError):
    """A result has more rows than its reader allows; it is never cut."""


def limited(df: DataFrame, max_rows: int) -> list:
    """The rows, or ResultTooLarge: at most ``max_rows + 1`` rows are ever fetched."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ResultTooLarge(f"more than {max_rows} rows")
    return rows


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """``value`` from start to stop, both included; generated on the executors."""
    if step == 0:
        raise ValueError("the step must not be 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def string_split(df: DataFrame, column: str, sep: str, outer: bool = False) -> DataFrame:
    """Each row with ``value`` and ``ordinal`` of the parts of a column; empty parts stay."""
    if not sep:
        raise ValueError("the separator must not be empty")
    explode = F.posexplode_outer if outer else F.posexplode
    parts = F.split(F.col(column), "\\Q" + sep + "\\E", -1)
    return df.select("*", explode(parts).alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal") + 1)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark prunes with a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, agg: Column) -> DataFrame:
    """A column per value; the values are given, so no pass over the data is needed to find them."""
    return df.groupBy(*by).pivot(column, list(values)).agg(agg)


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "name", value: str = "value", keep_all: bool = True) -> DataFrame:
    """A row per non-null value of the columns; other columns stay, the unpivoted ones too if ``keep_all``."""
    kept = df.columns if keep_all else [c for c in df.columns if c not in columns]
    pairs = F.array(*(F.struct(F.col(c).alias(value), F.lit(c).alias(name)) for c in columns))
    return df.select(*kept, F.inline(F.filter(pairs, lambda p: p[value].isNotNull())))


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the named columns of the last right row of its key at or before it.

    One shuffle by key of the union of both sides, and a running last value: no pairs are formed.
    Left rows without a key or time find nothing; right rows without them are not found.
    """
    prefix = "__r_"
    right = right.dropna(subset=[*by, right_on])
    l = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias(prefix))  # noqa: E741
    r = right.select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__row"), F.struct(*columns).alias(prefix))
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = l.unionByName(r).withColumn(prefix, F.last(prefix, ignorenulls=True).over(w)).filter("__side = 1")
    found = found.withColumn(prefix, F.when(F.col("__at").isNotNull(), F.col(prefix)))
    return found.select("__row.*", *(F.col(f"{prefix}.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns))


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points within spans (start <= point <= end) by equal bins of ``width`` instead of a nested loop.

    A span is copied to the bins it touches; pick ``width`` near the spans' usual length.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    binned = spans.withColumn("__bin", F.explode(F.sequence(cell(start), cell(end))))
    both = points.withColumn("__bin", cell(point)).join(binned, "__bin")
    return both.filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("__bin")


def groups_frame(df: DataFrame, by: Sequence[str], order: str, agg: Column, preceding: int, following: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers of the order column count as one step."""
    step = Window.partitionBy(*by).orderBy(order)
    frame = Window.partitionBy(*by).orderBy("__peer").rangeBetween(-preceding, following)
    return df.withColumn("__peer", F.dense_rank().over(step)).withColumn(name, agg.over(frame)).drop("__peer")


def sum_excluding_current(column: str, window) -> Column:
    """SUM over a frame that contains the row, EXCLUDE CURRENT ROW."""
    return F.sum(column).over(window) - F.coalesce(F.col(column), F.lit(0))


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "cosine_similarity") -> DataFrame:
    """The k best rows for a query vector with ``score``: an exact scan, top k of each task, then of all."""
    from .. import functions as fn

    literal = "array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")"
    best = F.col("score").asc() if "distance" in metric else F.col("score").desc()
    return df.withColumn("score", fn.call(f"vector_{metric}", vector, literal)).orderBy(best, *[c for c in df.columns if c != vector][:1]).limit(k)


def nearest_each(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, metric: str = "cosine_similarity", block: int = 1 << 21) -> DataFrame:
    """The k best rows (``id_col``, ``score``, ``rank``) for each of the query rows (``query_id``, ``query``).

    Rows and queries are dealt into blocks of about ``block`` numbers each; a task holds one block of rows against
    one of queries and keeps the k best rows a query, so that only those are shuffled. A vector of length 0 has no
    direction: its cosine is NaN, which comes before all numbers, as in SQL.
    """
    from .nearest import METRICS, best

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    side = max(1, block // max(width or 1, 1))
    # small tables too are dealt to several tasks
    cells, parts = max(-(-rows // side), min(24, -(-rows // 1024)), 1), max(-(-queries.count() // side), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    table = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).withColumn("cell", of(cells, "id", "vector")).withColumn("part", every(parts))
    asked = queries.select("query_id", "query").withColumn("part", of(parts, "query_id", "query")).withColumn("cell", every(cells))
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {df.schema[id_col].dataType.simpleString()}", "score double"]
    pairs = table.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part"))
    found = pairs.applyInArrow(lambda t, q: best(t, q, k, metric), ", ".join(kinds))
    order = F.col("score").asc_nulls_last() if "distance" in metric else F.col("score").desc_nulls_last()
    ranked = Window.partitionBy("query_id").orderBy(order, "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


class Ranking(NamedTuple):
    """A ranking function over a window: ROW_NUMBER, RANK, DENSE_RANK or NTILE (of ``tiles``), by and of columns.

    ``order`` has (column, descending, nulls first or None for the usual place).
    """

    name: str
    function: str
    by: tuple[str, ...]
    order: tuple[tuple[str, bool, bool | None], ...]
    tiles: str = ""


def _sorting(order: Sequence[tuple[str, bool, bool | None]]) -> list[Column]:
    names = {(False, None): "asc", (False, True): "asc_nulls_first", (False, False): "asc_nulls_last", (True, None): "desc", (True, True): "desc_nulls_first", (True, False): "desc_nulls_last"}
    return [getattr(F.col(c), names[desc, nulls])() for c, desc, nulls in order]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's checkpoint folder; where it names none, in a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomstone-"))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ranked(df: DataFrame, rankings: Sequence[Ranking], most: int = RANKED_AT_ONCE) -> DataFrame:
    """The rows with a column for each ranking; no task ranks more than about ``most`` rows of a group.

    Windows of small groups are Spark's. For those of larger ones the distinct keys are counted and dealt by ranges,
    a key's rank is its place in its range and what the ranges before it hold, and rows find theirs by a join.
    """
    largest = {by: df.groupBy(*[F.pmod(F.xxhash64(*by), F.lit(1 << 16))][: len(by)]).count().agg(F.max("count")).first()[0] or 0 for by in {r.by for r in rankings}}
    large: dict[tuple, list[Ranking]] = {}
    for r in rankings:
        if largest[r.by] > most:
            large.setdefault((r.by, r.order), []).append(r)
        else:
            function = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}.get(r.function) or (lambda n=r.tiles: F.ntile(int(n)))
            df = df.withColumn(r.name, function().over(Window.partitionBy(*r.by).orderBy(*_sorting(r.order))))
    plain = [c for c in df.columns if c not in {r.name for r in rankings}]
    for (by, order), of in large.items():
        df = _ranked_by_ranges(df, by, order, of, most, plain)
    return df


def _ranked_by_ranges(df: DataFrame, by: tuple, order: tuple, rankings: list[Ranking], most: int, plain: list[str]) -> DataFrame:
    numbered = any(r.function in ("ROW_NUMBER", "NTILE") for r in rankings)
    spark, ties, keep = df.sparkSession, 1, df.columns
    while True:
        keys = list(dict.fromkeys([*by, *(c for c, _, _ in order)]))
        rows, kinds = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
        parts = -(-rows // most)
        # many keys are dealt out first: their counts would fill the memory of a task that reads
        counts = (df.select(*keys) if kinds <= KEYS_TO_ALL else df.select(*keys).repartition(parts, *keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        path = shared_path(spark, "ranks")
        counts.repartitionByRange(parts, *by, *_sorting(order)).withColumn("__part", F.spark_partition_id()).write.parquet(path)
        dealt = spark.read.parquet(path)
        found, ties = dealt.agg(F.count(F.lit(1)), F.max("__n")).first()
        if not numbered or ties <= most or order[-1][0] == "__tie":
            break
        # rows that the order leaves equal are told apart by a hash
        df, order = df.withColumn("__tie", F.xxhash64(*plain)), (*order, ("__tie", False, None))
        rankings, apart = [r for r in rankings if r.function in ("ROW_NUMBER", "NTILE")], [r for r in rankings if r.function in ("RANK", "DENSE_RANK")]
        if apart:
            df, keep = _ranked_by_ranges(df, by, order[:-1], apart, most, plain), [*keep, *(r.name for r in apart)]
    local = Window.partitionBy("__part", *by).orderBy(*_sorting(order))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumn("__before", F.sum("__n").over(local.rowsBetween(*so_far)) - F.col("__n")).withColumn("__peer", F.row_number().over(local))
    ranges = Window.partitionBy(*by)
    total = dealt.groupBy("__part", *by).agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__peers"))
    total = total.select(
        F.col("__part").alias("__at"),
        *(F.col(c).alias(f"__b{i}") for i, c in enumerate(by)),
        *((F.sum(c).over(ranges.orderBy("__part").rowsBetween(*so_far)) - F.col(c)).alias(n) for c, n in (("__rows", "__rows_before"), ("__peers", "__peers_before"))),
        F.sum("__rows").over(ranges).alias("__all"),
    )
    same = F.col("__part") == F.col("__at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__b{i}"))
    places = inner.join(total, same).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), (F.col("__before") + F.col("__rows_before") + 1).alias("__rank"), (F.col("__peer") + F.col("__peers_before")).alias("__dense"), "__all")
    places = F.broadcast(places) if found <= KEYS_TO_ALL else places
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = df.join(places, same, "left")
    at = F.col("__rank")
    if numbered and ties > 1:
        at += F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1
    for r in rankings:
        value = at
        if r.function == "RANK":
            value = F.col("__rank")
        elif r.function == "DENSE_RANK":
            value = F.col("__dense")
        elif r.function == "NTILE":
            n, each = F.lit(int(r.tiles)), F.floor(F.col("__all") / F.lit(int(r.tiles)))
            more = F.col("__all") % n
            wide = more * (each + 1)
            value = F.when(at <= wide, F.floor((at - 1) / (each + 1))).otherwise(more + F.floor((at - 1 - wide) / each)) + 1
        out = out.withColumn(r.name, value.cast("int"))
    return out.select(*keep, *(r.name for r in rankings))


def graph_match(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (a, e, b) of a one-edge pattern: node a, edge e (from_id, to_id), node b."""
    a, e, b = nodes.alias("a"), edges.alias("e"), nodes.alias("b")
    hit = a.join(e, F.col("a.node_id") == F.col("e.from_id")).join(b, F.col("b.node_id") == F.col("e.to_id"))
    return hit.select(F.struct("a.*").alias("a"), F.struct("e.*").alias("e"), F.struct("b.*").alias("b"))


def sharded_top(df: DataFrame, shard: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows over all shards, ties by shard; adds ``shard``. No shard is sorted as a whole."""
    return df.withColumn("shard", shard).orderBy(*order, "shard").limit(n)


def left_to_right(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """Set operations of equal precedence: union, union all, intersect, except."""
    out = first
    for op, df in rest:
        out = {"union": lambda a, b: a.union(b).distinct(), "union all": lambda a, b: a.unionAll(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[op](out, df)
    return out


def hierarchy(df: DataFrame, key: str, parent: str, max_depth: int = 1000) -> DataFrame:
    """Each node with ``depth`` and ``root``, from the roots (null parents) down, by a recursive query."""
    view = f"__tree_{abs(hash((key, parent))) % 10**8}"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(
        f"WITH RECURSIVE walk(node, depth, root) MAX RECURSION LEVEL {max_depth} AS (SELECT `{key}`, 0, `{key}` FROM {view} WHERE `{parent}` IS NULL UNION ALL SELECT c.`{key}`, w.depth + 1, w.root FROM {view} c JOIN walk w ON c.`{parent}` = w.node) SELECT * FROM walk"
    )
