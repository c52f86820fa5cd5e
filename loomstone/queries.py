"""The registered queries of the engine's own operators, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .engine import Engine
from .operators import mutations, relational, sharding
from .plans.dialect import select
from .sources import files
from .streaming import changes, windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(name: str, oracle: str | None):
    """Registers a query written with DataFrames: f(read), where read(table) gives a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: _read(spark, sf_dir, table))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def text(name: str, sql: str, oracle: str | None = None, dialect: str = "tsql", udfs: bool = False) -> None:
    """Registers a query of a dialect; the oracle is the text itself where DuckDB reads it alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = sql.lower()
        for t in TABLES:
            if t in low:
                _read(spark, sf_dir, t).createOrReplaceTempView(t)
        if udfs:
            fn.register(spark)
        return select(spark, sql, dialect)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


def calls(name: str, exprs: dict[str, tuple[str, str]], dialect: str = "tsql", table: str = "region", udfs: bool = False) -> None:
    """Registers calls of functions, a column each: its text in the dialect and in the comparison SQL."""
    columns, wanted = (", ".join(f"{e[k]} AS {alias}" for alias, e in exprs.items()) for k in (0, 1))
    text(name, f"SELECT {columns} FROM {table}", f"SELECT {wanted} FROM {table}", dialect, udfs)


def scripted(name: str, sql: str, oracle: str, tables: tuple[str, ...], dialect: str = "tsql") -> None:
    """Registers a script over tables; its last result is the query's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.open(spark, sf_dir, list(tables)).run(sql, dialect).results[-1]

    QUERIES[name], ORACLE_SQL[name] = run, oracle


# ---- the flagship and other aggregates

text(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    dialect="postgres",
)
text("range_group_by", "SELECT o_custkey % 100 AS grp, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 0 AND 9000000000 GROUP BY o_custkey % 100")
text("full_group_by", "SELECT l_suppkey, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_suppkey")
text("aggregate_null_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, COALESCE(SUM(l_quantity), 0.0) AS t, MIN(l_tax) AS mi, MAX(l_tax) AS ma FROM lineitem WHERE l_quantity < 0")
text("having", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 3")
text("mysql_having_without_group", "SELECT c_custkey, c_acctbal FROM customer HAVING c_acctbal > 5000", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000", dialect="mysql")
text("count_distinct_exact", "SELECT APPROX_COUNT_DISTINCT(o_custkey) AS k, COUNT_BIG(*) AS n FROM orders", "SELECT COUNT(DISTINCT o_custkey) AS k, COUNT(*) AS n FROM orders")
text("filter_clause", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY o_orderpriority")
text("string_agg_ordered", "SELECT n_regionkey, STRING_AGG(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
text("group_concat_distinct", "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment ORDER BY c_mktsegment SEPARATOR '|') AS segments FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey", dialect="mysql")
text("variance_family", "SELECT l_returnflag, ROUND(STDEV(l_quantity), 6) AS sd, ROUND(STDEVP(l_quantity), 6) AS sdp, ROUND(VAR(l_quantity), 6) AS v, ROUND(VARP(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(stddev_samp(l_quantity), 6) AS sd, ROUND(stddev_pop(l_quantity), 6) AS sdp, ROUND(var_samp(l_quantity), 6) AS v, ROUND(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag")
text("percentiles", "SELECT l_returnflag, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, PERCENTILE_DISC(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, APPROX_PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p25 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag")
text("percentile_over", "SELECT DISTINCT c_nationkey, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS med FROM customer", "SELECT c_nationkey, ROUND(quantile_cont(c_acctbal, 0.5), 4) AS med FROM customer GROUP BY c_nationkey")
text("bit_and_bool_aggregates", "SELECT n_regionkey, BIT_AND(n_nationkey) AS ba, BIT_OR(n_nationkey) AS bo, BIT_XOR(n_nationkey) AS bx, BOOL_AND(n_nationkey > 2) AS al, BOOL_OR(n_nationkey > 20) AS an, CHECKSUM_AGG(CAST(n_nationkey AS INT)) AS cs FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx, CAST(bool_and(n_nationkey > 2) AS INT) AS al, CAST(bool_or(n_nationkey > 20) AS INT) AS an, bit_xor(n_nationkey) AS cs FROM nation GROUP BY n_regionkey")
text("product_aggregate", "SELECT n_regionkey, ROUND(PRODUCT(n_nationkey + 1), 0) AS p FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, ROUND(product(n_nationkey + 1), 0) AS p FROM nation GROUP BY n_regionkey")
text("json_aggregates", "SELECT n_regionkey, JSON_OBJECT_AGG(n_name, n_nationkey) AS o FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey", dialect="postgres")
text("total_aggregate", "SELECT TOTAL(c_acctbal) AS t FROM customer WHERE c_acctbal > 1e12", "SELECT CAST(0.0 AS DOUBLE) AS t")
frame("rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n, CAST(grouping_id(n_regionkey, n_nationkey) AS BIGINT) AS g FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")(lambda read: read("nation").rollup("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")))
frame("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda read: read("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")))

# ---- filters and expressions

text("predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'O' AND l_tax IS NOT NULL")
text("like_ignores_case", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'build%' OR c_name LIKE '%_1'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%' OR c_name ILIKE '%_1'")
text("regexp_search", "SELECT p_partkey FROM part WHERE p_name REGEXP '^(red|blue) .*t$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')", dialect="mysql")
text("postgres_regex_operators", "SELECT c_custkey FROM customer WHERE c_mktsegment ~* '^b' AND c_name !~ '9$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^b', 'i') AND NOT regexp_matches(c_name, '9$')", dialect="postgres")
text("glob_match", "SELECT c_custkey FROM customer WHERE c_mktsegment GLOB 'B*[GN]'", "SELECT c_custkey FROM customer WHERE c_mktsegment GLOB 'B*[GN]'")
text("is_distinct_from", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'", dialect="postgres")
text("case_iif_choose", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, IIF(o_orderstatus = 'F', 1, 0) AS f, CHOOSE(o_orderkey % 3 + 1, 'a', 'b') AS c, NULLIF(o_orderstatus, 'O') AS z FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS c, NULLIF(o_orderstatus, 'O') AS z FROM orders")
text("integer_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey / (o_orderkey - o_orderkey) AS z FROM orders", "SELECT o_orderkey, CAST(o_orderkey // 7 AS DOUBLE) AS q, o_orderkey % 7 AS r, CAST(NULL AS DOUBLE) AS z FROM orders")
text("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 5 AS c, ~o_orderkey AS d FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, ~o_orderkey AS d FROM orders")
text("string_plus", "SELECT n_nationkey, '<' + n_name + '>' AS s, n_name + N'!' AS t FROM nation", "SELECT n_nationkey, '<' || n_name || '>' AS s, n_name || '!' AS t FROM nation")
text("lossy_cast", "SELECT c_custkey, CAST(SUBSTRING(c_name, 10, 9) AS INT) AS a, CAST(c_mktsegment AS INT) AS z, TRY_CAST(c_mktsegment AS INT) AS t FROM customer", "SELECT c_custkey, coalesce(TRY_CAST(nullif(regexp_extract(substr(c_name, 10, 9), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS a, CAST(0 AS BIGINT) AS z, CAST(NULL AS BIGINT) AS t FROM customer")
text("try_cast_ranges", "SELECT l_orderkey, l_linenumber, TRY_CAST(l_orderkey AS TINYINT) AS ti, TRY_CAST(l_orderkey AS SMALLINT) AS si FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey BETWEEN 0 AND 255 THEN l_orderkey END AS ti, CASE WHEN l_orderkey BETWEEN -32768 AND 32767 THEN l_orderkey END AS si FROM lineitem")
text("convert_styles", "SELECT o_orderkey, CONVERT(VARCHAR(30), o_orderdate, 120) AS a, CONVERT(VARCHAR(10), o_orderdate, 101) AS b, CONVERT(VARCHAR(10), o_orderdate, 103) AS c, CONVERT(VARCHAR(8), o_orderdate, 112) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%m/%d/%Y') AS b, strftime(o_orderdate, '%d/%m/%Y') AS c, strftime(o_orderdate, '%Y%m%d') AS d FROM orders")
text("quantified_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 40 FROM customer)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(c_acctbal * 40) FROM customer)")
text("quantified_any", "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
text("number_formats", "SELECT c_custkey, FORMAT(c_acctbal, 'N2') AS n, FORMAT(c_custkey, 'D6') AS d FROM customer", "SELECT c_custkey, format('{:,.2f}', c_acctbal) AS n, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS d FROM customer")

# ---- joins

text("inner_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer INNER JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000")
text("left_join", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
text("right_full_join", "SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 10 UNION ALL SELECT r_name, n_name FROM region FULL OUTER JOIN nation ON r_regionkey = n_nationkey")
text("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
text("theta_self_join", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
text("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
text("not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
text("five_way_join", "SELECT r_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
text("cross_apply_aggregate", "SELECT c.c_custkey, x.n, x.top_price FROM customer c CROSS APPLY (SELECT COUNT(*) AS n, MAX(o.o_totalprice) AS top_price FROM orders o WHERE o.o_custkey = c.c_custkey) x", "SELECT c.c_custkey, count(o.o_orderkey) AS n, max(o.o_totalprice) AS top_price FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
text("outer_apply_top1", "SELECT c.c_custkey, x.o_orderkey FROM customer c OUTER APPLY (SELECT TOP 1 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) x", "SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) x ON x.o_custkey = c.c_custkey")


@frame("as_of_join", "SELECT e.event_id, p.value AS purchase_value FROM events e LEFT JOIN (SELECT e.event_id, p.value, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS rn FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND p.ts <= e.ts) p ON p.event_id = e.event_id AND p.rn = 1 WHERE e.event_type = 'error'")
def _as_of(read):
    e = read("events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("p_ts")).agg(F.max_by("value", "event_id").alias("value"))
    out = relational.as_of_join(left, right, ["user_id"], "ts", "p_ts", ["value"])
    return out.select("event_id", F.col("value").alias("purchase_value"))


frame("range_join", "SELECT c_custkey, b AS band FROM customer JOIN (SELECT unnest(range(-1000, 10000, 500)) AS b) ON c_acctbal >= b AND c_acctbal <= b + 499")(lambda read: relational.range_join(read("customer"), read("customer").sparkSession.range(-1000, 10000, 500).select(F.col("id").alias("band"), (F.col("id") + 499).alias("band_end")), "c_acctbal", "band", "band_end", 500.0).select("c_custkey", "band"))


@frame("graph_match", "SELECT a.n_nationkey AS a_id, b.n_nationkey AS b_id FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_nationkey = r_regionkey")
def _graph(read):
    nodes = read("nation").select(F.col("n_nationkey").alias("node_id"))
    edges = read("nation").select(F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("to_id"))
    return relational.graph_match(nodes, edges).select(F.col("a.node_id").alias("a_id"), F.col("b.node_id").alias("b_id"))


# ---- windows

text("ranking_windows", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, RANK() OVER (ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (ORDER BY o_orderpriority) AS dr, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS nt FROM orders")
text("offset_windows", "SELECT o_orderkey, LAG(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fst, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
text("frame_windows", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, MAX(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS by_range FROM orders")
text("named_window", "SELECT n_nationkey, COUNT(*) OVER w AS n, MIN(n_name) OVER w AS first_name FROM nation WINDOW w AS (PARTITION BY n_regionkey)")
text("distribution_windows", "SELECT c_custkey, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS cd, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS pr FROM customer")
text("deviation_window", "SELECT c_custkey, ROUND(STDEV(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS sd FROM customer", "SELECT c_custkey, ROUND(stddev_samp(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS sd FROM customer")
text("top_one_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1")
frame("groups_frame", "SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM lineitem")(lambda read: relational.groups_frame(read("lineitem"), ["l_orderkey"], "l_quantity", F.count(F.lit(1)), 1, 1, "n").select("l_orderkey", "l_linenumber", "n"))
frame("exclude_current_row", "SELECT o_orderkey, coalesce(CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT), 0) AS others FROM orders")(lambda read: read("orders").select("o_orderkey", relational.sum_excluding_current("o_orderkey", Window.partitionBy("o_custkey")).alias("others")))

# ---- sorting and limits

text("top_n", "SELECT TOP (10) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
text("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 20 ROWS FETCH NEXT 15 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 20")
text("mysql_limit", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5, 10", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5", dialect="mysql")
frame("sharded_top", "SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 8 AS INT) AS shard FROM orders ORDER BY o_totalprice DESC, shard LIMIT 20")(lambda read: relational.sharded_top(read("orders").select("o_orderkey", "o_totalprice"), F.pmod("o_orderkey", F.lit(8)).cast("int"), [F.desc("o_totalprice")], 20))


@frame("vector_top_k", "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, rank, ROUND(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def _nearest(read):
    e = read("embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return relational.nearest_each(e, "vec_id", "embedding", queries, 10).withColumn("score", F.round("score", 6))


# ---- set operations, CTEs, subqueries

text("set_operations", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
text("intersect_left_to_right", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 22", "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 22")
text("chained_ctes", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n > 1")
text("recursive_cte", "WITH walk AS (SELECT n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, w.depth + 1 FROM nation n JOIN walk w ON n.n_nationkey = w.id * 2 + 1 OR n.n_nationkey = w.id * 2 + 2) SELECT id, depth FROM walk", "WITH RECURSIVE walk AS (SELECT n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, w.depth + 1 FROM nation n JOIN walk w ON n.n_nationkey = w.id * 2 + 1 OR n.n_nationkey = w.id * 2 + 2) SELECT id, depth FROM walk")
text("correlated_scalar", "SELECT n.n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n")
text("derived_table", "SELECT q.seg, q.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS q WHERE q.n > 10")
text("pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) q PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ([F], [O])) p", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F\", count(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O\" FROM orders GROUP BY o_orderpriority")
frame("unpivot", "SELECT l_orderkey, l_linenumber, l_discount AS amount, 'l_discount' AS kind FROM lineitem WHERE l_discount IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, l_tax, 'l_tax' FROM lineitem WHERE l_tax IS NOT NULL")(lambda read: relational.unpivot(read("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], "kind", "amount", keep_all=False))

# ---- table functions

text("generate_series", "SELECT value FROM GENERATE_SERIES(1, 50, 7)", "SELECT unnest(range(1, 51, 7)) AS value")
text("string_split_apply", "SELECT p.p_partkey, s.value FROM part p CROSS APPLY STRING_SPLIT(p.p_type, ' ') s", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part")
frame("string_split_ordinal", "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS ordinal, unnest(string_split(p_name, ' ')) AS value FROM part")(lambda read: relational.string_split(read("part").select("p_partkey", "p_name"), "p_name", " ").select("p_partkey", "ordinal", "value"))
text("openjson_with", "SELECT e.event_id, j.k FROM events e CROSS APPLY OPENJSON(e.props) WITH (k INT '$.k') j", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
text("values_source", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)", dialect="postgres")

# ---- function families

text("string_functions", "SELECT c_custkey, LEFT(c_name, -4) AS l, RIGHT(c_name, 3) AS r, REVERSE(c_mktsegment) AS rv, REPLICATE('ab', 2) AS rp, STUFF(c_mktsegment, 2, 2, '--') AS st, CHARINDEX('I', c_mktsegment) AS ci, QUOTENAME(c_mktsegment) AS qn, LEN(c_name) AS n, UPPER(c_name) AS u FROM customer", "SELECT c_custkey, left(c_name, -4) AS l, right(c_name, 3) AS r, reverse(c_mktsegment) AS rv, 'abab' AS rp, c_mktsegment[1:1] || '--' || c_mktsegment[4:] AS st, instr(c_mktsegment, 'I') AS ci, '[' || c_mktsegment || ']' AS qn, length(c_name) AS n, upper(c_name) AS u FROM customer")
text("split_part_initcap", "SELECT p_partkey, SPLIT_PART(p_name, ' ', 2) AS w, INITCAP(p_type) AS i, LPAD(p_brand, 12, '*') AS lp, STARTS_WITH(p_name, 'p') AS sw FROM part", "SELECT p_partkey, split_part(p_name, ' ', 2) AS w, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS i, lpad(p_brand, 12, '*') AS lp, CAST(starts_with(p_name, 'p') AS INT) AS sw FROM part", dialect="postgres")
text("regexp_functions", "SELECT p_partkey, REGEXP_COUNT(p_name, '[aeiou]') AS n, REGEXP_SUBSTR(p_name, '[0-9]+') AS d, REGEXP_REPLACE(p_name, '[0-9]', '#') AS r, REGEXP_LIKE(p_name, 'PART', 'i') AS m, PATINDEX('%[0-9]%', p_name) AS at FROM part", "SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]')) AS n, nullif(regexp_extract(p_name, '[0-9]+'), '') AS d, regexp_replace(p_name, '[0-9]', '#', 'g') AS r, CAST(regexp_matches(p_name, 'PART', 'i') AS INT) AS m, CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^([^0-9]*)', 1)) + 1 ELSE 0 END AS at FROM part")
text("date_functions", "SELECT o_orderkey, DATEPART(year, o_orderdate) AS y, DATEPART(quarter, o_orderdate) AS q, DATEPART(dayofyear, o_orderdate) AS doy, DATEPART(weekday, o_orderdate) AS dw, DATEPART(iso_week, o_orderdate) AS wk, DATENAME(month, o_orderdate) AS mn, EOMONTH(o_orderdate) AS em FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) + 1 AS dw, week(o_orderdate) AS wk, monthname(o_orderdate) AS mn, strftime(last_day(o_orderdate), '%Y-%m-%d') AS em FROM orders")
text("date_arithmetic", "SELECT o_orderkey, DATEDIFF(month, '2020-01-31', o_orderdate) AS m, DATEDIFF(day, '2020-01-31', o_orderdate) AS d, DATEDIFF(year, '2020-12-31', o_orderdate) AS y, DATEDIFF(hour, '2020-01-31 10:30:00', o_orderdate) AS h, DATEADD(month, 1, o_orderdate) AS nx FROM orders", "SELECT o_orderkey, datediff('month', TIMESTAMP '2020-01-31', o_orderdate) AS m, datediff('day', TIMESTAMP '2020-01-31', o_orderdate) AS d, datediff('year', TIMESTAMP '2020-12-31', o_orderdate) AS y, datediff('hour', TIMESTAMP '2020-01-31 10:30:00', o_orderdate) AS h, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS nx FROM orders")
text("date_buckets", "SELECT event_id, DATE_BUCKET(hour, 6, ts) AS b6, DATE_BUCKET(day, 7, ts) AS b7, DATETRUNC(month, ts) AS mo, DATETRUNC(week, ts) AS wk FROM events", "SELECT event_id, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1900-01-01'), '%Y-%m-%d %H:%M:%S') AS b6, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1900-01-01'), '%Y-%m-%d %H:%M:%S') AS b7, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS mo, strftime(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS wk FROM events")
text("mysql_dates", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d') AS f, YEAR(o_orderdate) AS y, DATEDIFF(o_orderdate, '2020-01-01') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS f, year(o_orderdate) AS y, datediff('day', DATE '2020-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders", dialect="mysql")
text("epoch_functions", "SELECT event_id, EPOCH_MS(ts) AS ms, FROM_EPOCH_MS(EPOCH_MS(ts)) AS iso, DATE_PART('dow', ts) AS dow FROM events", "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, dayofweek(ts) AS dow FROM events")
text("math_functions", "SELECT c_custkey, FLOOR(c_acctbal) AS f, CEILING(c_acctbal) AS c, SIGN(c_acctbal) AS s, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, TRUNC(c_acctbal) AS t, SQUARE(c_custkey) AS sq, ROUND(LOG(ABS(c_acctbal) + 1), 6) AS lg, ROUND(DEGREES(ATAN2(c_custkey, 3)), 6) AS dg FROM customer", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CAST(sign(c_acctbal) AS INT) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, trunc(c_acctbal) AS t, c_custkey * c_custkey AS sq, round(ln(abs(c_acctbal) + 1), 6) AS lg, round(degrees(atan2(c_custkey, 3)), 6) AS dg FROM customer")
text("geo_distance", "SELECT c_custkey, ROUND(GEO_DISTANCE_KM(c_custkey % 90, c_custkey % 180, 48.85, 2.35), 4) AS km FROM customer", "SELECT c_custkey, round(6371.0 * 2 * atan2(sqrt(pow(sin(radians(48.85 - c_custkey % 90) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(48.85)) * pow(sin(radians(2.35 - c_custkey % 180) / 2), 2)), sqrt(1 - (pow(sin(radians(48.85 - c_custkey % 90) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(48.85)) * pow(sin(radians(2.35 - c_custkey % 180) / 2), 2)))), 4) AS km FROM customer")
text("greatest_least", "SELECT l_orderkey, l_linenumber, GREATEST(l_discount, l_tax) AS g, LEAST(l_discount, l_tax, 0.03) AS s FROM lineitem")
text("json_functions", "SELECT event_id, JSON_VALUE(props, '$.k') AS v, JSON_PATH_EXISTS(props, '$.zz') AS p, JSON_KEYS(props) AS ks, JSON_TYPEOF(props) AS ty, ISJSON(props) AS ok FROM events", "SELECT event_id, props->>'$.k' AS v, CAST(json_exists(props, '$.zz') AS INT) AS p, CAST(to_json(list_sort(json_keys(props))) AS VARCHAR) AS ks, 'object' AS ty, CAST(json_valid(props) AS INT) AS ok FROM events")
text("json_build", "SELECT n_nationkey, JSON_OBJECT('id': n_nationkey, 'name': n_name) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS j FROM nation")
text("json_modify", "SELECT event_id, JSON_MODIFY(props, '$.z', 5) AS j FROM events", "SELECT event_id, CAST(json_merge_patch(props, '{\"z\":5}') AS VARCHAR) AS j FROM events", udfs=True)
text("hash_functions", "SELECT c_custkey, SHA256(c_name) AS s, MD5(c_name) AS m, SHA1(c_name) AS s1, HEX_ENCODE(c_name) AS h, BASE64_ENCODE(c_name) AS b FROM customer", "SELECT c_custkey, sha256(c_name) AS s, md5(c_name) AS m, sha1(c_name) AS s1, lower(hex(c_name)) AS h, base64(encode(c_name)) AS b FROM customer")
text("uuid_functions", "SELECT n_nationkey, UUID_IS_VALID(n_name) AS v, UUID_VERSION('01890a5d-ac96-7b2e-9c3f-0123456789ab') AS n, UUID_FROM_BLOB(UUID_TO_BLOB('01890A5D-ac96-7b2e-9c3f-0123456789ab')) AS u FROM nation", "SELECT n_nationkey, 0 AS v, 7 AS n, '01890a5d-ac96-7b2e-9c3f-0123456789ab' AS u FROM nation")
text("vector_functions", "SELECT a.vec_id, ROUND(VECTOR_DOT_PRODUCT(a.embedding, b.embedding), 5) AS dp, ROUND(VECTOR_L2_DISTANCE(a.embedding, b.embedding), 5) AS l2, ROUND(VECTOR_NORM(a.embedding), 5) AS n, VECTOR_DIM(a.embedding) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 1", "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS dp, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS l2, round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 5) AS n, len(a.embedding) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 1")
text("sqlite_dates", "SELECT o_orderkey, STRFTIME('%Y-%m', o_orderdate) AS ym, DATE(o_orderdate, '+7 days') AS wk, DATE(o_orderdate, 'start of month') AS mo FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS wk, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mo FROM orders")

# ---- changes of tables


@frame("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0")
def _upsert(read):
    c = read("customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(1000.0)).union(c.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return mutations.upsert(c, new, ["c_custkey"], {"c_acctbal": "old.c_acctbal + new.c_acctbal"})


@frame("merge", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT -o_orderkey - 1, 1.0 FROM orders")
def _merge(read):
    o = read("orders")
    target, source = o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus").union(o.select(-F.col("o_orderkey") - 1, F.lit("N")))
    return mutations.merge(target, source, ["o_orderkey"], [mutations.When("matched", "delete", condition="s.o_orderstatus = 'F'"), mutations.When("matched", "update", {"o_totalprice": "t.o_totalprice * 2"}, "s.o_orderstatus = 'O'"), mutations.When("not_matched", "insert", {"o_orderkey": "s.o_orderkey", "o_totalprice": "1.0D"})])


frame("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")(lambda read: mutations.update(read("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "0.0D"}, "c_acctbal < 0"))
frame("update_from", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")(lambda read: mutations.update_from(read("customer"), read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), ["c_nationkey"], {"c_name": "s.n_name"}, "s.n_regionkey = 2").select("c_custkey", "c_name"))
frame("delete_where", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, FALSE)")(lambda read: mutations.delete(read("customer"), "c_acctbal < 0").select("c_custkey"))
frame("delete_join", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(lambda read: mutations.delete_matching(read("orders").select("o_orderkey", "o_custkey"), read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey"))

# ---- change capture and windows


def _changes(read):
    e = read("events")
    hlc = F.concat(F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 16, "0"), F.lit("-00000000"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("event_id") - F.pmod("event_id", F.lit(50)) % 2).cast("string")).alias("change_id"), F.lit("users").alias("table"), F.col("user_id").cast("string").alias("row_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), F.col("props").alias("payload"), hlc.alias("hlc"), F.lit("d").alias("device_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at_ms"))


frame("lww_winners", "SELECT row_id, operation, ms FROM (SELECT CAST(user_id AS VARCHAR) AS row_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, 'c' || CAST(event_id AS VARCHAR) DESC) AS rn FROM events) WHERE rn = 1")(lambda read: changes.winners(_changes(read).withColumn("change_id", F.concat(F.lit("c"), F.col("seq").cast("string")))).select("row_id", "operation", F.col("created_at_ms").alias("ms")))
frame("change_capture", "SELECT CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN c_custkey % 7 = 0 THEN 'delete' ELSE 'upsert' END AS operation FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0")(lambda read: changes.capture(read("customer").select("c_custkey", "c_acctbal"), read("customer").filter("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal")), "c_custkey", "customer").select("row_id", "operation"))
frame("tumbling_window", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda read: windows.tumbling(read("events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type", "n"))
frame("session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, n FROM (SELECT user_id, k, count(*) AS n FROM k GROUP BY 1, 2)")(lambda read: windows.sessions(read("events"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]).select("user_id", "n"))

# ---- further changes, capture, windows and sources

frame("merge_output", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'DELETE' WHEN s_suppkey % 3 = 1 THEN 'UPDATE' END AS merge_action FROM supplier")(
    lambda read: mutations.merge(read("supplier"), read("supplier").filter("s_suppkey % 3 < 2"), ["s_suppkey"], [mutations.When("matched", "delete", condition="t.s_suppkey % 3 = 0"), mutations.When("matched", "update", {"s_acctbal": "0.0D"})], with_action=True).select("s_suppkey", "merge_action")
)
frame("delete_top", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")(lambda read: mutations.delete_top(read("customer"), 10, ["c_acctbal", "c_custkey"], "c_custkey").select("c_custkey"))
frame("insert_select", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1000, NULL FROM region")(lambda read: mutations.insert(read("nation").selectExpr("n_nationkey AS id", "n_name AS name"), read("region").selectExpr("r_regionkey + 1000 AS id")))
frame("insert_if_absent", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1.0 END AS c_acctbal FROM customer")(lambda read: mutations.upsert(read("customer").filter("c_acctbal > 0").select("c_custkey", "c_acctbal"), read("customer").select("c_custkey", F.lit(-1.0).alias("c_acctbal")), ["c_custkey"], nothing=True))
frame("constraint_violations", "SELECT 'unique(o_custkey)' AS rule, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'check rich', count(*) FROM orders WHERE NOT o_totalprice > 10000 HAVING count(*) > 0 UNION ALL SELECT 'references o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")(
    lambda read: mutations.violations(read("orders"), unique=[["o_custkey"]], not_null=["o_orderkey"], checks={"rich": "o_totalprice > 10000"}, references={"o_custkey": (read("customer").filter("c_custkey % 2 = 0"), "c_custkey")})
)


def _same_content(read):
    """The changes of which rows of one id are one change, sent more than once."""
    c = _changes(read)
    w = Window.partitionBy("change_id")
    return c.select("seq", "change_id", "table", F.min("row_id").over(w).alias("row_id"), F.min("operation").over(w).alias("operation"), F.min("payload").over(w).alias("payload"), F.min("hlc").over(w).alias("hlc"), "device_id", "created_at_ms")


frame("change_report", "WITH d AS (SELECT event_id - event_id % 50 % 2 AS cid, min(CAST(user_id AS VARCHAR)) AS row_id FROM events GROUP BY 1), w AS (SELECT count(DISTINCT row_id) AS n FROM d) SELECT 'applied' AS decision, (SELECT n FROM w) AS n UNION ALL SELECT 'ignored', (SELECT count(*) FROM d) - (SELECT n FROM w) UNION ALL SELECT 'duplicate', (SELECT count(*) FROM events) - (SELECT count(*) FROM d)")(
    lambda read: changes.apply_changes(read("events").sparkSession.createDataFrame([], changes.SCHEMA), _same_content(read))[1]
)
frame("changes_after_cursor", "SELECT event_id AS seq FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 25")(lambda read: changes.after(_changes(read), 100, 25).select("seq"))
frame("refused_changes", "SELECT 'from the future' AS reason, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 > 1705190400000 + 86400000")(lambda read: changes.validate(_changes(read).withColumn("payload", F.coalesce("payload", F.lit("{}"))), 1705190400000)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
frame("sliding_window", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS w, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")(lambda read: windows.tumbling(read("events"), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], slide="30 minutes").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "n"))
frame("hierarchy", "WITH RECURSIVE walk AS (SELECT n_nationkey AS node, 0 AS depth, n_nationkey AS root FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, depth + 1, root FROM nation JOIN walk ON n_nationkey >= 3 AND n_nationkey // 3 = node) SELECT node, depth, root FROM walk")(
    lambda read: relational.hierarchy(read("nation").select("n_nationkey", F.expr("case when n_nationkey >= 3 then n_nationkey div 3 end").alias("boss")), "n_nationkey", "boss")
)
frame("sql_dump", """SELECT 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS value FROM region""")(lambda read: files.insert_statements(read("region"), "region"))
text("openjson_pairs", "SELECT e.event_id, j.[key], j.value FROM events e CROSS APPLY OPENJSON(e.props) j", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
text("cte_then_union_all", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0) SELECT k FROM a UNION ALL SELECT k + 100 FROM a")
text("using_join", "SELECT n_nationkey, n.n_name AS name FROM nation n JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) m USING (n_nationkey)", dialect="postgres")
frame("dedup_batch", "SELECT DISTINCT user_id, event_type FROM events")(lambda read: windows.deduplicated(read("events"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type"))

# ---- function families, over all rows of a table

calls(
    "text_functions",
    {
        "a": ("REPLICATE(c_mktsegment, 2)", "repeat(c_mktsegment, 2)"), "b": ("LEFT(c_name, 4)", "left(c_name, 4)"), "c": ("RIGHT(c_name, 3)", "right(c_name, 3)"), "d": ("ISNULL(NULLIF(c_mktsegment, 'MACHINERY'), '-')", "coalesce(nullif(c_mktsegment, 'MACHINERY'), '-')"),
        "e": ("TRANSLATE(c_name, '#0', '-o')", "translate(c_name, '#0', '-o')"), "f": ("ASCII(c_mktsegment)", "ascii(c_mktsegment)"), "g": ("UNICODE(c_mktsegment)", "unicode(c_mktsegment)"), "h": ("CHAR(65 + c_nationkey)", "chr(CAST(65 + c_nationkey AS INTEGER))"), "i": ("NCHAR(945 + c_nationkey)", "chr(CAST(945 + c_nationkey AS INTEGER))"),
        "j": ("DATALENGTH(c_name)", "octet_length(encode(c_name))"), "k": ("SPACE(2) + c_mktsegment", "'  ' || c_mktsegment"), "l": ("QUOTENAME(c_mktsegment)", "'[' || c_mktsegment || ']'"), "m": ("STRING_ESCAPE(c_name + '\"', 'json')", "c_name || '\\\"'"), "n": ("ISNUMERIC(c_name)", "0"), "o": ("c_custkey + 1 + '!'", "CAST(c_custkey + 1 AS VARCHAR) || '!'"), "p": ("ENCODE_HEX(c_mktsegment)", "lower(hex(c_mktsegment))"), "q": ("CONCAT_WS('/', c_mktsegment, c_name)", "concat_ws('/', c_mktsegment, c_name)"), "r": ("IIF(c_mktsegment = 'building' COLLATE Latin1_General_CI_AS, 1, 0)", "CASE WHEN lower(c_mktsegment) = 'building' THEN 1 ELSE 0 END"),
    },
    table="customer",
)
calls("regexp_positions", {"a": ("REGEXP_INSTR(c_name, '[0-9]+')", "10"), "b": ("REGEXP_COUNT(c_name, '0')", "len(regexp_extract_all(c_name, '0'))"), "c": ("UNISTR('\\0041\\00e9')", "'Aé'"), "d": ("PARSENAME('srv..dbo.' + c_mktsegment, 1)", "c_mktsegment"), "e": ("PARSENAME('srv..dbo.t', 3)", "NULL"), "f": ("PARSENAME('srv..dbo.t', 4)", "'srv'")}, table="customer", udfs=True)
calls("postgres_text", {"a": ("strpos(c_name, '#')", "strpos(c_name, '#')"), "b": ("octet_length(c_name || 'é')", "octet_length(encode(c_name || 'é'))"), "c": ("char_length(c_name || 'é')", "length(c_name || 'é')"), "d": ("c_custkey::text || '-' || c_mktsegment", "c_custkey::VARCHAR || '-' || c_mktsegment"), "e": ("starts_with(c_mktsegment, 'B')", "CAST(starts_with(c_mktsegment, 'B') AS INTEGER)"), "f": ("c_acctbal::int + 1", "CAST(trunc(c_acctbal) AS BIGINT) + 1")}, dialect="postgres", table="customer")
calls("mysql_text", {"a": ("LENGTH(CONCAT(c_name, 'é'))", "octet_length(encode(c_name || 'é'))"), "b": ("LCASE(c_mktsegment)", "lower(c_mktsegment)"), "c": ("UCASE(c_name)", "upper(c_name)"), "d": ("MID(c_name, 2, 3)", "substr(c_name, 2, 3)"), "e": ("LOCATE('#', c_name)", "strpos(c_name, '#')"), "f": ("POSITION('o' IN c_name)", "strpos(c_name, 'o')"), "g": ("SUBSTRING(c_name FROM 5)", "substr(c_name, 5)"), "h": ("SUBSTRING_INDEX(c_name, '#', 1)", "split_part(c_name, '#', 1)"), "i": ("IFNULL(NULLIF(c_nationkey, 3), -1)", "coalesce(nullif(c_nationkey, 3), -1)"), "j": ("CAST(c_nationkey AS CHAR)", "CAST(c_nationkey AS VARCHAR)"), "k": ("c_custkey DIV 7", "c_custkey // 7")}, dialect="mysql", table="customer")
calls("number_functions", {"a": ("ROUND(PI(), 10)", "round(pi(), 10)"), "b": ("POWER(c_nationkey, 2)", "power(c_nationkey, 2)"), "c": ("ROUND(CBRT(c_custkey), 8)", "round(cbrt(c_custkey), 8)"), "d": ("ROUND(EXP(c_nationkey / 10.0), 6)", "round(exp(c_nationkey / 10.0), 6)"), "e": ("ROUND(LOG10(c_custkey + 1), 8)", "round(log10(c_custkey + 1), 8)"), "f": ("ROUND(LOG2(c_custkey + 1), 8)", "round(log2(c_custkey + 1), 8)"), "g": ("ROUND(LN(c_custkey + 1), 8)", "round(ln(c_custkey + 1), 8)"), "h": ("MOD(c_custkey, 7)", "c_custkey % 7"), "i": ("CAST(SIGN(c_acctbal) AS INT)", "CAST(sign(c_acctbal) AS BIGINT)"), "j": ("CONVERT(VARCHAR(30), c_acctbal, 1)", "format('{:,.2f}', c_acctbal)"), "k": ("CONVERT(VARCHAR(30), c_acctbal, 2)", "format('{:.4f}', c_acctbal)"), "l": ("PARSE(CAST(c_nationkey AS VARCHAR(5)) AS INT)", "CAST(c_nationkey AS BIGINT)"), "m": ("TRY_PARSE(c_mktsegment AS INT)", "CAST(NULL AS BIGINT)")}, table="customer")
calls("format_cultures", {"a": ("FORMAT(1234.5, 'N2', 'de-DE')", "'1.234,50'"), "b": ("FORMAT(0.256, 'P1')", "'25.6%'"), "c": ("FORMAT(1234567.891, '#,##0.00')", "'1,234,567.89'"), "d": ("TSQL_POINT(1, 2)", "'POINT (1 2)'"), "e": ("DECOMPRESS(COMPRESS(r_name)) = CAST(r_name AS VARBINARY(20))", "TRUE")}, udfs=True)
calls(
    "date_texts",
    {
        "a": ("DATEADD(millisecond, 5, '2024-01-01 00:00:00.100')", "'2024-01-01 00:00:00.105'"), "b": ("DATEADD(day, 1, '20240131')", "'2024-02-01'"), "c": ("DATEPART(year, 45000)", "2023"), "d": ("DATENAME(month, '01/02/2024')", "'January'"), "e": ("DATETRUNC(millisecond, '2024-01-01 00:00:00.123456')", "'2024-01-01 00:00:00.123'"), "f": ("TIMEFROMPARTS(1, 2, 3, 5, 2)", "'01:02:03.05'"), "g": ("DATETIMEFROMPARTS(2023, 1, 2, 3, 4, 5, 6)", "'2023-01-02 03:04:05.006'"), "h": ("DATEFROMPARTS(2023, 7, r_regionkey + 1)", "'2023-07-0' || (r_regionkey + 1)"), "i": ("ISDATE('2024-02-' + CAST(r_regionkey + 27 AS VARCHAR(2)))", "CASE WHEN r_regionkey < 3 THEN 1 ELSE 0 END"),
        "j": ("DATE_TRUNC('month', '2024-05-06 07:08:09')", "'2024-05-01T00:00:00.000Z'"), "k": ("AGE_MS('2024-01-01 00:00:01', '2024-01-01 00:00:00')", "1000"), "l": ("NOW_MS() > 1700000000000", "TRUE"), "m": ("LEN(SYSDATETIMEOFFSET())", "30"), "n": ("CURRENT_TIMEZONE()", "'UTC'"),
    },
)
calls("mysql_clock", {"a": ("UNIX_TIMESTAMP('2024-01-01')", "1704067200"), "b": ("FROM_UNIXTIME(86400 * r_regionkey)", "strftime(make_timestamp(86400000000 * r_regionkey), '%Y-%m-%d %H:%M:%S')"), "c": ("DAYOFWEEK('2024-01-01')", "2"), "d": ("TIMESTAMPDIFF(DAY, '2024-01-01', '2024-01-05')", "4"), "e": ("DATE_FORMAT(DATE_ADD('2024-01-31', INTERVAL 1 MONTH), '%Y-%m-%d')", "'2024-02-29'"), "f": ("DATE_FORMAT(DATE_SUB('2024-01-31', INTERVAL 1 DAY), '%Y-%m-%d')", "'2024-01-30'")}, dialect="mysql")
calls(
    "json_text",
    {
        "a": ("JSON_VALUE('{\"a\":true}', '$.a')", "'1'"), "b": ("JSON_QUERY('{\"a\":[1,2]}', '$.a')", "'[1,2]'"), "c": ("JSON_DEPTH('{\"a\":[1]}')", "3"), "d": ("JSON_LENGTH_DEEP('{\"a\":[1,2],\"b\":3}')", "3"), "e": ("JSON_VALID_STRICT('{bad')", "0"), "f": ("JSON_MERGE_PATCH('{\"a\":1}', '{\"b\":2}')", "'{\"a\":1,\"b\":2}'"), "g": ("JSON_CONTAINS('{\"a\":1,\"b\":2}', '{\"a\":1}')", "1"), "h": ("JSON_ARRAY_LENGTH('[1,2,3]')", "3"), "i": ("JSON_OBJECT_LENGTH('{\"a\":1}')", "1"),
        "j": ("JSON_STRIP_NULLS('{\"a\":null,\"b\":1}')", "'{\"b\":1}'"), "k": ("JSON_PRETTY('{\"a\":1}')", "'{' || chr(10) || '  \"a\": 1' || chr(10) || '}'"), "l": ("JSON_VALUE('{\"n\":\"' + r_name + '\"}', '$.n')", "r_name"), "m": ("JSON_PATH_EXISTS('{\"a\":1}', '$.b')", "0"),
    },
    udfs=True,
)
calls("json_arrows", {"a": ("'{\"a\":{\"b\":5}}'->'a'", "'{\"b\":5}'"), "b": ("props->>'k'", "json_extract_string(props, '$.k')"), "c": ("json_typeof('[1]')", "'array'"), "d": ("event_id", "event_id")}, dialect="postgres", table="events")
text("json_unquote", "SELECT event_id, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", dialect="mysql")
text("json_agg_array", "SELECT n_regionkey, json_agg(n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey", dialect="postgres")
calls("crypto_functions", {"a": ("HMAC_SHA256('k', 'm')", "'b60090e3052297aeb5a080889ce2fc4bca957e756faeb4df7d31800ca1e771ec'"), "b": ("HEX_ENCODE(HASHBYTES('SHA2_256', r_name))", "sha256(r_name)"), "c": ("BASE64_DECODE(BASE64_ENCODE(r_name))", "r_name"), "d": ("HEX_DECODE(HEX_ENCODE(r_name))", "r_name"), "e": ("UUID_NIL()", "'00000000-0000-0000-0000-000000000000'"), "f": ("UUID_VERSION(UUID_V7())", "7"), "g": ("UUID_VERSION(NEWID())", "4"), "h": ("LEN(RANDOM_STRING(12))", "12")}, udfs=True)
calls("vector_texts", {"a": ("VECTOR_COSINE_DISTANCE('[1,0]', '[0,1]')", "CAST(1 AS DOUBLE)"), "b": ("VECTOR_DIM('[1,2,3]')", "3"), "c": ("VECTOR_NORM('3,4')", "CAST(5 AS DOUBLE)"), "d": ("VECTOR_L2_DISTANCE('[0,0]', '[3,4]')", "CAST(5 AS DOUBLE)"), "e": ("VECTOR_DOT_PRODUCT(VECTOR_FROM_BLOB(VECTOR_TO_BLOB('[1,2]')), '[3,4]')", "CAST(11 AS DOUBLE)"), "f": ("VECTOR_DOT_PRODUCT(VECTOR_NORMALIZE('[3,4]'), '[5,0]')", "CAST(3 AS DOUBLE)")}, udfs=True)
calls("session_functions", {"a": ("SCHEMA_NAME()", "'dbo'"), "b": ("DB_NAME()", "'default'"), "c": ("SERVERPROPERTY('Edition')", "'Loomstone'")})

# ---- further forms of queries

text("apply_scalar_list", "SELECT n_nationkey, x.v FROM nation CROSS APPLY (SELECT n_nationkey * 2 AS v) x", "SELECT n_nationkey, n_nationkey * 2 AS v FROM nation")
text("straight_join", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", dialect="mysql")
text("hinted_join", "SELECT c.c_custkey, n.n_name FROM customer c WITH (NOLOCK) JOIN nation n WITH (NOLOCK) ON c.c_nationkey = n.n_nationkey OPTION (HASH JOIN)", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
text("recursion_limit", "WITH r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 40) SELECT n FROM r OPTION (MAXRECURSION 60)", "SELECT CAST(unnest(range(1, 41)) AS INTEGER) AS n")
text("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
text("postgres_limit_all", "SELECT r_name FROM region ORDER BY r_name LIMIT ALL", "SELECT r_name FROM region", dialect="postgres")

# ---- scripts

scripted("script_flow", "DECLARE @i INT = 0; CREATE TABLE steps (i INT PRIMARY KEY, label VARCHAR(20) DEFAULT 'none'); WHILE @i < 4 BEGIN SET @i = @i + 1; IF @i = 2 CONTINUE; INSERT INTO steps (i) VALUES (@i); END; BEGIN TRY INSERT INTO steps VALUES (1, 'twice'); END TRY BEGIN CATCH INSERT INTO steps VALUES (9, 'refused'); END CATCH; SELECT i, label FROM steps", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'none'), (3, 'none'), (4, 'none'), (9, 'refused')) t(i, label)", ())
scripted("select_into", "SELECT c_custkey, c_acctbal INTO rich FROM customer WHERE c_acctbal > 5000; EXEC('DELETE FROM rich WHERE c_acctbal > 9000'); SELECT c_custkey FROM rich", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000", ("customer",))
scripted("update_output", "UPDATE supplier SET s_acctbal = s_acctbal + 1 OUTPUT inserted.s_suppkey, deleted.s_acctbal AS was WHERE s_acctbal < 0", "SELECT s_suppkey, s_acctbal AS was FROM supplier WHERE s_acctbal < 0", ("supplier",))
scripted("delete_returning", "DELETE FROM nation WHERE n_regionkey = 2 RETURNING n_nationkey, n_name", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", ("nation",), "postgres")
scripted("cte_delete", "WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) DELETE FROM r WHERE place > 2; SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) WHERE place <= 2", ("nation",))
scripted("cte_update", "WITH low AS (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0) UPDATE low SET s_acctbal = 0; SELECT s_suppkey, s_acctbal FROM supplier", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier", ("supplier",))
scripted("sequence_values", "CREATE SEQUENCE tickets START WITH 5 INCREMENT BY 2; CREATE TABLE t (n INT); INSERT INTO t VALUES (NEXT VALUE FOR tickets); INSERT INTO t VALUES (NEXT VALUE FOR tickets); SELECT n FROM t", "SELECT * FROM (VALUES (CAST(5 AS BIGINT)), (7)) t(n)", ())
scripted("truncate_and_refill", "TRUNCATE TABLE region; INSERT INTO region SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3; SELECT r_regionkey, r_name FROM region", "SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_nationkey < 3", ("region", "nation"))
frame("shard_routing", "SELECT count(*) AS n, 8 AS shards FROM customer")(lambda read: read("customer").select(sharding.shard_of("c_custkey", 8).alias("s")).agg(F.count("s").alias("n"), F.count_distinct("s").cast("int").alias("shards")))
frame("changes_backfill", "SELECT CAST(n_nationkey AS VARCHAR) AS row_id, 'upsert' AS operation FROM nation")(lambda read: changes.capture(read("nation").limit(0), read("nation"), "n_nationkey", "nation").select("row_id", "operation"))
