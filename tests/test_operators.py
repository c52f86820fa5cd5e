import math
import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import mutations, relational, sharding
from loomstone.plans.lexer import DialectError


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id long, v long")


def test_upsert_and_nothing(spark, table):
    new = spark.createDataFrame([(1, 5), (9, 9)], "id long, v long")
    assert got(mutations.upsert(table, new, ["id"])) == got(spark.createDataFrame([(1, 5), (2, None), (3, 30), (9, 9)], "id long, v long"))
    assert (1, 10) in got(mutations.upsert(table, new, ["id"], nothing=True))
    assert (1, 15) in got(mutations.upsert(table, new, ["id"], {"v": "old.v + new.v"}))


def test_merge_first_clause_wins(spark, table):
    s = spark.createDataFrame([(1, 100), (3, 0), (7, 70)], "id long, v long")
    out = mutations.merge(table, s, ["id"], [mutations.When("matched", "delete", condition="s.v = 0"), mutations.When("matched", "update", {"v": "s.v"}), mutations.When("not_matched", "insert", {"id": "s.id", "v": "s.v"}), mutations.When("not_matched_by_source", "update", {"v": "-1"})])
    assert got(out) == [(1, 100), (2, -1), (7, 70)]


def test_update_delete_keep_unknown_conditions(table):
    assert got(mutations.update(table, {"v": "0"}, "v > 5")) == [(1, 0), (2, None), (3, 0)]
    assert got(mutations.delete(table, "v > 15")) == [(1, 10), (2, None)]
    assert mutations.delete(table).count() == 0


def test_double_match_and_violations(spark, table):
    twice = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(Exception, match="more than once"):
        mutations.merge(table, twice, ["id"], [mutations.When("matched", "delete")]).collect()
    bad = mutations.violations(table.union(table), unique=[["id"]], not_null=["v"], checks={"small": "v < 20"}, references={"id": (twice, "id")})
    assert dict(got(bad)) == {"unique(id)": 3, "not null v": 2, "check small": 2, "references id": 4}


def test_limited(spark):
    assert len(relational.limited(spark.range(3), 3)) == 3
    with pytest.raises(relational.ResultTooLarge):
        relational.limited(spark.range(4), 3)


def test_as_of_join(spark):
    l = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t long, x long")  # noqa: E741
    r = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "k string, u long, y long")
    assert got(relational.as_of_join(l, r, ["k"], "t", "u", ["y"])) == got(spark.createDataFrame([("a", 1, 2, None), ("a", 5, 1, 50), ("b", 9, 3, None)], "k string, t long, x long, y long"))


def test_unpivot_keeps_columns(spark):
    w = spark.createDataFrame([(1, 10, 20), (2, 30, None)], "id int, a int, b int")
    assert sorted(map(tuple, relational.unpivot(w, ["a", "b"], keep_all=False).select("id", "value", "name").collect())) == [(1, 10, "a"), (1, 20, "b"), (2, 30, "a")]


def test_set_operations_from_left(spark):
    one, two, three = (spark.createDataFrame([(i,)], "v int") for i in (1, 2, 3))
    assert relational.left_to_right(one, ("union", two), ("intersect", three)).count() == 0


def test_shards(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [(None,)], "k string")
    a = dict(df.select("k", sharding.shard_of("k", 8)).collect())
    b = dict(df.select("k", sharding.shard_of("k", 9)).collect())
    assert a[None] is None and set(a.values()) - {None} == set(range(8))
    assert all(b[k] in (v, 8) for k, v in a.items() if k)
    assert sharding.fnv1a64(b"") == 0xCBF29CE484222325 and sharding.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_hierarchy(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "e long, m long")
    assert got(relational.hierarchy(t, "e", "m")) == [(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 1, 1)]


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, e array<double>")
    assert [r.id for r in relational.nearest(v, "e", [1.0, 0.1], 2).collect()] == [1, 3]


def plain_nearest(rows, queries, k, metric):
    """(query_id, id, score, rank) by plain loops; nulls last, NaN above all numbers."""
    out = []
    for qid, q in queries:
        scored = []
        for i, v in rows:
            s = None
            if v and q and len(v) == len(q):
                dot, vv, qq = (sum_in_order(a, b) for a, b in ((v, q), (v, v), (q, q)))
                cosine = max(-1.0, min(1.0, dot / math.sqrt(vv * qq))) if vv * qq else math.nan
                s = {"cosine_similarity": cosine, "cosine_distance": 1 - cosine, "dot_product": dot, "l2_distance": math.sqrt(sum_in_order([x - y for x, y in zip(v, q)], [x - y for x, y in zip(v, q)]))}[metric]
            high = "distance" not in metric
            scored.append((s is None, (not math.isnan(s)) == high if s is not None else 0, 0 if s is None or math.isnan(s) else -s if high else s, i, s))
        out += [(qid, r[3], repr(r[4]), n) for n, r in enumerate(sorted(scored, key=lambda r: r[:4])[:k], 1)]
    return sorted(out)


def sum_in_order(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


@pytest.mark.parametrize("metric", ["cosine_similarity", "cosine_distance", "dot_product", "l2_distance"])
def test_nearest_each_is_exact_over_blocks(spark, metric):
    rng = random.Random(5)
    some = [[float(rng.randint(-3, 3)) for _ in range(3)] for _ in range(25)]
    # many copies, multiples of a vector, a vector of length 0, other dimensions and nulls
    rows = [(i, rng.choice(some)) for i in range(400)] + [(400 + i, [x * m for x in some[0]]) for i, m in enumerate((3.0, 7.0, 0.1))]
    rows += [(500, [0.0, 0.0, 0.0]), (501, None), (502, []), (503, [1.0]), (504, [1.0, 2.0])]
    asked = [(i, rng.choice(some)) for i in range(12)] + [(20, [0.1, 0.7, -0.3]), (21, None), (22, [2.0]), (23, [0.0, 0.0, 0.0])]
    df, queries = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(asked, "query_id long, query array<double>")
    out = relational.nearest_each(df, "id", "v", queries, 6, metric, block=30)
    got = sorted((r.query_id, r.id, repr(r.score), r.rank) for r in out.collect())
    assert got == plain_nearest(rows, asked, 6, metric)


def test_nearest_each_discards_by_matrix_products(spark):
    df = spark.range(500).select("id", F.array(*(F.sin(F.col("id") * (j + 1)) for j in range(8))).alias("v"))
    queries = df.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    out = relational.nearest_each(df, "id", "v", queries, 3)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 15
    assert relational.nearest_each(df, "id", "v", queries.limit(0), 3).count() == 0
    assert relational.nearest_each(df.limit(0), "id", "v", queries, 3).count() == 0
