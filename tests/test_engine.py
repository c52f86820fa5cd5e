import pytest

from loomstone.engine import Engine, Migration
from loomstone.plans.lexer import DialectError
from loomstone.sources import files

SCRIPT = """
DECLARE @i INT = 0, @s VARCHAR(10) = 'a';
CREATE TABLE #t (id INT PRIMARY KEY, v INT, s VARCHAR(20));
WHILE @i < 3
BEGIN
  SET @i = @i + 1;
  IF @i = 2 CONTINUE;
  INSERT INTO #t (id, v, s) VALUES (@i, @i * 10, @s + 'x');
END
INSERT INTO #t VALUES (5, NULL, 'z'), (6, 60, 'y');
UPDATE #t SET v = v + 1 WHERE id = 1;
DELETE FROM #t WHERE id = 6;
BEGIN TRY
  THROW 50000, 'oops', 1;
END TRY
BEGIN CATCH
  PRINT 'caught ' + CAST(@i AS VARCHAR(5));
END CATCH
MERGE INTO #t AS t USING (SELECT 1 AS id, 100 AS v UNION ALL SELECT 9, 900) AS s ON t.id = s.id
 WHEN MATCHED AND s.v > 50 THEN UPDATE SET v = s.v
 WHEN NOT MATCHED BY TARGET THEN INSERT (id, v, s) VALUES (s.id, s.v, 'new')
 WHEN NOT MATCHED BY SOURCE AND t.id = 5 THEN DELETE;
SELECT * INTO copy FROM #t WHERE v > 50;
SELECT id, v, s FROM #t ORDER BY id;
SELECT @s = MAX(s) FROM copy;
"""


def test_script(spark):
    e = Engine(spark)
    out = e.run(SCRIPT)
    assert [tuple(r) for r in out.results[0].collect()] == [(1, 100, "ax"), (3, 30, "ax"), (9, 900, "new")]
    assert out.messages == ["caught 3"] and out.variables["@s"] == "new"
    got = e.run("INSERT INTO copy (id, v, s) VALUES (1, 5, 'q') ON CONFLICT (id) DO UPDATE SET v = excluded.v + v; SELECT v FROM copy WHERE id = 1", "postgres")
    assert got.results[0].first()[0] == 105


def test_failed_script_changes_nothing(spark):
    e = Engine(spark, {"a1": spark.createDataFrame([(1,)], "id long")})
    with pytest.raises(DialectError):
        e.run("INSERT INTO a1 VALUES (2); THROW 50000, 'no', 1;")
    assert e.frame("a1").count() == 1


def test_builder(spark):
    e = Engine(spark, {"people": spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, "c", 7.0)], "id long, name string, pay double")})
    q = e.table("people").select("id").where({"name": ["a", "c"]}).where("pay > ?", [1]).order_by("-id").limit(1)
    assert q.get() == [{"id": 3}]
    e.table("people").upsert([{"id": 2, "name": "B"}, {"id": 4, "name": "d"}], ["id"])
    e.table("people").where({"id": 1}).update({"name": "it's"})
    e.table("people").where({"id": 3}).delete()
    assert sorted((r["id"], r["name"]) for r in e.table("people").get()) == [(1, "it's"), (2, "B"), (4, "d")]
    assert e.query("SELECT name FROM people WHERE id = @i", params={"@i": 1}) == [{"name": "it's"}]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", x', None), (2, "it's", 2.5)], "id long, s string, d double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), schema="id long, s string, d double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.insert_statements(df).collect()[1][0] == "INSERT INTO \"exported_data\" (\"id\", \"s\", \"d\") VALUES (2, 'it''s', 2.5);"
    assert "id = 1" in files.render(df, "line") and files.render(df, "csv").startswith("id,s,d\n")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_catalog_and_migrations(spark):
    e = Engine(spark, {"m1": spark.createDataFrame([(1, "a")], "id long, s string")})
    assert e.query("SELECT COLUMN_NAME, DATA_TYPE FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'm1' ORDER BY ORDINAL_POSITION") == [{"COLUMN_NAME": "id", "DATA_TYPE": "bigint"}, {"COLUMN_NAME": "s", "DATA_TYPE": "string"}]
    assert e.query("SELECT name FROM sys.tables") == [{"name": "m1"}]
    steps = [Migration(1, "CREATE TABLE m2 (id INT)"), Migration(2, "INSERT INTO m2 VALUES (4)")]
    done = e.migrate(steps)
    assert sorted(done) == [1, 2] and e.frame("m2").count() == 1 and e.migrate(steps, done) == done
    with pytest.raises(DialectError):
        e.migrate([Migration(1, "CREATE TABLE other (id INT)")], done)


def test_joined_changes(spark):
    e = Engine(spark, {"acc": spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 30)], "id long, v long"), "adj": spark.createDataFrame([(1, 5), (3, 7)], "id long, d long")})
    e.run("UPDATE a SET a.v = a.v + j.d FROM acc a INNER JOIN adj j ON a.id = j.id WHERE j.d > 5")
    assert sorted(map(tuple, e.frame("acc").collect())) == [(1, 10), (2, 20), (3, 37), (3, 37)]
    e.run("UPDATE acc SET v = adj.d FROM acc JOIN adj ON acc.id = adj.id WHERE acc.id = 1")
    e.run("DELETE TOP (1) FROM acc WHERE id = 3; DELETE a FROM acc AS a JOIN adj ON adj.id = a.id WHERE adj.d = 5")
    assert sorted(map(tuple, e.frame("acc").collect())) == [(2, 20), (3, 37)]
    e.run("DELETE FROM acc WHERE id IN (SELECT id FROM adj)")
    assert [tuple(r) for r in e.frame("acc").collect()] == [(2, 20)]
