"""Scripts hold what they declare: constraints, OUTPUT, dynamic texts, changes through a CTE."""

import pytest

from loomstone.engine import Engine
from loomstone.plans.lexer import DialectError

DEPOT = "CREATE TABLE depot (code INT PRIMARY KEY, label VARCHAR(20) NOT NULL, stock INT DEFAULT 7, CONSTRAINT c1 CHECK (stock >= 0), UNIQUE (label));"


@pytest.fixture
def depot(spark):
    e = Engine(spark)
    e.run(DEPOT + "INSERT INTO depot VALUES (1, 'north', 10), (2, 'south', 20), (3, 'west', 30)")
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "change",
    [
        "INSERT INTO depot VALUES (1, 'again', 1)", "INSERT INTO depot VALUES (NULL, 'x', 1)", "INSERT INTO depot (code) VALUES (9)", "INSERT INTO depot VALUES (9, 'north', 1)",
        "UPDATE depot SET stock = stock - 15", "UPDATE depot SET label = NULL WHERE code = 2", "INSERT INTO depot VALUES (4, 'a', 1), (4, 'b', 1)",
        "MERGE INTO depot AS t USING (SELECT 1 AS code, 5 AS s UNION ALL SELECT 1, 6) AS s ON t.code = s.code WHEN MATCHED THEN UPDATE SET stock = s.s; SELECT * INTO seen FROM depot; DELETE FROM seen WHERE code = 1; INSERT INTO depot SELECT code, label, stock FROM seen",
    ],
)
def test_rules_are_kept(depot, change):
    before = rows(depot.frame("depot"))
    with pytest.raises(Exception, match="violations|more than once"):
        depot.run(change)
        depot.frame("depot").collect()
    assert rows(depot.frame("depot")) == before


def test_defaults_and_declared_keys(depot):
    depot.run("INSERT INTO depot (code, label) VALUES (4, 'east')")
    depot.run("INSERT OR REPLACE INTO depot (label, code, stock) VALUES ('centre', 2, 21)", "postgres")
    depot.run("INSERT INTO depot (label, code, stock) VALUES ('up', 1, 5) ON DUPLICATE KEY UPDATE stock = stock + VALUES(stock)", "mysql")
    assert rows(depot.frame("depot")) == [(1, "north", 15), (2, "centre", 21), (3, "west", 30), (4, "east", 7)]


def test_output_and_returning(depot):
    out = depot.run("UPDATE depot SET stock = stock + 1 OUTPUT deleted.stock AS was, inserted.stock AS now WHERE code > 1; DELETE FROM depot OUTPUT deleted.label WHERE code = 3; INSERT INTO depot (code, label) OUTPUT inserted.code, inserted.stock VALUES (8, 'new')")
    assert [rows(r) for r in out.results] == [[(20, 21), (30, 31)], [("west",)], [(8, 7)]]
    out = depot.run("DELETE FROM depot WHERE code = 8 RETURNING code, label; UPDATE depot SET stock = 0 RETURNING *", "postgres")
    assert [rows(r) for r in out.results] == [[(8, "new")], [(1, "north", 0), (2, "south", 0)]]


def test_changes_through_a_cte(depot):
    depot.run("WITH big AS (SELECT code, stock FROM depot WHERE stock > 15) UPDATE big SET stock = stock * 2 WHERE code < 3")
    depot.run("WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY stock DESC) AS place FROM depot) DELETE FROM r WHERE place = 1")
    assert rows(depot.frame("depot")) == [(1, "north", 10), (3, "west", 30)]


def test_dynamic_texts_counts_and_messages(depot):
    out = depot.run("DECLARE @n INT; EXEC('DELETE FROM depot WHERE code = 1'); UPDATE depot SET stock = 1 WHERE code = 2; SET @n = @@ROWCOUNT; EXEC sp_executesql N'SELECT COUNT(*) AS n FROM depot'; BEGIN TRY THROW 50000, 'broken', 1; END TRY BEGIN CATCH PRINT ERROR_MESSAGE(); END CATCH")
    assert out.results[0].first()[0] == 2 and out.variables["@n"] == 1 and out.messages == ["broken"]
    with pytest.raises(DialectError, match="procedures"):
        depot.run("EXEC some_procedure")
