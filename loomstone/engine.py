"""The engine: tables, dialect queries, scripts and table changes in one session."""

from __future__ import annotations

import hashlib
import re
import tempfile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import functions
from .builder import Query
from .operators.relational import limited
from .plans import dialect, script
from .plans.lexer import DialectError, statements


def _tables(engine) -> DataFrame:
    return engine.spark.createDataFrame([(n, i, "dbo", "BASE TABLE", "U") for i, n in enumerate(engine.names(), 1)], "name string, object_id int, schema_name string, table_type string, type string")


def _columns(engine) -> DataFrame:
    rows = [(n, i, f.name, k, f.dataType.simpleString(), f.nullable) for i, n in enumerate(engine.names(), 1) for k, f in enumerate(engine.frame(n).schema.fields, 1)]
    return engine.spark.createDataFrame(rows, "table_name string, object_id int, name string, column_id int, type_name string, is_nullable boolean")


#: Catalog sources by the names that queries give them.
CATALOG = {
    "information_schema.tables": lambda e: _tables(e).selectExpr("schema_name AS TABLE_SCHEMA", "name AS TABLE_NAME", "table_type AS TABLE_TYPE"),
    "information_schema.columns": lambda e: _columns(e).selectExpr("table_name AS TABLE_NAME", "name AS COLUMN_NAME", "column_id AS ORDINAL_POSITION", "type_name AS DATA_TYPE", "if(is_nullable, 'YES', 'NO') AS IS_NULLABLE"),
    "sys.tables": _tables,
    "sys.objects": _tables,
    "sys.columns": _columns,
    "sys.schemas": lambda e: e.spark.createDataFrame([("dbo", 1)], "name string, schema_id int"),
}


class Migration(NamedTuple):
    """A step of a schema's history."""

    version: int
    script: str


class Engine:
    """Named DataFrames as tables of a session.

    A change of a table makes a new DataFrame under its name. ``save`` writes tables as Parquet; plans
    of tables that are changed often are cut by ``settle`` in the session's checkpoint folder.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, default_dialect: str = "tsql"):
        self.spark, self.default_dialect = spark, default_dialect
        self._frames: dict[str, DataFrame] = {}
        self.constraints: dict[str, script.Constraints] = {}
        functions.register(spark)
        for name, df in (tables or {}).items():
            self.replace(name, df)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: list[str], default_dialect: str = "tsql") -> Engine:
        """An engine over the Parquet tables of a folder."""
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, default_dialect)

    # ---- tables

    def frame(self, name: str) -> DataFrame:
        try:
            return self._frames[name.lower()]
        except KeyError:
            raise DialectError(f"no table {name}") from None

    def replace(self, name: str, df: DataFrame) -> None:
        self._frames[name.lower()] = df
        df.createOrReplaceTempView(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        self.constraints.pop(name.lower(), None)
        if self._frames.pop(name.lower(), None) is None and not if_exists:
            raise DialectError(f"no table {name}")
        self.spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self._frames)

    def rows(self, name: str, rows) -> DataFrame:
        """Rows given as dictionaries, typed as the table's columns; a DataFrame as it is."""
        if isinstance(rows, DataFrame):
            return rows
        rows = [rows] if isinstance(rows, dict) else list(rows)
        given = {k for r in rows for k in r}
        schema = self.frame(name).schema
        if unknown := given - set(schema.names):
            raise DialectError(f"no such columns: {sorted(unknown)}")
        fields = [f for f in schema.fields if f.name in given]
        kind = type(schema)(fields)
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], kind)

    def checkpointed(self, df: DataFrame) -> DataFrame:
        """A copy in the shared checkpoint folder; where the session names none, in a temporary one."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(self.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomstone-"))
        return df.checkpoint()

    def settle(self, name: str) -> None:
        self.replace(name, self.checkpointed(self.frame(name)))

    def save(self, name: str, path: str) -> None:
        self.frame(name).write.mode("errorifexists").parquet(path)

    def table(self, name: str) -> Query:
        self.frame(name)
        return Query(self, name)

    # ---- queries

    def _catalog(self, text: str) -> str:
        """Registers the catalog views that a text names, and names them in a way that Spark reads."""
        low = text.lower()
        for name, make in CATALOG.items():
            if name in low:
                view = "catalog_" + name.replace(".", "_")
                make(self).createOrReplaceTempView(view)
                text = re.sub(rf"(?i)\b{re.escape(name)}\b", view, text)
        return text

    def sql(self, text: str, dialect_name: str | None = None, params: dict | None = None) -> DataFrame:
        """One query of a dialect; parameters are Python values by name (``@x``, ``:x``)."""
        values = {k: script.literal(v) for k, v in (params or {}).items()}
        text = self._catalog(text)
        return dialect.select(self.spark, text, dialect_name or self.default_dialect, values)

    def query(self, text: str, dialect_name: str | None = None, params: dict | None = None, max_rows: int = 10_000) -> list[dict]:
        """The rows of one query; too many raise instead of being cut."""
        return [r.asDict(True) for r in limited(self.sql(text, dialect_name, params), max_rows)]

    def run(self, text: str, dialect_name: str | None = None) -> script.Outcome:
        """A script: all statements in order; an error leaves the tables as they were before it."""
        name = dialect_name or self.default_dialect
        items = []
        for s in statements(text, name):
            items += [*s, script.END_OF_STATEMENT]
        before, rules = dict(self._frames), dict(self.constraints)
        try:
            return script.Runner(self, name).run(items)
        except Exception:
            for k in set(self._frames) - set(before):
                self.drop(k)
            for k, df in before.items():
                self.replace(k, df)
            self.constraints = rules
            raise

    def migrate(self, steps: list[Migration], applied: dict[int, str] | None = None, dialect_name: str | None = None) -> dict[int, str]:
        """Run the steps that were not applied yet, all or none; returns version to checksum of all applied.

        Versions must rise, and a step that was applied must not have changed since.
        """
        done = dict(applied or {})
        if [s.version for s in steps] != sorted({s.version for s in steps}):
            raise DialectError("versions of migrations must rise")
        sums = {s.version: hashlib.sha256(s.script.encode()).hexdigest() for s in steps}
        if drift := [v for v, c in done.items() if sums.get(v, c) != c]:
            raise DialectError(f"migrations {drift} have changed since they were applied")
        pending = [s for s in steps if s.version not in done]
        if pending and done and pending[0].version < max(done):
            raise DialectError(f"migration {pending[0].version} is older than one that was applied")
        if pending:
            self.run(";\n".join(s.script for s in pending), dialect_name)
        return done | {s.version: sums[s.version] for s in pending}
