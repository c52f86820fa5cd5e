"""Files in and out, and renderings of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder, registered as views."""
    out = {}
    for n in names:
        out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, skip_bad_rows: bool = False) -> DataFrame:
    """A CSV file with a header; bad rows fail the read unless they are to be skipped. Without a schema types are inferred."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "DROPMALFORMED" if skip_bad_rows else "FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def insert_statements(df: DataFrame, table: str = "exported_data") -> DataFrame:
    """One INSERT statement a row, as text; ``write.text`` makes a dump of it."""
    values = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        if kind in ("byte", "short", "integer", "long", "double", "float", "decimal"):
            text = c.cast("string")
        elif kind == "boolean":
            text = c.cast("int").cast("string")
        elif kind == "binary":
            text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
        values.append(F.coalesce(text, F.lit("NULL")))
    names = ", ".join(f'"{c}"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *values), F.lit(");")).alias("value"))


def render(df: DataFrame, mode: str = "table", max_rows: int = 1000) -> str:
    """A small result as text: table, line, csv or json."""
    from ..operators.relational import limited

    rows = limited(df, max_rows)
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if mode == "json":
        return json.dumps([r.asDict(True) for r in rows], ensure_ascii=False, indent=2, default=str)
    if mode == "csv":
        quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
        return "\n".join(",".join(map(quoted, r)) for r in [df.columns, *cells]) + "\n"
    if mode == "line":
        width = max(map(len, df.columns))
        return "\n\n".join("\n".join(f"{c:>{width}} = {v}" for c, v in zip(df.columns, r, strict=True)) for r in cells)
    widths = [max(len(x) for x in col) for col in zip(df.columns, *cells, strict=True)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in [df.columns, *cells]]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def catalog_tables(spark: SparkSession) -> DataFrame:
    """(name, kind) of all tables and views of the session."""
    return spark.createDataFrame([(t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in spark.catalog.listTables()], "name string, kind string")


def catalog_columns(spark: SparkSession, table: str) -> DataFrame:
    """(name, position, type, nullable) of a table's columns."""
    fields = spark.table(table).schema.fields
    return spark.createDataFrame([(f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields, 1)], "name string, position int, type string, nullable boolean")
