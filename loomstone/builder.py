"""A fluent query builder over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.strings import quote
from .operators import mutations


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else quote(v) if isinstance(v, str) else repr(v)


class Query:
    """Steps return new queries; nothing runs before ``get``, ``first`` or ``count``."""

    def __init__(self, engine, name: str, columns=("*",), filters=(), order=(), n=None, skip=0):
        self._engine, self._name, self._columns, self._filters, self._order, self._n, self._skip = engine, name, tuple(columns), tuple(filters), tuple(order), n, skip

    def _with(self, **new) -> Query:
        now = {"columns": self._columns, "filters": self._filters, "order": self._order, "n": self._n, "skip": self._skip}
        return Query(self._engine, self._name, **(now | new))

    def select(self, *columns: str) -> Query:
        return self._with(columns=columns)

    def where(self, condition: dict | str, params: list | None = None) -> Query:
        """Equalities (None: is null, a list: in), or a SQL text with ? for parameters."""
        if isinstance(condition, dict):
            new = [f"`{k}` IS NULL" if v is None else f"`{k}` IN ({', '.join(map(_literal, v))})" if isinstance(v, (list, tuple)) else f"`{k}` = {_literal(v)}" for k, v in condition.items()]
        else:
            parts = condition.split("?")
            if len(parts) - 1 != len(params or []):
                raise ValueError("as many parameters as question marks are needed")
            new = ["(" + parts[0] + "".join(_literal(p) + t for p, t in zip(params or [], parts[1:], strict=True)) + ")"]
        return self._with(filters=(*self._filters, *new))

    def order_by(self, *columns: str) -> Query:
        """Names; a leading minus sorts downwards."""
        return self._with(order=(*self._order, *columns))

    def limit(self, n: int) -> Query:
        return self._with(n=n)

    def offset(self, n: int) -> Query:
        return self._with(skip=n)

    def to_sql(self) -> str:
        order = ", ".join(f"`{c[1:]}` DESC" if c.startswith("-") else f"`{c}`" for c in self._order)
        return " ".join(x for x in (f"SELECT {', '.join(self._columns)} FROM `{self._name}`", self._filters and f"WHERE {' AND '.join(self._filters)}", order and f"ORDER BY {order}", self._n is not None and f"LIMIT {self._n}", self._skip and f"OFFSET {self._skip}") if x)

    def df(self) -> DataFrame:
        return self._engine.spark.sql(self.to_sql())

    def get(self, max_rows: int = 10_000) -> list[dict]:
        from .operators.relational import limited

        return [r.asDict(True) for r in limited(self.df(), max_rows)]

    def first(self) -> dict | None:
        rows = self.limit(1).df().collect()
        return rows[0].asDict(True) if rows else None

    def count(self) -> int:
        return self.df().count()

    def _condition(self) -> Column | None:
        return F.expr(" AND ".join(self._filters)) if self._filters else None

    def insert(self, rows: list[dict] | dict | DataFrame) -> None:
        self._engine.replace(self._name, mutations.insert(self._engine.frame(self._name), self._engine.rows(self._name, rows)))

    def upsert(self, rows: list[dict] | dict | DataFrame, keys: list[str]) -> None:
        self._engine.replace(self._name, mutations.upsert(self._engine.frame(self._name), self._engine.rows(self._name, rows), keys))

    def update(self, values: dict) -> None:
        self._engine.replace(self._name, mutations.update(self._engine.frame(self._name), {k: _literal(v) for k, v in values.items()}, self._condition()))

    def delete(self) -> None:
        self._engine.replace(self._name, mutations.delete(self._engine.frame(self._name), self._condition()))
