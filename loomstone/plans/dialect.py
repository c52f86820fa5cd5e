"""Front-ends that turn T-SQL, PostgreSQL and MySQL queries into Spark SQL.

A statement is lexed, put into a tree of parentheses and written again as Spark SQL; literals are
never touched as text. What Spark would answer differently is rewritten (case-insensitive LIKE,
integer division, set operations from left to right, quantified comparisons, TOP, APPLY), and what
cannot be run faithfully is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import maths
from ..functions.strings import quote
from ..operators import relational
from .lexer import DialectError, Group, Tok, find, split, statements

DIALECTS = ("tsql", "postgres", "mysql")

#: Words that are no operands and end one.
KEYWORDS = set(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION ALL INTERSECT EXCEPT DISTINCT AS ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL LATERAL AND OR NOT IN IS LIKE ILIKE RLIKE REGEXP GLOB BETWEEN "
    "EXISTS WHEN THEN ELSE END ASC DESC NULLS FIRST LAST WITH RECURSIVE VALUES SET OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW WINDOW FILTER WITHIN ESCAPE FETCH NEXT ONLY ANY SOME PIVOT UNPIVOT FOR DIV MOD XOR "
    "TABLESAMPLE ROLLUP CUBE GROUPING SETS INTERVAL SEPARATOR COLLATE APPLY TOP INTO SEMI ANTI MATCH OPTION STRAIGHT_JOIN BINARY".split()
)
#: Functions of the standard that Spark has under the same name; nothing else needs to be known of them.
_REFUSED = {
    "EDIT_DISTANCE", "EDIT_DISTANCE_SIMILARITY", "JARO_WINKLER_DISTANCE", "JARO_WINKLER_SIMILARITY", "REGEXP_MATCHES", "REGEXP_SPLIT_TO_TABLE", "SWITCHOFFSET", "TODATETIMEOFFSET", "OPENXML", "OPENROWSET", "OPENQUERY",
}
_PART_FUNCTIONS = {"DATEPART", "DATENAME", "DATEADD", "DATEDIFF", "DATEDIFF_BIG", "DATETRUNC", "DATE_BUCKET"}
_SETS = ("UNION", "INTERSECT", "EXCEPT")
_RANKINGS = ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE")
#: Words of a SELECT whose rows are more, fewer or in another order than those of its FROM and WHERE.
_NOT_PLAIN = ("DISTINCT", "TOP", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "INTO", "WINDOW", "FOR", "OPTION", *_SETS)
STAR = "*"


class Atom:
    """A piece of output: an operand, an operator or a keyword; ``text`` is its literal value if it is a string."""

    __slots__ = ("kind", "literal", "sql")

    def __init__(self, kind: str, sql: str, literal: bool = False):
        self.kind, self.sql, self.literal = kind, sql, literal


class Translator:
    """Writes the queries of one dialect as Spark SQL."""

    def __init__(self, dialect: str, params: dict[str, str] | None = None):
        if dialect not in DIALECTS:
            raise DialectError(f"unknown dialect {dialect}")
        self.dialect, self.params = dialect, {k.lower(): v for k, v in (params or {}).items()}

    # ---- queries

    def query(self, items: list, numbered: bool = False) -> str:
        """A query: CTEs, set operations from left to right, ORDER BY and LIMIT; ``numbered``: see _numbered."""
        items = self._tail(self._without_hints(items))
        items, limit = items
        if items and items[0].up == "WITH":
            at, ctes = 1, []
            if items[at].up == "RECURSIVE":
                at += 1
            recursive = False
            while True:
                name = self._name(items[at])
                at += 1
                columns = ""
                if isinstance(items[at], Group):
                    columns = self.expression([items[at]])
                    at += 1
                if items[at].up != "AS":
                    raise DialectError("AS expected in WITH")
                body = items[at + 1]
                at += 2
                recursive |= self._mentions(body, name)
                ctes.append((f"`{name}`{' ' + columns if columns else ''}", body, self._mentions(body, name)))
                if at < len(items) and items[at].kind == "op" and items[at].text == ",":
                    at += 1
                    continue
                break
            level = f" MAX RECURSION LEVEL {self._recursion}" if getattr(self, "_recursion", None) else " MAX RECURSION LEVEL 10000"
            heads = [f"{head}{level if own else ''} AS ({self.query(body.items)})" for head, body, own in ctes]
            return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(heads)} {self._limited(items[at:], limit, numbered)}"
        return self._limited(items, limit, numbered)

    def _limited(self, items: list, limit: str, numbered: bool) -> str:
        if numbered and (sql := self._numbered(items, limit)):
            return sql
        parts, ops = self._set_operations(items)
        if len(parts) == 1:
            return self.block(parts[0], numbered) + limit
        order = ""
        if (at := find(parts[-1], "ORDER", "BY")) >= 0 and parts[-1][0].up == "SELECT":
            order = " " + self.expression(parts[-1][at:])
            parts[-1] = parts[-1][:at]
        out = self._operand(parts[0])
        for i, (op, part) in enumerate(zip(ops, parts[1:], strict=True)):
            # an INTERSECT would bind tighter than what stands before it
            out = f"({out})" if i and "INTERSECT" in ops else out
            out = f"{out} {op} {self._operand(part)}"
        return out + order + limit

    def _numbered(self, items: list, limit: str) -> str | None:
        """A subquery that takes the first rows of an order, by row numbers; None if it has no order or no limit.

        Spark numbers the rows of a correlated LIMIT as a shuffle brings them, whatever their ORDER BY; a window
        keeps its order.
        """
        if not items or items[0].up != "SELECT" or (by := find(items, "ORDER", "BY")) < 0:
            return None
        sets = any(find(items[:by], w) >= 0 for w in _SETS)
        head, top = (items[:by], "") if sets else self._top(items[:by])
        if not (limit or top):
            return None
        n, _, offset = (limit or top).strip().removeprefix("LIMIT ").partition("OFFSET ")
        n, offset = n.strip(), offset.strip()
        at = next((i for i, x in enumerate(head) if x.up == "FROM" and head[i - 1].up != "DISTINCT"), -1)
        keys = split(items[by + 2 :], ",")
        spell = lambda xs: [(x.kind, x.items and spell(x.items)) if isinstance(x, Group) else x.text.lower() for x in xs]
        start = 2 if head[1].up in ("DISTINCT", "ALL") else 1
        columns = [self._column(c) for c in split(head[start : at if at >= 0 else len(head)], ",")]
        whole = at < 0 or head[1].up == "DISTINCT" or sets or (self.dialect == "mysql" and find(head, "HAVING") >= 0)
        for k, key in enumerate(keys):
            cut = next((i for i, x in enumerate(key) if x.up in ("ASC", "DESC", "NULLS")), len(key))
            what, rest = key[:cut], key[cut:]
            if len(what) == 1 and what[0].kind == "number" and what[0].text.isdigit():
                column = columns[int(what[0].text) - 1] if int(what[0].text) <= len(columns) else ([], None)
                if not column[0] or getattr(column[0][-1], "text", "") == "*" or (whole and not column[1]):
                    raise DialectError("ORDER BY a position needs a named column in a subquery")
            else:
                column = next((c for c in columns if c[1] and ((len(what) == 1 and getattr(what[0], "text", "").lower() == c[1].text.lower()) or (whole and spell(what) == spell(c[0])))), None)
            keys[k] = ([column[1]] if whole else column[0]) + rest if column else key
        order = ", ".join(self.expression(k) for k in keys)
        number = f"row_number() OVER (ORDER BY {order}) AS __n"
        rows = f"{self.expression(head[:at])}, {number} {self.expression(head[at:])}" if not whole else f"SELECT *, {number} FROM ({self.query(head)})"
        kept = [f"__n > {offset}"] * bool(offset) + [f"__n <= {f'{n} + {offset}' if offset else n}"] * bool(n)
        return f"SELECT * EXCEPT (__n) FROM ({rows}) WHERE {' AND '.join(kept)}"

    def rankings(self, items: list) -> tuple[str, list, list[relational.Ranking]] | None:
        """A plain SELECT with rankings: the query of its other columns and then of what is ranked by, its columns
        (None for one as it is, STAR, or a ranking's column and name) and the rankings; None for other queries."""
        items = self._without_hints(items)
        at = next((i for i, x in enumerate(items) if x.up == "FROM" and items[i - 1].up != "DISTINCT"), -1)
        if at < 0 or items[0].up != "SELECT" or any(x.up in _NOT_PLAIN for x in items):
            return None
        plain, columns, found, helpers = [], [], [], {}
        helper = lambda xs: helpers.setdefault(self.expression(xs), f"__w{len(helpers)}")
        for item in split(items[1:at], ","):
            expr, name = self._column(item)
            if len(expr) == 4 and expr[0].up in _RANKINGS and expr[2].up == "OVER" and isinstance(expr[1], Group) and isinstance(expr[3], Group) and name:
                over, tiles = expr[3].items, expr[1].items
                by = find(over, "ORDER", "BY")
                if by < 0 or find(over, "ROWS") >= 0 or find(over, "RANGE") >= 0 or (over[0].up != "PARTITION" and by) or (expr[0].up == "NTILE" and not (len(tiles) == 1 and tiles[0].kind == "number" and tiles[0].text.isdigit())):
                    return None
                order = []
                for key in split(over[by + 2 :], ","):
                    cut = next((i for i, x in enumerate(key) if x.up in ("ASC", "DESC", "NULLS")), len(key))
                    words = [x.up for x in key[cut:]]
                    order.append((helper(key[:cut]), "DESC" in words, "FIRST" in words if "NULLS" in words else None))
                found.append(relational.Ranking(f"__r{len(found)}", expr[0].up, tuple(dict.fromkeys(helper(k) for k in split(over[2:by], ","))), tuple(order), tiles[0].text if tiles else ""))
                columns.append((found[-1].name, self._name(name)))
                continue
            plain.append(self.expression(item))
            columns.append(STAR if getattr(item[-1], "text", "") == "*" else None)
        if not found or columns.count(STAR) > 1:
            return None
        kept = [*plain, *(f"{sql} AS {name}" for sql, name in helpers.items())]
        return f"SELECT {', '.join(kept)} {self.expression(items[at:])}", columns, found

    def _column(self, items: list) -> tuple[list, Tok | None]:
        """The expression of a select item and its name, if it has one."""
        last = items[-1] if items else None
        if last is None or isinstance(last, Group) or last.kind not in ("word", "ident"):
            return items, None
        if len(items) > 2 and items[-2].up == "AS":
            return items[:-2], last
        before = items[-2] if len(items) > 1 else None
        if before is not None and last.up not in KEYWORDS and (isinstance(before, Group) or before.kind in ("word", "ident", "string", "number")):
            return items[:-1], last
        return items, last if before is None or (before.kind == "op" and before.text == ".") else None

    def _operand(self, part: list) -> str:
        if len(part) == 1 and isinstance(part[0], Group):
            return f"({self.query(part[0].items)})"
        return self.query(part)

    def _set_operations(self, items: list) -> tuple[list[list], list[str]]:
        parts, ops, i = [[]], [], 0
        while i < len(items):
            if items[i].up in _SETS:
                op = items[i].up
                if i + 1 < len(items) and items[i + 1].up in ("ALL", "DISTINCT"):
                    op += " " + items[i + 1].up
                    i += 1
                ops.append(op)
                parts.append([])
            else:
                parts[-1].append(items[i])
            i += 1
        return parts, ops

    def _mentions(self, node, name: str) -> bool:
        if isinstance(node, Group):
            return any(self._mentions(x, name) for x in node.items)
        return node.kind in ("word", "ident") and node.text.lower() == name.lower()

    def _without_hints(self, items: list) -> list:
        out, i = [], 0
        while i < len(items):
            x, after = items[i], items[i + 1] if i + 1 < len(items) else None
            if x.up == "OPTION" and isinstance(after, Group):
                if (at := find(after.items, "MAXRECURSION")) >= 0:
                    n = int(after.items[at + 1].text)
                    self._recursion = n or 1_000_000
                i += 2
            elif x.up == "WITH" and isinstance(after, Group) and out and all(y.up in _HINTS or (y.kind == "op" and y.text == ",") for y in after.items):
                i += 2
            elif x.up == "TABLESAMPLE":
                i += 2 + (isinstance(items[i + 2], Group) if i + 2 < len(items) and not isinstance(after, Group) else 0)
                if i < len(items) and items[i].up == "REPEATABLE":
                    i += 2
            elif x.up == "STRAIGHT_JOIN":
                out.append(Tok("word", "JOIN"))
                i += 1
            elif x.up == "FOR" and after is not None and after.up in ("JSON", "XML"):
                if after.up == "XML":
                    raise DialectError("FOR XML is not supported")
                break
            else:
                out.append(x)
                i += 1
        return out

    def _tail(self, items: list) -> tuple[list, str]:
        """Takes LIMIT, OFFSET and FETCH off the end."""
        if (at := find(items, "FETCH")) >= 0 and items[at + 1].up in ("NEXT", "FIRST"):
            n = self.expression([items[at + 2]])
            o = find(items, "OFFSET")
            offset = self.expression([items[o + 1]]) if o >= 0 else None
            return items[: o if o >= 0 else at], f" LIMIT {n}" + (f" OFFSET {offset}" if offset else "")
        if self.dialect == "tsql" and (o := find(items, "OFFSET")) >= 0 and o + 2 < len(items) and items[o + 2].up in ("ROWS", "ROW"):
            return items[:o], f" OFFSET {self.expression([items[o + 1]])}"
        at = find(items, "LIMIT")
        o = find(items, "OFFSET")
        if at < 0 and o < 0:
            return items, ""
        cut = min(x for x in (at, o) if x >= 0)
        n = offset = None
        if at >= 0:
            rest = items[at + 1 : o if o > at else len(items)]
            if len(parts := split(rest, ",")) == 2:
                offset, n = (self.expression(p) for p in parts)
            elif rest[0].up != "ALL":
                n = self.expression(rest)
        if o >= 0:
            offset = self.expression(items[o + 1 : at if at > o else len(items)])
        return items[:cut], (f" LIMIT {n}" if n else "") + (f" OFFSET {offset}" if offset else "")

    def _top(self, items: list) -> tuple[list, str]:
        """Takes TOP out of a SELECT."""
        limit, at = "", 1
        if at < len(items) and items[at].up in ("DISTINCT", "ALL"):
            at += 1
        if at < len(items) and items[at].up == "ON" and items[at - 1].up == "DISTINCT":
            raise DialectError("DISTINCT ON is not supported: use ROW_NUMBER() ... = 1")
        if self.dialect == "tsql" and at < len(items) and items[at].up == "TOP":
            n = items[at + 1]
            limit = f" LIMIT {self.expression(n.items if isinstance(n, Group) else [n])}"
            if items[at + 2].up == "PERCENT" or (items[at + 2].up == "WITH" and items[at + 3].up == "TIES"):
                raise DialectError("TOP PERCENT and WITH TIES are not supported")
            items = items[:at] + items[at + 2 :]
        return items, limit

    def block(self, items: list, numbered: bool = False) -> str:
        """One SELECT, VALUES or parenthesised query."""
        if len(items) == 1 and isinstance(items[0], Group):
            return f"({self.query(items[0].items, numbered)})"
        if not items or items[0].up != "SELECT":
            return self.expression(items)
        items, limit = self._top(items)
        if self.dialect == "mysql" and find(items, "HAVING") >= 0 and find(items, "GROUP", "BY") < 0:
            h = find(items, "HAVING")
            end = min(x for x in (find(items, "ORDER", "BY"), len(items)) if x >= 0)
            inner, cond, rest = items[:h], items[h + 1 : end], items[end:]
            return f"SELECT * FROM ({self.expression(inner)}) AS having_rows WHERE {self.expression(cond)} {self.expression(rest)}".rstrip() + limit
        return self.expression(items) + limit

    # ---- expressions

    def expression(self, items: list) -> str:
        """Any run of items."""
        return self.join(self.atoms(items))

    def join(self, atoms: list[Atom]) -> str:
        out = ""
        for a in atoms:
            tight = a.sql in (",", ".") or out.endswith(".") or not out
            out += a.sql if tight else " " + a.sql
        return out

    def atoms(self, items: list) -> list[Atom]:
        """Operands, operators and keywords of a run of items, rewritten."""
        out: list[Atom] = []
        i = 0
        in_from = False
        while i < len(items):
            x = items[i]
            if x.up in ("FROM", "JOIN", "APPLY"):
                in_from = True
            elif x.up in ("WHERE", "SELECT", "ON", "GROUP", "HAVING", "ORDER", "SET", "WINDOW", *_SETS):
                in_from = False
            i = self._one(items, i, out, in_from)
        return self._operators(out)

    def _name(self, x) -> str:
        text = x.text
        if text.startswith("#"):
            text = "temp_" + text.lstrip("#")
        return text

    def _one(self, items: list, i: int, out: list[Atom], in_from: bool) -> int:
        x = items[i]
        after = items[i + 1] if i + 1 < len(items) else None
        up = x.up
        if isinstance(x, Group):
            out.append(Atom("operand", f"({self._inner(x, not in_from or (bool(out) and out[-1].sql == 'LATERAL'))})"))
            return i + 1
        if x.kind == "string":
            out.append(Atom("operand", quote(x.text), True))
            return i + 1
        if x.kind == "number":
            hexa = x.text[:2].lower() == "0x"
            real = re.search(r"[.eE]", x.text) and not hexa
            out.append(Atom("operand", f"X'{x.text[2:]}'" if hexa else x.text + "D" if real else x.text))
            return i + 1
        if x.kind == "param":
            out.append(Atom("operand", self._param(x.text)))
            return i + 1
        if x.kind == "op" and x.text == ":" and after is not None and after.kind == "word":
            out.append(Atom("operand", self._param(":" + after.text)))
            return i + 2
        if x.kind == "op":
            if x.text == "[" or x.text == "]":
                raise DialectError("array subscripts are not supported")
            out.append(Atom("op", x.text))
            return i + 1
        if up == "CASE":
            depth, j = 0, i
            while j < len(items):
                depth += items[j].up == "CASE"
                depth -= items[j].up == "END"
                if not depth:
                    break
                j += 1
            out.append(Atom("operand", f"CASE {self.expression(items[i + 1 : j])} END"))
            return j + 1
        if up in ("CROSS", "OUTER") and after is not None and after.up == "APPLY":
            return self._apply(items, i, out)
        if up == "MATCH" and isinstance(after, Group) and self.dialect == "tsql":
            out.append(Atom("operand", self._match(after.items)))
            return i + 2
        if up in ("PIVOT", "UNPIVOT") and isinstance(after, Group):
            # Spark knows no alias after it: the source so far and the pivot become a subquery
            k = max(n for n, a in enumerate(out) if a.sql == "FROM")
            source, j = f"{self.join(self._operators(out[k + 1 :]))} {self._pivot(up, after.items)}", i + 2
            j += j < len(items) and items[j].up == "AS"
            alias = ""
            if j < len(items) and items[j].kind in ("word", "ident") and items[j].up not in KEYWORDS:
                alias, j = f" AS `{self._name(items[j])}`", j + 1
            out[k + 1 :] = [Atom("operand", f"(SELECT * FROM {source}){alias}")]
            return j
        if up == "COLLATE" and after is not None:
            name = after.text.upper()
            if "_AI" in name:
                raise DialectError("accent-insensitive collations are not supported")
            known = "UTF8_LCASE" if "_CI" in name or name == "NOCASE" else "UTF8_BINARY"
            out.append(Atom("word", f"COLLATE {known}"))
            return i + 2
        if up == "AT" and after is not None and after.up == "TIME":
            raise DialectError("AT TIME ZONE is not supported")
        if up == "INTERVAL" and after is not None:
            unit = items[i + 2].text
            out.append(Atom("operand", f"make_interval_of({self.expression([after])}, {unit})"))
            return i + 3
        if up in ("ANY", "ALL", "SOME") and isinstance(after, Group) and out and out[-1].kind == "op":
            return self._quantified(items, i, out)
        if self.dialect == "postgres" and up == "ARRAY":
            raise DialectError("ARRAY values are not supported")
        quantity = isinstance(after, Group) and (up not in KEYWORDS or up in ("LEFT", "RIGHT", "MOD", "REGEXP", "GLOB", "SET", "REPLACE")) and x.kind == "word"
        if quantity and not (out and out[-1].sql.upper() in ("AS", "RECURSIVE", "INTO")) and not (up in ("LEFT", "RIGHT") and in_from and not after.items):
            return self._call(items, i, out, in_from)
        if up in KEYWORDS and not (out and out[-1].sql == "."):
            out.append(Atom("word", x.text.upper()))
            return i + 1
        # a name, maybe of several parts
        parts, j = [self._name(x)], i
        quoted = [x.kind == "ident" or x.text.startswith("#")]
        while j + 2 < len(items) and items[j + 1].kind == "op" and items[j + 1].text == "." and (items[j + 2].kind in ("word", "ident") or (items[j + 2].kind == "op" and items[j + 2].text == "*")):
            if j + 3 < len(items) and isinstance(items[j + 3], Group) and items[j + 2].kind == "word" and not in_from:
                break
            parts.append(self._name(items[j + 2]))
            quoted.append(items[j + 2].kind == "ident")
            j += 2
        if self.dialect in ("tsql", "postgres") and len(parts) > 1 and parts[0].lower() in ("dbo", "public"):
            parts, quoted = parts[1:], quoted[1:]
        literal = {"TRUE": "TRUE", "FALSE": "FALSE", "NULL": "NULL"}.get(x.up) if len(parts) == 1 else None
        out.append(Atom("operand", literal or ".".join(f"`{p}`" if q and p != "*" else p for p, q in zip(parts, quoted, strict=True))))
        j += 1
        if literal is None and len(parts) == 1 and x.up in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_USER", "SYSDATETIME"):
            out[-1].sql = f"{x.text.lower()}()"
        return j

    def _inner(self, g: Group, numbered: bool = False) -> str:
        return self.query(g.items, numbered) if g.items and g.items[0].up in ("SELECT", "WITH", "VALUES") or (g.items and isinstance(g.items[0], Group) and any(y.up in _SETS for y in g.items)) else self.expression(g.items)

    def _param(self, name: str) -> str:
        key = name.lower()
        if key in self.params:
            return self.params[key]
        known = {"@@version": "version()", "@@servername": "'localhost'", "@@spid": "1", "@@language": "'us_english'", "@@trancount": "0"}
        if key in known:
            return known[key]
        if key.startswith(":"):
            return name
        raise DialectError(f"unknown variable {name}")

    # ---- calls

    def _args(self, g: Group) -> list[str]:
        return [self.query(p) if p and p[0].up in ("SELECT", "WITH") else self.expression(p) for p in split(g.items, ",")]

    def _call(self, items: list, i: int, out: list[Atom], in_from: bool) -> int:
        name, g, j = items[i].text, items[i + 1], i + 2
        up = name.upper()
        if up in _REFUSED:
            raise DialectError(f"{up} is not supported")
        if in_from and up in _TABLE_FUNCTIONS and (not out or out[-1].sql in ("FROM", "JOIN", ",", "LATERAL")):
            sql, j = self._table_function(up, items, i)
            out.append(Atom("operand", sql))
            return j
        if in_from and out and out[-1].sql in ("FROM", "JOIN"):
            out.append(Atom("operand", f"{name}({', '.join(self._args(g))})"))
            return j
        sql = self._special(up, g)
        if sql is None and up in ("STRING_AGG", "LISTAGG") and find(items, "WITHIN", "GROUP", start=j) == j:
            args = self._args(g)
            sql = f"listagg(cast({args[0]} as string), {args[1]}) WITHIN GROUP ({self.expression(items[j + 2].items)})"
            j += 3
        elif sql is None and up.replace("APPROX_", "") in ("PERCENTILE_CONT", "PERCENTILE_DISC") and find(items, "WITHIN", "GROUP", start=j) == j:
            sql = f"{up.replace('APPROX_', '').lower()}({', '.join(self._args(g))}) WITHIN GROUP ({self.expression(items[j + 2].items)})"
            j += 3
        if sql is None:
            args = self._args(g)
            rule = self._rule(up)
            distinct = g.items and g.items[0].up == "DISTINCT"
            if rule and not distinct:
                try:
                    sql = rule(*args)
                except TypeError:
                    raise DialectError(f"wrong number of arguments for {up}") from None
            else:
                sql = f"{name}({', '.join(args)})"
        if j < len(items) and items[j].up == "FILTER" and isinstance(items[j + 1], Group):
            sql += f" FILTER ({self.expression(items[j + 1].items)})"
            j += 2
        if j < len(items) and items[j].up == "OVER":
            if isinstance(items[j + 1], Group):
                sql += f" OVER ({self.expression(items[j + 1].items)})"
            else:
                sql += f" OVER {self._name(items[j + 1])}"
            j += 2
        out.append(Atom("operand", sql))
        return j

    def _rule(self, up: str) -> Callable | None:
        if self.dialect == "mysql":
            special = {"CONCAT": fn.FUNCTIONS["concat_strict"], "LENGTH": fn.FUNCTIONS["octet_length"], "DATEDIFF": lambda a, b: f"datediff(cast({a} as date), cast({b} as date))", "LOG": lambda *a: fn.sql("log", *a[::-1]), "TRUNCATE": lambda x, n: f"(case when {x} < 0 then -1 else 1 end * floor(abs({x}) * pow(10, {n})) / pow(10, {n}))"}
            if up in special:
                return special[up]
            own = {"NOW": "current_timestamp()", "CURDATE": "current_date()", "CURTIME": "date_format(current_timestamp(), 'HH:mm:ss')"}
            if up in own:
                return lambda *a: own[up]
            if up in ("DATE_ADD", "ADDDATE"):
                return lambda d, n: f"({fn.datetimes.ts(d)} + {n})" if "make_interval_of" in n else f"date_add(cast({d} as date), {n})"
            if up in ("DATE_SUB", "SUBDATE"):
                return lambda d, n: f"({fn.datetimes.ts(d)} - {n})" if "make_interval_of" in n else f"date_sub(cast({d} as date), {n})"
            if up in ("GREATEST", "LEAST"):
                return fn.FUNCTIONS["scalar_max" if up == "GREATEST" else "scalar_min"]
            if up in ("FROM_UNIXTIME", "LAST_DAY", "DAYOFWEEK", "DAYOFYEAR", "WEEKDAY", "QUARTER", "HOUR", "MINUTE", "SECOND", "INSTR", "FIND_IN_SET"):
                return None
        if self.dialect == "postgres" and up in ("GREATEST", "LEAST"):
            return fn.FUNCTIONS["scalar_max" if up == "GREATEST" else "scalar_min"]
        if self.dialect == "postgres" and up in ("CONCAT", "TO_CHAR", "TO_DATE", "TO_TIMESTAMP", "NOW", "DATE_TRUNC", "ARRAY_AGG", "JSON_AGG"):
            return {"CONCAT": fn.FUNCTIONS["concat"], "NOW": lambda: "current_timestamp()", "DATE_TRUNC": lambda p, x: f"date_trunc({p}, {fn.datetimes.ts(x)})", "ARRAY_AGG": fn.FUNCTIONS["array_agg"], "JSON_AGG": fn.FUNCTIONS["json_agg"]}.get(up)
        if self.dialect == "tsql" and up in ("GREATEST", "LEAST"):
            return fn.FUNCTIONS["scalar_max" if up == "GREATEST" else "scalar_min"]
        if up in _STANDARD:
            return None
        return fn.FUNCTIONS.get(up.lower())

    def _special(self, up: str, g: Group) -> str | None:
        items = g.items
        if up in ("CAST", "TRY_CAST", "TRY_PARSE", "PARSE") and (at := find(items, "AS")) >= 0:
            x, rest = self.expression(items[:at]), items[at + 1 :]
            if (u := find(rest, "USING")) >= 0:
                rest = rest[:u]
            declared = self._type(rest)
            if up == "PARSE":
                return f"cast({x} as {maths.type_name(declared)[1]})"
            return (maths.cast if up == "CAST" else maths.try_cast)(x, declared)
        if up in ("CONVERT", "TRY_CONVERT"):
            if (at := find(items, "USING")) >= 0:
                return self.expression(items[:at])
            parts = split(items, ",")
            if self.dialect == "mysql":
                return maths.cast(self.expression(parts[0]), self._type(parts[1]))
            x = self.expression(parts[1])
            if up == "TRY_CONVERT":
                return maths.try_cast(x, self._type(parts[0]))
            return maths.convert(self._type(parts[0]), x, self.expression(parts[2]) if len(parts) > 2 else None)
        if up in _PART_FUNCTIONS and self.dialect == "tsql":
            parts = split(items, ",")
            return fn.sql(up, f"'{parts[0][0].text}'", *(self.expression(p) for p in parts[1:]))
        if up == "EXTRACT" and (at := find(items, "FROM")) >= 0:
            return f"extract({items[0].text} FROM {fn.datetimes.ts(self.expression(items[at + 1 :]))})"
        if up == "POSITION" and (at := find(items, "IN")) >= 0:
            return f"locate({self.expression(items[:at])}, {self.expression(items[at + 1 :])})"
        if up in ("SUBSTRING", "SUBSTR") and (at := find(items, "FROM")) >= 0:
            end = find(items, "FOR")
            args = [items[:at], items[at + 1 : end if end > 0 else len(items)], *([items[end + 1 :]] if end > 0 else [])]
            return f"substring({', '.join(map(self.expression, args))})"
        if up == "TRIM" and (at := find(items, "FROM")) >= 0:
            return f"trim({self.expression(items[:at])} FROM {self.expression(items[at + 1 :])})" if at else f"trim({self.expression(items[1:])})"
        if up == "GROUP_CONCAT" or (up == "STRING_AGG" and find(items, "ORDER", "BY") >= 0):
            sep, body = "','", items
            if (at := find(body, "SEPARATOR")) >= 0:
                sep, body = self.expression(body[at + 1 :]), body[:at]
            order = ""
            if (at := find(body, "ORDER", "BY")) >= 0:
                order, body = f" WITHIN GROUP ({self.expression(body[at:])})", body[:at]
            distinct = bool(body) and body[0].up == "DISTINCT"
            args = [self.expression(p) for p in split(body[distinct:], ",")]
            if up == "STRING_AGG":
                args, sep = args[:1], args[1]
            value = f"cast({args[0]} as string)" if len(args) == 1 else f"concat({', '.join(f'cast({a} as string)' for a in args)})"
            if distinct and order:
                order = f" WITHIN GROUP (ORDER BY {value}{' DESC' if order.endswith('DESC)') else ''})"
            return f"listagg({'DISTINCT ' if distinct else ''}{value}, {sep}){order}"
        if up == "JSON_OBJECT" and any(x.kind == "op" and x.text == ":" for x in items):
            pairs = [p for part in split(items, ",") for p in split(part, ":")]
            return fn.sql("json_object", *map(self.expression, pairs))
        if up in ("EXISTS", "IN"):
            return f"{up} ({self.query(items)})"
        if up == "COUNT" and items and items[0].kind == "op":
            return "count(*)"
        return None

    def _type(self, items: list) -> str:
        out = ""
        for x in items:
            out += f"({', '.join(y.text for y in x.items if y.text != ',')})" if isinstance(x, Group) else " " + x.text
        return out.strip().strip("[]").lower()

    # ---- table sources

    def _table_function(self, up: str, items: list, i: int) -> tuple[str, int]:
        g, j = items[i + 1], i + 2
        args = self._args(g)
        columns, schema = "value", None
        if up == "GENERATE_SERIES":
            sql = f"explode(sequence({', '.join(args)}))"
        elif up == "STRING_SPLIT":
            sep = f"concat('\\\\Q', {args[1]}, '\\\\E')"
            parts = f"split({args[0]}, {sep}, -1)"
            if len(args) > 2 and args[2] == "1":
                sql, columns = f"inline(transform({parts}, (x, k) -> named_struct('value', x, 'ordinal', k + 1)))", "value, ordinal"
            else:
                sql = f"explode({parts})"
        else:
            source = args[0] if len(args) == 1 else f"get_json_object({args[0]}, {args[1]})"
            if j + 1 < len(items) and items[j].up == "WITH" and isinstance(items[j + 1], Group):
                schema = []
                for part in split(items[j + 1].items, ","):
                    path = next((x.text for x in part[1:] if x.kind == "string"), f"$.{part[0].text}")
                    kind = maths.type_name(self._type([x for x in part[1:] if x.kind != "string" and x.up not in ("AS", "JSON")]))[1]
                    schema.append((self._name(part[0]), kind, path))
                j += 2
                rows = f"(case when trim({source}) like '[%' then from_json({source}, 'array<variant>') else array(try_parse_json({source})) end)"
                fields = ", ".join(f"'{n}', try_variant_get(v, {quote(p)}, '{k}')" for n, k, p in schema)
                sql, columns = f"inline(transform({rows}, v -> named_struct({fields})))", ", ".join(f"`{n}`" for n, _, _ in schema)
            else:
                entries = f"from_json({source}, 'map<string,string>')"
                array = f"from_json({source}, 'array<string>')"
                sql = f"inline(case when trim({source}) like '[%' then transform({array}, (v, k) -> named_struct('key', cast(k as string), 'value', v)) else transform(map_entries({entries}), e -> named_struct('key', e.key, 'value', e.value)) end)"
                columns = "key, value"
        alias = up.lower()
        if j < len(items) and items[j].up == "AS":
            j += 1
        if j < len(items) and items[j].kind in ("word", "ident") and items[j].up not in KEYWORDS:
            alias = self._name(items[j])
            j += 1
            if j < len(items) and isinstance(items[j], Group):
                columns = self.expression(items[j].items)
                j += 1
        return f"{sql} AS `{alias}`({columns})", j

    def _apply(self, items: list, i: int, out: list[Atom]) -> int:
        outer = items[i].up == "OUTER"
        j = i + 2
        join = "LEFT JOIN LATERAL" if outer else "JOIN LATERAL"
        if isinstance(items[j], Group):
            body = f"({self.query(items[j].items, numbered=True)})"
            j += 1
            if j < len(items) and items[j].up == "AS":
                j += 1
            alias = self._name(items[j])
            j += 1
            columns = ""
            if j < len(items) and isinstance(items[j], Group):
                columns = f"({self.expression(items[j].items)})"
                j += 1
            out.append(Atom("word", f"{join} {body} AS `{alias}`{columns} ON TRUE"))
            return j
        sql, j = self._table_function(items[j].text.upper(), items, j)
        later = next((x.up for x in items[j:] if x.up in ("JOIN", "WHERE", "GROUP", "ORDER", "HAVING", "PIVOT", "UNPIVOT") or (isinstance(x, Group) and x.items and x.items[0].up == "SELECT")), "WHERE")
        if later in ("WHERE", "GROUP", "ORDER", "HAVING"):
            # a generator over each row where it stands; a lateral join would shuffle and scan twice
            source, _, alias = sql.rpartition(" AS `")
            name, _, columns = alias.partition("`(")
            out.append(Atom("word", f"LATERAL VIEW {'OUTER ' if outer else ''}{source} `{name}` AS {columns[:-1]}"))
        else:
            out.append(Atom("word", f"{join} {sql} ON TRUE"))
        return j

    def _quantified(self, items: list, i: int, out: list[Atom]) -> int:
        kind, g, op = items[i].up, items[i + 1], out[-1].sql
        query = bool(g.items) and g.items[0].up in ("SELECT", "WITH")
        if op in ("=", "<>", "!="):
            some = kind != "ALL"
            if (op == "=") != some:
                raise DialectError(f"{op} {kind} is not supported")
            out[-1] = Atom("word", "IN" if op == "=" else "NOT IN")
            out.append(Atom("operand", f"({self._inner(g)})"))
            return i + 2
        if not query:
            raise DialectError(f"{op} {kind} needs a query")
        largest = (op[0] == ">") == (kind == "ALL")
        out.append(Atom("operand", f"(SELECT {'max' if largest else 'min'}(v) FROM ({self.query(g.items)}) AS q(v))"))
        return i + 2

    def _match(self, items: list) -> str:
        """Graph pattern a-(e)->b as a join condition."""
        text = ""
        for x in items:
            text += f"({x.items[0].text})" if isinstance(x, Group) else f" {x.text} " if x.up == "AND" else x.text
        conditions = []
        for chain in re.split(r"(?i)\s+and\s+", text):
            nodes = re.findall(r"(\w+)|(<-|-)\((\w+)\)(->|-)", chain)
            names, edges = [n[0] for n in nodes if n[0]], [n[1:] for n in nodes if not n[0]]
            if len(names) != len(edges) + 1:
                raise DialectError("malformed MATCH pattern")
            for (before, edge, _), a, b in zip(edges, names, names[1:], strict=False):
                a, b = (b, a) if before == "<-" else (a, b)
                conditions.append(f"{a}.node_id = {edge}.from_id AND {edge}.to_id = {b}.node_id")
        return f"({' AND '.join(conditions)})"

    def _pivot(self, up: str, items: list) -> str:
        at, to = find(items, "FOR"), find(items, "IN")
        value, column = self.expression(items[:at]), self.expression(items[at + 1 : to])
        names = [self._name(p[0]) for p in split(items[to + 1].items, ",")]
        if up == "UNPIVOT":
            return f"UNPIVOT ({value} FOR {column} IN ({', '.join(f'`{n}`' for n in names)}))"
        return f"PIVOT ({value} FOR {column} IN ({', '.join(f'{quote(n)} AS `{n}`' for n in names)}))"

    # ---- operators

    def _operators(self, atoms: list[Atom]) -> list[Atom]:
        atoms = self._casts(atoms)
        atoms = self._multiplicative(atoms)
        atoms = self._additive(atoms)
        out: list[Atom] = []
        i = 0
        while i < len(atoms):
            a = atoms[i]
            if a.kind == "word" and a.sql in ("LIKE", "ILIKE"):
                out.append(Atom("word", "ILIKE"))
            elif a.kind == "word" and a.sql in ("REGEXP", "RLIKE"):
                out.append(Atom("word", "RLIKE"))
            elif a.kind == "word" and a.sql == "GLOB":
                negated = out[-1].sql == "NOT"
                if negated:
                    out.pop()
                left = out.pop()
                test = fn.sql("glob", left.sql, atoms[i + 1].sql)
                out.append(Atom("operand", f"({test} = {0 if negated else 1})"))
                i += 1
            elif a.kind == "op" and a.sql in ("~", "~*", "!~", "!~*") and self.dialect == "postgres" and out and out[-1].kind == "operand":
                left, pattern = out.pop(), atoms[i + 1].sql
                p = f"concat('(?i)', {pattern})" if a.sql.endswith("*") else pattern
                out.append(Atom("operand", f"({'NOT ' if a.sql[0] == '!' else ''}{left.sql} RLIKE {p})"))
                i += 1
            elif a.kind == "op" and a.sql in ("->", "->>") and out and out[-1].kind == "operand":
                left = out.pop()
                out.append(Atom("operand", fn.sql("json_get", left.sql, atoms[i + 1].sql)))
                i += 1
            elif a.kind == "op" and a.sql == "&&" and self.dialect == "mysql":
                out.append(Atom("word", "AND"))
            elif a.kind == "word" and a.sql == "BINARY" and self.dialect == "mysql":
                pass
            else:
                out.append(a)
            i += 1
        return out

    def _casts(self, atoms: list[Atom]) -> list[Atom]:
        out: list[Atom] = []
        i = 0
        while i < len(atoms):
            if atoms[i].kind == "op" and atoms[i].sql == "::" and out:
                declared = atoms[i + 1].sql.strip("`").lower()
                i += 1
                if declared == "double" and i + 1 < len(atoms) and atoms[i + 1].sql.lower() == "precision":
                    i += 1
                m = re.match(r"\w+", declared)
                x = out.pop()
                out.append(Atom("operand", x.sql if m and m[0] in ("json", "jsonb", "uuid", "regclass", "name") else f"cast({x.sql} as {maths.type_name(re.sub(r'[(].*', '', declared))[1]})"))
            else:
                out.append(atoms[i])
            i += 1
        return out

    def _multiplicative(self, atoms: list[Atom]) -> list[Atom]:
        """Folds runs of * / % DIV MOD from the left where one of them differs from Spark's."""
        out: list[Atom] = []
        i = 0
        while i < len(atoms):
            a = atoms[i]
            symbol = a.sql if a.kind == "op" and a.sql in "*/%" else {"DIV": "div", "MOD": "%"}.get(a.sql) if a.kind == "word" else None
            if symbol and out and out[-1].kind == "operand" and i + 1 < len(atoms) and not out[-1].sql.endswith("."):
                right, width = atoms[i + 1], 2
                if right.kind == "op" and right.sql in "+-" and i + 2 < len(atoms):
                    right, width = Atom("operand", f"({right.sql}{atoms[i + 2].sql})"), 3
                if right.kind == "operand":
                    left = out.pop()
                    sql = {"*": f"{left.sql} * {right.sql}", "/": maths.divide(left.sql, right.sql), "%": maths.modulo(left.sql, right.sql), "div": maths.int_divide(left.sql, right.sql)}[symbol]
                    out.append(Atom("operand", f"({sql})" if symbol == "*" else sql))
                    i += width
                    continue
            out.append(a)
            i += 1
        return out

    def _additive(self, atoms: list[Atom]) -> list[Atom]:
        """A + with a string literal on one side joins texts."""
        if self.dialect != "tsql":
            return atoms
        out: list[Atom] = []
        i = 0
        while i < len(atoms):
            a = atoms[i]
            if a.kind == "op" and a.sql == "+" and out and out[-1].kind == "operand" and i + 1 < len(atoms) and atoms[i + 1].kind == "operand":
                left, right = out[-1], atoms[i + 1]
                numeric = any(re.fullmatch(r"[0-9.]+", x.sql) for x in (left, right))
                later = not numeric and i + 3 < len(atoms) and atoms[i + 2].sql == "+" and atoms[i + 3].literal and atoms[i + 3].kind == "operand"
                left_text, right_text = left.literal or bool(_TEXTUAL.fullmatch(left.sql)), right.literal or bool(_TEXTUAL.fullmatch(right.sql))
                if left_text or right_text or later:
                    while right_text and not left_text and len(out) > 2 and out[-2].kind == "op" and out[-2].sql == "+" and out[-3].kind == "operand":
                        # what is added up on the left comes first
                        out[-3:] = [Atom("operand", f"({out[-3].sql} + {out[-1].sql})")]
                        left = out[-1]
                    out[-1] = Atom("operand", f"concat(cast({left.sql} as string), cast({right.sql} as string))", True)
                    i += 2
                    continue
            out.append(a)
            i += 1
        return out


#: Calls that give texts.
_TEXTUAL = re.compile(r"(?:concat|concat_ws|repeat|lower|upper|replace|l?trim|rtrim|substring|left|right|reverse|date_format|format_string|format_number)\(.*\)|cast\(.* as string\)", re.S)
_HINTS = set("NOLOCK READUNCOMMITTED READCOMMITTED READPAST UPDLOCK ROWLOCK TABLOCK TABLOCKX HOLDLOCK SERIALIZABLE REPEATABLEREAD XLOCK PAGLOCK NOWAIT SNAPSHOT".split())
_TABLE_FUNCTIONS = ("GENERATE_SERIES", "STRING_SPLIT", "OPENJSON", "JSON_EACH")
#: Names that are the same in Spark, or that the rules above must not replace.
_STANDARD = set("COUNT SUM AVG MIN MAX ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE CUME_DIST PERCENT_RANK COALESCE NULLIF LOWER UPPER TRIM LTRIM RTRIM REPLACE PI ABS ROUND MAKE_INTERVAL_OF LISTAGG BIT_AND BIT_OR BIT_XOR".split())


def _intervals(sql: str) -> str:
    return re.sub(r"make_interval_of\((.+?), (\w+)\)", lambda m: f"INTERVAL {m[1]} {m[2]}" if re.fullmatch(r"\d+|'[^']*'", m[1]) else f"make_interval_of({m[1]}, {m[2]})", sql)


def translate(sql: str, dialect: str = "tsql", params: dict[str, str] | None = None) -> str:
    """One query of the dialect as Spark SQL."""
    found = statements(sql, dialect)
    if len(found) != 1:
        raise DialectError("one statement expected")
    return translate_items(found[0], dialect, params)


def translate_items(items: list, dialect: str, params: dict[str, str] | None = None) -> str:
    return _intervals(Translator(dialect, params).query(items))


def select(spark, sql: str, dialect: str = "tsql", params: dict[str, str] | None = None, **ranking):
    """One query of the dialect as a DataFrame; rankings over whole tables or large groups are spread over tasks.

    Spark sorts all rows of a window without PARTITION BY, and of a large group, in one task: ROW_NUMBER, RANK,
    DENSE_RANK and NTILE of a plain SELECT are computed by ``relational.ranked`` on the rows without them.
    """
    found = statements(sql, dialect)
    parts = Translator(dialect, params).rankings(found[0]) if len(found) == 1 else None
    if parts is None:
        return spark.sql(translate(sql, dialect, params))
    inner, columns, rankings = parts
    rows = spark.sql(_intervals(inner))
    helpers = len({c for r in rankings for c in (*r.by, *(k for k, _, _ in r.order))})
    width = len(rows.columns) - helpers
    names, kept = rows.columns, [f"__c{i}" for i in range(width)]
    out = relational.ranked(rows.toDF(*kept, *names[width:]), rankings, **ranking)
    # a star stands for all columns that are not named besides it
    stars = width - sum(c is None for c in columns)
    chosen, at = [], 0
    for c in columns:
        n = 1 + stars if c is STAR else 1
        if c is None or c is STAR:
            chosen += [F.col(f"__c{i}").alias(names[i]) for i in range(at, at + n - (c is STAR))]
            at += n - (c is STAR)
        else:
            chosen.append(F.col(c[0]).alias(c[1]))
    return out.select(*chosen)
