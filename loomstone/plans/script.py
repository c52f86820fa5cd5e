"""Scripts: variables, control flow and statements that change tables.

A statement ends at a semicolon; before a word that can only begin a statement it may be left out.
"""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions.strings import quote
from ..operators import mutations
from .dialect import KEYWORDS, Translator, _intervals
from .lexer import DialectError, Group, Tok, find, split, statements

END_OF_STATEMENT = Tok("op", ";")
_STARTS = set("DECLARE PRINT IF WHILE BEGIN BREAK CONTINUE THROW RAISERROR TRUNCATE DROP CREATE EXEC EXECUTE RETURN".split())
_SOFT_STARTS = set("SELECT SET INSERT UPDATE DELETE WITH".split())


def literal(v) -> str:
    """A Python value as Spark SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, decimal.Decimal)):
        return str(v)
    if isinstance(v, float):
        return f"double({quote(repr(v))})"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    if isinstance(v, dt.datetime):
        return f"timestamp {quote(v.isoformat(' '))}"
    if isinstance(v, dt.date):
        return f"date {quote(v.isoformat())}"
    return quote(str(v))


@dataclass
class Outcome:
    """Results of the queries, printed lines and the variables at the end."""

    results: list[DataFrame] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    variables: dict = field(default_factory=dict)


@dataclass
class Constraints:
    """What CREATE TABLE declares about a table's rows."""

    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)

    def require(self, name: str, df: DataFrame) -> None:
        """Raise if rows break a rule."""
        keys = [*([self.primary] if self.primary else []), *self.unique]
        not_null = list(dict.fromkeys([*self.primary, *self.not_null]))
        if keys or not_null or self.checks:
            broken = mutations.violations(df, keys, not_null, self.checks).first()
            if broken:
                raise ScriptError(f"{name}: {broken.n} violations of {broken.rule}")


class ScriptError(DialectError):
    """Raised by THROW and RAISERROR."""


def _flat(items: list):
    """All tokens, those of groups too."""
    for x in items:
        yield x
        if isinstance(x, Group):
            yield from _flat(x.items)


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    pass


class Runner:
    """Walks a script's items and runs them in an engine."""

    MAX_STEPS = 100_000

    def __init__(self, engine, dialect: str):
        self.engine, self.dialect = engine, dialect
        self.values: dict[str, object] = {}
        self.types: dict[str, str] = {}
        self.sequences: dict[str, tuple[int, int]] = {}
        self.out, self.steps = Outcome(variables=self.values), 0
        self.counting = False

    def run(self, items: list) -> Outcome:
        # rows are counted only where the script asks for them, as that takes a job
        self.counting = any(x.kind == "param" and x.text.upper() == "@@ROWCOUNT" for x in _flat(items))
        try:
            self.block(items, 0, len(items))
        except _Return:
            pass
        return self.out

    # ---- structure

    def block(self, items: list, i: int, end: int) -> None:
        while i < end:
            i = self.statement(items, i, end, True)

    def statement(self, items: list, i: int, end: int, run: bool) -> int:
        """Runs (or steps over) the statement at i; returns what follows it."""
        self.steps += 1
        if self.steps > self.MAX_STEPS:
            raise DialectError("the script takes too many steps")
        x = items[i]
        if x.kind == "op" and x.text == ";":
            return i + 1
        if x.up == "BEGIN":
            word = items[i + 1].up if i + 1 < end else ""
            if word in ("TRAN", "TRANSACTION"):
                return self._skip_words(items, i, end)
            if word == "TRY":
                return self._try(items, i, end, run)
            close = self._close(items, i, end)
            if run:
                self.block(items, i + 1, close)
            return close + 1
        if x.up == "IF":
            if items[i + 1].up in ("EXISTS",) and items[i - 1].up in ("TABLE", "VIEW"):
                raise DialectError("unexpected IF EXISTS")
            body = self._condition_end(items, i + 1, end)
            hit = run and self._truth(items[i + 1 : body])
            after = self.statement(items, body, end, hit)
            while after < end and items[after].kind == "op" and items[after].text == ";":
                after += 1
            if after < end and items[after].up == "ELSE":
                after = self.statement(items, after + 1, end, run and not hit)
            return after
        if x.up == "WHILE":
            body = self._condition_end(items, i + 1, end)
            after = self.statement(items, body, end, False)
            while run and self._truth(items[i + 1 : body]):
                try:
                    self.statement(items, body, end, True)
                except _Break:
                    break
                except _Continue:
                    continue
            return after
        stop = self._simple_end(items, i, end)
        if run:
            self._simple(items[i:stop])
        return stop + 1 if stop < end and items[stop].kind == "op" and items[stop].text == ";" else stop

    def _skip_words(self, items, i, end):
        while i < end and not (items[i].kind == "op" and items[i].text == ";"):
            i += 1
        return i + 1

    def _close(self, items: list, i: int, end: int) -> int:
        depth, cases = 0, 0
        for k in range(i, end):
            up = items[k].up
            if up == "CASE":
                cases += 1
            elif up == "BEGIN" and not (k + 1 < end and items[k + 1].up in ("TRAN", "TRANSACTION")):
                depth += 1
            elif up == "END":
                if cases:
                    cases -= 1
                else:
                    depth -= 1
                    if not depth:
                        return k
        raise DialectError("BEGIN without END")

    def _try(self, items, i, end, run):
        close = self._close(items, i, end)
        k = close + 2
        while items[k].kind == "op":
            k += 1
        if items[k].up != "BEGIN" or items[k + 1].up != "CATCH":
            raise DialectError("BEGIN CATCH expected")
        caught = self._close(items, k, end)
        if run:
            before = {n: self.engine.frame(n) for n in self.engine.names()}
            try:
                self.block(items, i + 2, close)
            except (_Break, _Continue, _Return):
                raise
            except Exception as e:
                self.values["@@error_message"] = str(e).split("\n")[0]
                del before
                self.block(items, k + 2, caught)
        return caught + 2

    def _condition_end(self, items, i, end):
        """A condition ends where a statement begins."""
        k = i
        while k < end and not (items[k].up in _STARTS - {"IF"} | {"SET", "SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH"} and k > i or items[k].up == "BEGIN"):
            k += 1
        return k

    def _simple_end(self, items, i, end):
        first, k, cases = items[i].up, i + 1, 0
        seen_set = False
        while k < end:
            x, before = items[k], items[k - 1].up
            if x.kind == "op" and x.text == ";":
                break
            cases += x.up == "CASE"
            if x.up == "END":
                if not cases:
                    break
                cases -= 1
            if x.up == "ELSE" and not cases:
                break
            if first not in ("MERGE", "CREATE", "DROP") and x.up in _STARTS and not cases and not (x.up == "EXECUTE"):
                break
            if first in ("DECLARE", "SET", "PRINT") and x.up in _SOFT_STARTS and not (first == "SET" and k == i + 1):
                break
            if first == "UPDATE" and x.up == "SET":
                if seen_set:
                    break
                seen_set = True
            elif first in ("INSERT", "UPDATE", "DELETE", "SELECT") and x.up in ("INSERT", "UPDATE", "DELETE", "MERGE", "SET") and before not in ("FOR", "DO", "KEY") and not (first != "UPDATE" and x.up == "SET" and before == "UPDATE"):
                break
            k += 1
        return k

    # ---- values

    def translator(self) -> Translator:
        return Translator(self.dialect, {k: literal(v) for k, v in self.values.items()})

    def _counted(self, n) -> None:
        if self.counting:
            self.values["@@rowcount"] = n()

    def _text(self, items) -> str:
        return _intervals(self.translator().expression(self._sequenced(items)))

    def _sequenced(self, items):
        """ERROR_MESSAGE() and NEXT VALUE FOR as values."""
        if (at := next((k for k, x in enumerate(items[:-1]) if x.up == "ERROR_MESSAGE" and isinstance(items[k + 1], Group)), -1)) >= 0:
            return self._sequenced([*items[:at], Tok("param", "@@error_message"), *items[at + 2 :]])
        at = find(items, "NEXT", "VALUE", "FOR")
        if at < 0:
            return [Group(self._sequenced(x.items)) if isinstance(x, Group) and any(y.up in ("NEXT", "ERROR_MESSAGE") for y in _flat(x.items)) else x for x in items]
        name = items[at + 3].text.lower()
        now, step = self.sequences[name]
        self.sequences[name] = (now + step, step)
        return self._sequenced([*items[:at], Tok("number", str(now)), *items[at + 4 :]])

    def value(self, items):
        return self.engine.spark.sql(f"SELECT {self._text(items)} AS v").first()[0]

    def _truth(self, items) -> bool:
        return bool(self.engine.spark.sql(f"SELECT coalesce({self._text(items)}, FALSE) AS v").first()[0])

    # ---- statements

    def _simple(self, s: list) -> None:
        run = getattr(self, "_do_" + s[0].up.lower(), None)
        if run is None:
            raise DialectError(f"unsupported statement {s[0].text if hasattr(s[0], 'text') else '('}")
        run(s)

    def _do_declare(self, s):
        for part in split(s[1:], ","):
            name, at = part[0].text.lower(), next((k for k, x in enumerate(part) if x.kind == "op" and x.text == "="), len(part))
            rest = [x for x in part[1:at] if x.up != "AS"]
            if rest and rest[0].up == "TABLE":
                self._create("temp_" + name.lstrip("@"), rest[1].items)
                continue
            self.types[name] = self.translator()._type(rest)
            value = self.value(part[at + 1 :]) if at < len(part) else None
            self.values[name] = self._typed(name, value)

    def _typed(self, name, value):
        if value is None or name not in self.types:
            return value
        return self.engine.spark.sql(f"SELECT {maths.cast(literal(value), self.types[name])} AS v").first()[0]

    def _do_set(self, s):
        if s[1].kind != "param":
            return  # session options
        self.values[s[1].text.lower()] = self._typed(s[1].text.lower(), self.value(s[3:]))

    def _do_print(self, s):
        v = self.value(s[1:])
        self.out.messages.append("" if v is None else str(v))

    def _do_throw(self, s):
        if len(s) == 1:
            raise ScriptError(self.values.get("@@error_message", "THROW"))
        raise ScriptError(str(self.value(split(s[1:], ",")[1])))

    def _do_raiserror(self, s):
        raise ScriptError(str(self.value(split(s[1].items, ",")[0])))

    def _do_break(self, s):
        raise _Break

    def _do_continue(self, s):
        raise _Continue

    def _do_return(self, s):
        raise _Return

    def _do_commit(self, s):
        pass

    _do_use = _do_commit

    def _do_exec(self, s):
        """EXEC('text') and EXEC sp_executesql N'text'; procedures are refused."""
        named = len(s) > 1 and s[1].up == "SP_EXECUTESQL"
        if not named and not (len(s) == 2 and isinstance(s[1], Group)):
            raise DialectError("EXEC runs texts only; there are no stored procedures")
        parts = split(s[2:], ",") if named else [s[1].items]
        if len(parts) > 1:
            raise DialectError("parameters of sp_executesql are not supported")
        items = []
        for statement in statements(str(self.value(parts[0])), self.dialect):
            items += [*statement, END_OF_STATEMENT]
        self.block(items, 0, len(items))

    _do_execute = _do_exec

    def _do_rollback(self, s):
        raise ScriptError("ROLLBACK: the script's changes are undone")

    def _query(self, s) -> DataFrame:
        return self.engine.spark.sql(_intervals(self.translator().query(self._sequenced(s))))

    def _do_select(self, s):
        if len(s) > 2 and s[1].kind == "param" and s[2].kind == "op" and s[2].text == "=":
            end = find(s, "FROM")
            parts = split(s[1 : end if end > 0 else len(s)], ",")
            columns = ", ".join(f"{self._text(p[2:])} AS v{k}" for k, p in enumerate(parts))
            rest = f" {self._text(s[end:])}" if end > 0 else ""
            row = self.engine.spark.sql(f"SELECT {columns}{rest}").first()
            for p, v in zip(parts, row or [], strict=False):
                self.values[p[0].text.lower()] = self._typed(p[0].text.lower(), v)
            return
        if (at := find(s, "INTO")) > 0:
            name = self.translator()._name(s[at + 1])
            self.engine.replace(name, self._query([*s[:at], *s[at + 2 :]]))
            return
        self.out.results.append(self._query(s))
        self._counted(lambda: self.out.results[-1].count())

    def _do_with(self, s):
        verb = next((k for k, x in enumerate(s) if x.up in ("UPDATE", "DELETE", "SELECT", "INSERT", "MERGE")), 0)
        if s[verb].up in ("UPDATE", "DELETE"):
            self._through_cte(s[:verb], s[verb:])
        else:
            self.out.results.append(self._query(s))

    def _through_cte(self, ctes: list, s: list) -> None:
        """UPDATE or DELETE of the rows of a table that a CTE over it shows."""
        name_at = 1 + (s[0].up == "DELETE" and s[1].up == "FROM")
        body = next((x.items for k, x in enumerate(ctes) if isinstance(x, Group) and ctes[k - 1].up == "AS" and ctes[k - 2].text.lower() == s[name_at].text.lower()), None)
        if body is None or body[0].up != "SELECT" or body[1].up in ("DISTINCT", "TOP") or find(body, "GROUP", "BY") > 0:
            raise DialectError("changes through a CTE need a plain SELECT from one table")
        frm = find(body, "FROM")
        name = self._target(body[frm + 1])
        df, view = self._numbered(name)
        shown = [Tok("word", "__row"), Tok("op", ","), *body[1:frm]]
        if body[1].kind == "op" and body[1].text == "*":
            shown = body[1:frm]  # the number is among all columns
        inner = [body[0], *shown, body[frm], Tok("ident", view), Tok("word", "AS"), Tok("ident", name), *body[frm + 2 :]]
        alias, where = s[name_at].text, find(s, "WHERE")
        condition = f" WHERE {self._text(s[where + 1 :])}" if where > 0 else ""
        cte = f"WITH `{alias}` AS ({_intervals(self.translator().query(inner))})"
        columns = self.engine.frame(name).columns
        if s[0].up == "DELETE":
            gone = self.engine.checkpointed(self.engine.spark.sql(f"{cte} SELECT __row FROM `{alias}`{condition}"))
            self._counted(gone.count)
            self.engine.replace(name, df.join(gone, "__row", "left_anti").select(*columns))
            return
        parts = split(s[find(s, "SET") + 1 : where if where > 0 else len(s)], ",")
        equals = [next(k for k, x in enumerate(p) if x.kind == "op" and x.text == "=") for p in parts]
        values = ", ".join(f"{self._text(p[k + 1 :])} AS `__new_{p[k - 1].text.lower()}`" for p, k in zip(parts, equals, strict=True))
        new = self.engine.spark.sql(f"{cte} SELECT __row, TRUE AS __hit, {values} FROM `{alias}`{condition}")
        both = df.join(new, "__row", "left")
        out = [F.when(F.col("__hit"), F.col(f"`__new_{f.name.lower()}`").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f"__new_{f.name.lower()}" in new.columns else F.col(f"`{f.name}`") for f in self.engine.frame(name).schema]
        self._counted(new.count)
        self._put(name, both.select(*out))

    _do_values = lambda self, s: self.out.results.append(self._query(s))

    def _target(self, x) -> str:
        return "temp_" + x.text.lstrip("@") if x.kind == "param" else self.translator()._name(x)

    def _names(self, group) -> list[str]:
        return [self.translator()._name(p[0]) for p in split(group.items, ",")]

    def _create(self, name: str, items: list) -> None:
        fields, rules = [], Constraints()
        for part in split(items, ","):
            head = part[2:] if part[0].up == "CONSTRAINT" else part
            if head[0].up in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "KEY", "INDEX"):
                group = next((x for x in head if isinstance(x, Group)), None)
                if head[0].up == "PRIMARY":
                    rules.primary = self._names(group)
                elif head[0].up == "UNIQUE":
                    rules.unique.append(self._names(group))
                elif head[0].up == "CHECK":
                    rules.checks[f"check_{len(rules.checks) + 1}"] = self._text(group.items)
                continue
            column = self.translator()._name(part[0])
            declared = [part[1], *([part[2]] if len(part) > 2 and isinstance(part[2], Group) else [])]
            fields.append(f"`{column}` {maths.type_name(self.translator()._type(declared))[1]}")
            k = 1 + len(declared)
            while k < len(part):
                up, after = part[k].up, part[k + 1].up if k + 1 < len(part) else ""
                if up == "PRIMARY":
                    rules.primary = [column]
                elif up == "UNIQUE":
                    rules.unique.append([column])
                elif up == "NOT" and after == "NULL":
                    rules.not_null.append(column)
                elif up == "CHECK":
                    rules.checks[f"check_{len(rules.checks) + 1}"] = self._text(part[k + 1].items)
                elif up == "DEFAULT":
                    end = next((m for m in range(k + 2, len(part)) if part[m].up in ("PRIMARY", "UNIQUE", "NOT", "CHECK", "CONSTRAINT", "REFERENCES", "NULL")), len(part))
                    rules.defaults[column] = self._text(part[k + 1 : end])
                    k = end - 1
                k += 1
        self.engine.replace(name, self.engine.spark.createDataFrame([], ", ".join(fields)))
        self.engine.constraints[name.lower()] = rules

    def _rules(self, name: str) -> Constraints:
        return self.engine.constraints.get(name.lower()) or Constraints()

    def _put(self, name: str, df: DataFrame) -> None:
        """The table's new rows, if they break no declared rule."""
        self._rules(name).require(name, df)
        self.engine.replace(name, df)

    def _shown(self, s: list) -> tuple[list, list]:
        """The statement without its OUTPUT or RETURNING clause, and the clause's list."""
        if (at := find(s, "RETURNING")) > 0:
            return s[:at], s[at + 1 :]
        if (at := find(s, "OUTPUT")) > 0:
            end = next((k for k in range(at + 1, len(s)) if s[k].up in ("VALUES", "SELECT", "FROM", "WHERE", "DEFAULT", "INTO")), len(s))
            if end < len(s) and s[end].up == "INTO":
                raise DialectError("OUTPUT INTO is not supported")
            return [*s[:at], *s[end:]], s[at + 1 : end]
        return s, []

    def _show(self, shown: list, new: DataFrame | None, old: DataFrame | None) -> None:
        """Adds the rows that an OUTPUT or RETURNING clause asks for; both sides carry ``__row`` where both are given."""
        if not shown:
            return
        parts = []
        for side, df in (("inserted", new), ("deleted", old)):
            if df is not None:
                df.createOrReplaceTempView(f"{side}_rows")
                parts.append(f"{side}_rows AS {side}")
        qualified = any(x.up in ("INSERTED", "DELETED") for x in _flat(shown))
        source = " JOIN ".join(parts) + " ON inserted.__row = deleted.__row" if qualified and len(parts) == 2 else parts[0]
        out = self.engine.spark.sql(f"SELECT {self.translator().expression(shown) if len(split(shown, ',')) == 1 else ', '.join(self._text(p) for p in split(shown, ','))} FROM {source}")
        self.out.results.append(self.engine.checkpointed(out.select(*(F.col(f"`{c}`") for c in dict.fromkeys(out.columns) if c != "__row"))))

    def _do_create(self, s):
        words = [x.up for x in s[:6]]
        if "TABLE" in words:
            at = words.index("TABLE") + 1
            at += 3 if s[at].up == "IF" else 0
            name = self._target(s[at])
            if s[at + 1].up == "AS":
                self.engine.replace(name, self._query(s[at + 2 :]))
            else:
                self._create(name, s[at + 1].items)
        elif "VIEW" in words:
            at = words.index("VIEW") + 1
            body = find(s, "AS")
            self.engine.replace(self._target(s[at]), self._query(s[body + 1 :]))
        elif "SEQUENCE" in words:
            at = words.index("SEQUENCE") + 1
            start, step = find(s, "START", "WITH"), find(s, "INCREMENT", "BY")
            self.sequences[s[at].text.lower()] = (int(s[start + 2].text) if start > 0 else 1, int(s[step + 2].text) if step > 0 else 1)
        elif {"INDEX", "PROCEDURE", "FUNCTION", "TRIGGER"} & set(words):
            raise DialectError(f"CREATE {next(w for w in words[1:] if w)} is not supported")
        else:
            raise DialectError("unsupported CREATE")

    def _do_drop(self, s):
        at = 2
        exists = s[at].up == "IF"
        at += 2 if exists else 0
        if s[1].up in ("TABLE", "VIEW"):
            for part in split(s[at:], ","):
                self.engine.drop(self._target(part[-1]), exists)

    def _do_truncate(self, s):
        name = self._target(s[-1])
        self.engine.replace(name, mutations.delete(self.engine.frame(name)))

    def _do_insert(self, s):
        s, shown = self._shown(s)
        i = 1
        mode = "insert"
        if s[i].up == "OR":
            mode, i = s[i + 1].up.lower(), i + 2
        elif s[i].up == "IGNORE":
            mode, i = "ignore", i + 1
        i += s[i].up == "INTO"
        name = self._target(s[i])
        i += 1
        target = self.engine.frame(name)
        columns = target.columns
        if isinstance(s[i], Group) and (i + 1 < len(s)) and s[i + 1].up in ("VALUES", "SELECT", "WITH", "OUTPUT", "DEFAULT"):
            columns = [self.translator()._name(p[0]) for p in split(s[i].items, ",")]
            i += 1
        if s[i].up == "DEFAULT":
            row = self.engine.spark.sql("SELECT " + ", ".join(f"cast({self._rules(name).defaults.get(f.name, 'null')} as {f.dataType.simpleString()}) AS `{f.name}`" for f in target.schema))
            self._put(name, target.unionByName(row))
            self._counted(lambda: 1)
            self._show(shown, row, None)
            return
        conflict = find(s, "ON", "CONFLICT", start=i)
        duplicate = find(s, "ON", "DUPLICATE", "KEY", "UPDATE", start=i)
        end = min([x for x in (conflict, duplicate) if x > 0], default=len(s))
        rows = self._query(s[i:end]).toDF(*columns)
        keys = self._rules(name).primary or next(iter(self._rules(name).unique), []) or columns[:1]
        plain = conflict < 0 and duplicate < 0 and mode == "insert"
        if shown:
            if not plain:
                raise DialectError("OUTPUT and RETURNING need a plain INSERT")
            rows = self.engine.checkpointed(rows)
        if conflict > 0:
            keys = [p[0].text for p in split(s[conflict + 2].items, ",")]
            if s[conflict + 4].up == "NOTHING":
                out = mutations.upsert(target, rows, keys, nothing=True)
            else:
                out = mutations.upsert(target, rows, keys, self._assignments(s[find(s, "SET", start=conflict) + 1 :], target.columns))
        elif duplicate > 0:
            out = mutations.upsert(target, rows, keys, self._assignments(s[duplicate + 4 :], target.columns, mysql=True))
        elif mode in ("replace", "ignore"):
            out = mutations.upsert(target, rows, keys, nothing=mode == "ignore")
        else:
            out = mutations.insert(target, rows, self._rules(name).defaults)
        self._put(name, out)
        self._counted(rows.count)
        if shown:
            self._show(shown, mutations.insert(target.limit(0), rows, self._rules(name).defaults), None)

    def _assignments(self, items, columns, mysql=False) -> dict[str, str]:
        out = {}
        for part in split(items, ","):
            body = []
            k = 2
            while k < len(part):
                x = part[k]
                if x.up == "EXCLUDED" and k + 2 < len(part):
                    body += [Tok("word", "new"), part[k + 1], part[k + 2]]
                    k += 3
                elif mysql and x.up == "VALUES" and isinstance(part[k + 1], Group):
                    body += [Tok("word", "new"), Tok("op", "."), part[k + 1].items[0]]
                    k += 2
                else:
                    plain = x.kind in ("word", "ident") and x.text in columns and not (k and part[k - 1].kind == "op" and part[k - 1].text == ".")
                    body += [Tok("word", "old"), Tok("op", "."), x] if plain else [x]
                    k += 1
            out[part[0].text] = self._text(body)
        return out

    def _numbered(self, name: str) -> tuple[DataFrame, str]:
        """The table with a row number that stays the same, and the view of it."""
        df = self.engine.checkpointed(self.engine.frame(name).withColumn("__row", F.monotonically_increasing_id()))
        df.createOrReplaceTempView(f"rows_of_{name}")
        return df, f"rows_of_{name}"

    def _joined(self, alias: str, source: list) -> tuple[str, DataFrame, list]:
        """The table behind an alias of a FROM list, numbered, and the list over its view."""
        at = next((k for k, x in enumerate(source) if x.kind in ("word", "ident") and x.up not in KEYWORDS and k + 1 < len(source) and source[k + 1 + (source[k + 1].up == "AS" and k + 2 < len(source))].text.lower() == alias.lower() if not isinstance(source[k + 1], Group)), None)
        if at is None:
            at = next(k for k, x in enumerate(source) if x.kind in ("word", "ident") and self._target(x).lower() == self._target(Tok("word", alias)).lower())
        name = self._target(source[at])
        df, view = self._numbered(name)
        named = at + 1 < len(source) and (source[at + 1].up == "AS" or source[at + 1].text.lower() == alias.lower())
        return name, df, [*source[:at], Tok("ident", view), *([] if named else [Tok("word", "AS"), Tok("word", alias)]), *source[at + 1 :]]

    def _do_update(self, s):
        s, shown = self._shown(s)
        at, frm, where = find(s, "SET"), find(s, "FROM"), find(s, "WHERE")
        end = where if where > 0 else len(s)
        parts = split(s[at + 1 : frm if frm > 0 else end], ",")
        equals = [next(k for k, x in enumerate(p) if x.kind == "op" and x.text == "=") for p in parts]
        columns = [p[k - 1].text for p, k in zip(parts, equals, strict=True)]
        if frm < 0:
            name = self._target(s[1])
            values = {c: self._text(p[k + 1 :]) for c, p, k in zip(columns, parts, equals, strict=True)}
            cond = self._text(s[where + 1 :]) if where > 0 else None
            before = self._numbered(name)[0] if shown else self.engine.frame(name)
            hits = before.filter(cond) if cond else before
            if shown:
                self._show(shown, mutations.update(hits, values), hits)
            self._counted(hits.count)
            self._put(name, mutations.update(self.engine.frame(name), values, cond))
            return
        if shown:
            raise DialectError("OUTPUT and RETURNING need an UPDATE of one table")
        alias = s[1].text
        name, df, source = self._joined(alias, s[frm + 1 : end])
        values = ", ".join(f"{self._text(p[k + 1 :])} AS v{n}" for n, (p, k) in enumerate(zip(parts, equals, strict=True)))
        new = self.engine.spark.sql(f"SELECT {alias}.__row, {values} FROM {self._text([Tok('word', 'FROM'), *source])[5:]}{f' WHERE {self._text(s[where + 1 :])}' if where > 0 else ''}")
        new = new.groupBy("__row").agg(F.lit(True).alias("hit"), *(F.first(f"v{n}").alias(f"v{n}") for n in range(len(columns))))
        both = df.join(new, "__row", "left")
        place = {c.lower(): n for n, c in enumerate(columns)}
        out = [F.when(F.col("hit"), F.col(f"v{place[f.name.lower()]}").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in place else F.col(f"`{f.name}`") for f in self.engine.frame(name).schema]
        self._counted(new.count)
        self._put(name, both.select(*out))

    def _do_delete(self, s):
        s, shown = self._shown(s)
        i, top = 1, None
        if s[i].up == "TOP":
            top, i = self._text(s[i + 1].items if isinstance(s[i + 1], Group) else [s[i + 1]]), i + 2
        joined = find(s, "JOIN") > 0 or (s[i].up != "FROM" and find(s, "FROM") > 0)
        where = find(s, "WHERE")
        condition = f" WHERE {self._text(s[where + 1 :])}" if where > 0 else ""
        if joined:
            frm = find(s, "FROM", start=i + 1)
            alias = s[i + (s[i].up == "FROM")].text
            name, df, source = self._joined(alias, s[frm + 1 : where if where > 0 else len(s)])
            gone = self.engine.spark.sql(f"SELECT DISTINCT {alias}.__row FROM {self._text([Tok('word', 'FROM'), *source])[5:]}{condition}")
        else:
            name = self._target(s[i + (s[i].up == "FROM")])
            if not condition and top is None and not shown and not self.counting:
                self.engine.replace(name, mutations.delete(self.engine.frame(name)))
                return
            df, view = self._numbered(name)
            gone = self.engine.spark.sql(f"SELECT __row FROM {view} AS `{name}`{condition}{f' LIMIT {top}' if top else ''}")
        if shown or self.counting:
            gone = self.engine.checkpointed(gone)
            self._counted(gone.count)
            self._show(shown, None, df.join(gone, "__row", "left_semi"))
        self.engine.replace(name, df.join(gone, "__row", "left_anti").select(*self.engine.frame(name).columns))

    def _do_merge(self, s):
        if find(s, "OUTPUT") > 0:
            raise DialectError("OUTPUT of MERGE is available on DataFrames only")
        i = 1 + (s[1].up == "INTO")
        name = self._target(s[i])
        using, on = find(s, "USING"), find(s, "ON")
        t = s[i + 1 + (s[i + 1].up == "AS")].text if using > i + 1 else name
        source = s[using + 1]
        alias_at = using + 2 + (s[using + 2].up == "AS")
        a = s[alias_at].text if alias_at < on else source.text
        rows = self._query(source.items) if isinstance(source, Group) else self.engine.frame(self._target(source))
        rename = {t.lower(): "t", a.lower(): "s"}

        def text(items):
            out = []
            for k, x in enumerate(items):
                dotted = k + 1 < len(items) and items[k + 1].kind == "op" and items[k + 1].text == "."
                out.append(Tok("word", rename[x.text.lower()]) if dotted and x.kind in ("word", "ident") and x.text.lower() in rename else Group(rewritten(x.items)) if isinstance(x, Group) else x)
            return self._text(out)

        def rewritten(items):
            return [Tok("word", rename[x.text.lower()]) if x.kind in ("word", "ident") and x.text.lower() in rename and k + 1 < len(items) and items[k + 1].kind == "op" and items[k + 1].text == "." else Group(rewritten(x.items)) if isinstance(x, Group) else x for k, x in enumerate(items)]

        marks = [k for k in range(on, len(s)) if s[k].up == "WHEN"] + [len(s)]
        clauses = []
        for b, e in zip(marks, marks[1:], strict=False):
            then = find(s, "THEN", start=b)
            head = [x.up for x in s[b:then]]
            kind = "matched" if head[1] == "MATCHED" else "not_matched_by_source" if "SOURCE" in head else "not_matched"
            cond = next((k for k in range(b, then) if s[k].up == "AND"), None)
            condition = text(s[cond + 1 : then]) if cond else None
            verb, body = s[then + 1].up, s[then + 2 : e]
            if verb == "UPDATE":
                values = {p[-1].text if False else [x for x in p[: next(k for k, x in enumerate(p) if x.kind == "op" and x.text == "=")] if x.kind != "op"][-1].text: text(p[next(k for k, x in enumerate(p) if x.kind == "op" and x.text == "=") + 1 :]) for p in split(body[1:], ",")}
            elif verb == "INSERT":
                names = [p[0].text for p in split(body[0].items, ",")]
                values = dict(zip(names, (text(p) for p in split(body[2].items, ",")), strict=True))
            else:
                values = {}
            clauses.append(mutations.When(kind, verb.lower(), values, condition))
        self._put(name, mutations.merge(self.engine.frame(name), rows, text(s[on + 1 : marks[0]]), clauses))
