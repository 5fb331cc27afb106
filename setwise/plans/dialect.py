"""The SQL dialect's SELECT as Spark SQL: functions, set literals, TOP, flatten hints, RANGEQ, truncating aggregates.

Each SELECT is a scope of its own, whose clauses and tables are parsed; expressions within are rewritten token by token,
and Spark tells the types of operands where their meaning depends on them: / of whole numbers and decimals truncates,
and a set equals another if it holds all of its members, whatever the order.

What the dialect has no meaning for (RIGHT and FULL joins, USING, window functions, FILTER, EXISTS, unions, common table
expressions, OFFSET, GROUP BY of expressions) raises an error. Nulls in AND, OR and IN follow Spark's rules.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwise.functions import dialect as functions
from setwise.functions.percentile import percentile
from setwise.plans import range_join

_TOKEN = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_@][A-Za-z0-9_]*|\d+(?:\.\d+)?|\|\||<>|!=|<=|>=|<<|>>|.", re.S)
_UNIT = {"Y": "YEAR", "M": "MONTH", "D": "DAY", "H": "HOUR"}


class DialectError(ValueError):
    """A statement that the dialect doesn't have."""


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _skip(t: list[str], i: int) -> int:
    while i < len(t) and t[i].isspace():
        i += 1
    return i


def _close(t: list[str], i: int) -> int:
    """Index of the bracket that closes the one at i."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for k in range(i, len(t)):
        depth += (t[k] in pairs) - (t[k] in pairs.values())
        if not depth:
            return k
    raise DialectError("a bracket isn't closed")


def _arguments(t: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for x in t:
        depth += (x in "([{") - (x in ")]}")
        if x == "," and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return out


def _pattern(literal: str) -> str:
    """The dialect's LIKE: any case, _ for one or more characters, everything else as in a regular expression."""
    body = literal[1:-1].replace("%", ".*").replace("_", ".+").replace("\\", "\\\\")
    return f"'(?i)^{body}$'"


_CLAUSES = ("from", "where", "group", "having", "order", "limit")
_FOREIGN = ("union", "intersect", "except", "minus", "offset", "window", "qualify", "lateral", "tablesample", "cluster", "distribute", "sort", "pivot", "unpivot", "fetch")
_AFTER_TABLE = ("on", "join", "inner", "left", "right", "full", "cross", "outer", "natural", "semi", "anti", "with", "using", "where", *_FOREIGN)
_CALLS = {*functions.SETS, *functions.FUNCTIONS, "avg", "var", "corr", "format"}
_CAST = {"int": "bigint", "id": "bigint", "bool": "boolean", "string": "string", "timestamp": "timestamp"}


def _word(x: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"", x))


def _text(t: list[str]) -> str:
    return "".join(t).strip()


class _Table:
    """A table of a FROM clause: its source, its name in the query, and what narrows its columns."""

    def __init__(self, source: str, name: str):
        self.source, self.name, self.flatten, self.ranges = source, name, "", []

    def sql(self) -> str:
        source = self.source
        for column, test in self.ranges:
            source = f"(SELECT * EXCEPT ({column}), filter({column}, _x -> {test}) AS {column} FROM {source})"
        if self.flatten:
            source = f"(SELECT * EXCEPT ({self.flatten}), array(_m) AS {self.flatten} FROM {source} LATERAL VIEW explode({self.flatten}) _e AS _m)"
        return source if source == self.name else f"{source} AS {self.name}" if self.name else source


class _Scope:
    """One SELECT: its clauses, the tables of its FROM, and the types of its expressions, which Spark tells."""

    def __init__(self, r: _Rewriter, t: list[str]):
        self.r, self.parts, self.items = r, {"select": []}, []
        low = [x.lower() for x in t]
        clause, depth = "select", 0
        for k, x in enumerate(low):
            if k == 0:
                continue
            depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
            if not depth and x in _FOREIGN and t[_skip(t, k + 1) : k + 3] != ["("]:
                raise DialectError(f"{x} isn't supported")
            if not depth and x in _CLAUSES and clause != x and (x != "group" or low[_skip(t, k + 1)] == "by"):
                clause = x
                self.parts[clause] = []
            else:
                self.parts[clause].append(t[k])

    def range_join(self) -> tuple[str, str] | None:
        """FROM and a test for WHERE of an inner join of two tables on equal columns and one inequality; None for others."""
        items = [x for x in self.items if isinstance(x, _Table) or x.strip()]
        if self.r.spark is None or len(self.r.scopes) > 1 or len(items) != 4 or not all(isinstance(x, _Table) for x in items[::2]) or isinstance(items[3], _Table):
            return None
        tables = items[::2]
        if any(x.flatten or x.ranges or not re.fullmatch(r"[\w.]+", x.source) or not re.fullmatch(r"[A-Za-z]\w*", x.name) for x in tables):
            return None
        owners = [x.name.lower() for x in tables]
        on = re.fullmatch(r"\s*on\s+(.*?)\s*", items[3], re.I | re.S)
        if not on or not re.fullmatch(r"\s*(inner\s+)?join\s*", items[1], re.I) or owners[0] == owners[1]:
            return None
        known = [{c.lower(): c for c in self.r.spark.sql(f"SELECT * FROM {x.sql()}").columns} for x in tables]
        terms = []
        for term in re.split(r"\s+and\s+", on[1], flags=re.I):
            m = re.fullmatch(r"(\w+)\.(\w+)\s*(=|<=|>=|<|>)\s*(\w+)\.(\w+)", term)
            if not m:
                return None
            a, x, op, b, y = m[1].lower(), m[2].lower(), m[3], m[4].lower(), m[5].lower()
            if [b, a] == owners:
                a, x, op, b, y = b, y, op.translate(str.maketrans("<>", "><")), a, x
            if [a, b] != owners or x not in known[0] or y not in known[1]:
                return None
            terms.append((op, known[0][x], known[1][y]))
        tests = [x for x in terms if x[0] != "="]
        if len(tests) != 1 or len(terms) < 2 or any(re.search(r"(^|[\s.])\*$", _text(x)) for x in _arguments(self.parts["select"])):
            return None
        read: list[dict[str, None]] = [{}, {}]  # columns by table, in order
        t = [x.strip('`"').lower() for name, clause in self.parts.items() if name != "from" for x in [" ", *clause]]
        for k, x in enumerate(t):
            if x == "select":
                return None
            if t[k - 1] == "." and t[k - 2] in owners:
                side = owners.index(t[k - 2])
                if x not in known[side]:
                    return None
                read[side][known[side][x]] = None
            elif x in known[0] or x in known[1] or (x in owners and t[k + 1 : k + 2] != ["."]):  # whose it is, isn't said
                return None
        op = tests[0][0]
        sides = [(x.source, x.name, [z[k + 1] for z in terms if z[0] == "="], tests[0][k + 1], list(read[k] | ({tests[0][k + 1]: None} if k or not read[k] else {}))) for k, x in enumerate(tables)]
        return range_join.sql(self.r.spark, sides[0], op, sides[1])

    def from_sql(self) -> str:
        return "FROM " + "".join(x if isinstance(x, str) else x.sql() for x in self.items) if self.items else ""

    def tables(self) -> list[_Table]:
        return [x for x in self.items if isinstance(x, _Table)]

    def type_of(self, expression: str) -> T.DataType | None:
        """The type of an expression in this scope or those around it; None if Spark can't tell."""
        if self.r.spark is None:
            return None
        tables = [x.sql() for s in reversed(self.r.scopes) for x in s.tables()]
        try:
            functions.register(self.r.spark, expression)
            return self.r.spark.sql(f"SELECT {expression} AS x" + (f" FROM {', '.join(tables)}" if tables else "")).schema["x"].dataType
        except (AnalysisException, ParseException):
            return None

    def read_from(self, t: list[str]) -> None:
        i, expect, held = 0, True, []

        def flush() -> None:
            if held:
                self.items.append(self.r.text(held))
                held.clear()

        while i < len(t):
            x, low = t[i], t[i].lower()
            if x.isspace() or x.startswith("--"):
                held.append(" ")
                i += 1
            elif expect and (x == "(" or _word(x)):
                flush()
                expect = False
                if x == "(":
                    end = _close(t, i)
                    source, name, i = f"({self.r.query(t[i + 1 : end])})", "", end + 1
                else:
                    end = i + 1
                    while t[end : end + 1] == ["."]:
                        end += 2
                    source, name, i = _text(t[i:end]), t[end - 1], end
                table = _Table(source, name)
                i = self._after_table(t, i, table)
                self.items.append(table)
            else:
                if low == "join" or x == ",":
                    expect = True
                follows = t[_skip(t, i + 1)].lower() if _skip(t, i + 1) < len(t) else ""
                if low in ("right", "full") and follows in ("join", "outer"):
                    raise DialectError(f"{x} joins aren't supported")
                end = _close(t, i) + 1 if x in "([{" else i + 1
                held.extend(t[i:end])
                i = end
        flush()

    def _after_table(self, t: list[str], i: int, table: _Table) -> int:
        """An alias and a hint, in either order."""
        named = False
        while (k := _skip(t, i)) < len(t):
            low = t[k].lower()
            if low == "with" and t[_skip(t, k + 1)] == "(":
                at = _skip(t, k + 1)
                end = _close(t, at)
                hint = re.fullmatch(r"\(\s*flatten\s*\(\s*(\w+)\s*\)\s*\)", "".join(t[at : end + 1]), re.I)
                if not hint:
                    raise DialectError("the only hint is flatten(column)")
                table.flatten, i = hint[1], end + 1
            elif not named and (low == "as" or (_word(t[k]) and low not in _AFTER_TABLE)):
                k = _skip(t, k + 1) if low == "as" else k
                table.name, named, i = t[k], True, k + 1
            else:
                break
        return i

    def sql(self) -> str:
        if "from" in self.parts:
            self.read_from(self.parts["from"])
        body = self.parts["select"]
        i = _skip(body, 0)
        distinct = i < len(body) and body[i].lower() == "distinct"
        if distinct:
            i = _skip(body, i + 1)
        limit = ""
        if i < len(body) and body[i].lower() == "top":
            at = _skip(body, i + 1)
            end = _close(body, at) if body[at] == "(" else at
            limit = _text(body[at : end + 1]).strip("() ")
            body = body[end + 1 :]
        else:
            body = body[i:]
        if "limit" in self.parts:
            if limit:
                raise DialectError("TOP and LIMIT exclude each other")
            limit = _text(self.parts["limit"])
        if limit and not limit.isdigit():
            raise DialectError("TOP and LIMIT take a whole number")
        where = self.r.text(self.parts["where"]) if "where" in self.parts else None
        out = "SELECT " + ("DISTINCT " if distinct else "") + self.r.text(body).strip()
        if made := self.range_join():
            out += f" FROM {made[0]}"
            where = made[1] + (f" AND ({where.strip()})" if where is not None else "")
        elif self.items:
            out += " " + self.from_sql()
        if where is not None:
            out += " WHERE " + where.strip()
        for clause in ("group", "having", "order"):
            if clause in self.parts:
                text = self.parts[clause]
                if clause == "group":
                    columns = _arguments(text[_skip(text, 0) + 1 :])
                    if not all(re.fullmatch(r"\w+(\.\w+)*", _text(c)) and not _text(c)[0].isdigit() for c in columns):
                        raise DialectError("GROUP BY takes columns only")
                out += f" {clause.upper()} " + self.r.text(text).strip()
        return out + (f" LIMIT {limit}" if limit else "")


class _Rewriter:
    def __init__(self, quantums: dict[str, str], spark: SparkSession | None = None):
        self.quantums, self.spark, self.scopes = quantums, spark, []

    def query(self, t: list[str]) -> str:
        """A SELECT, in a scope of its own."""
        k = _skip(t, 0)
        if k == len(t) or t[k].lower() != "select":
            raise DialectError("a SELECT is needed here")
        self.scopes.append(_Scope(self, t[k:]))
        try:
            return self.scopes[-1].sql()
        finally:
            self.scopes.pop()

    def type_of(self, expression: str) -> T.DataType | None:
        return self.scopes[-1].type_of(expression) if self.scopes else _Scope(self, ["select"]).type_of(expression)

    def operand(self, t: list[str], i: int) -> int:
        """Past the operand that starts at i: a sign, a literal, a name, a call or a bracket."""
        i = _skip(t, i)
        while i < len(t) and t[i] in "+-~":
            i = _skip(t, i + 1)
        if i < len(t) and t[i] in "([{":
            return _close(t, i) + 1
        if i < len(t) and t[i].lower() == "case":
            depth = 0
            for k in range(i, len(t)):
                depth += (t[k].lower() == "case") - (t[k].lower() == "end")
                if not depth:
                    return k + 1
        i += 1
        while t[i : i + 1] == ["."]:
            i += 2
        k = _skip(t, i)
        return _close(t, k) + 1 if t[k : k + 1] == ["("] and _word(t[k - 1] if k == i else t[i - 1]) else i

    def _left(self, out: list[str], chain: bool) -> str:
        """Takes the last operand off what was written; with `chain`, all that binds as * does."""
        taken: list[str] = []

        def spaces() -> None:
            while out and out[-1].isspace():
                taken.insert(0, out.pop())

        while True:
            spaces()
            if not out:
                break
            taken.insert(0, out.pop())
            while out and out[-1] == ".":
                taken.insert(0, out.pop())
                taken.insert(0, out.pop())
            if taken[0].startswith("(") and out and _word(out[-1]) and out[-1].lower() not in ("and", "or", "not", "when", "then", "else", "in", "select", "by", "distinct"):
                taken.insert(0, out.pop())
            spaces()
            if not (chain and out and out[-1] in ("*", "%")):
                break
            taken.insert(0, out.pop())
        return "".join(taken).strip()

    def divided(self, left: str, right: str) -> str:
        a, b = self.type_of(left), self.type_of(right)
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a, whole) and isinstance(b, whole):
            return f"({left} div {right})"
        if all(isinstance(x, (*whole, T.DecimalType)) for x in (a, b)):  # truncated to the larger scale
            scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b))
            return f"cast(cast(({left}) * {10**scale}BD div ({right}) AS decimal(38,0)) / {10**scale}BD AS decimal(38,{scale}))"
        return f"({left} / {right})"

    def compared(self, left: str, word: str, right: str) -> str:
        """A set equals what it holds all of."""
        test = f"(size(array_except({right}, {left})) = 0)"
        return test if word == "=" else f"(NOT {test})"

    def text(self, t: list[str]) -> str:
        out: list[str] = []
        i = 0
        while i < len(t):
            word, low = t[i], t[i].lower()
            nxt = _skip(t, i + 1)
            follows = t[nxt] if nxt < len(t) else ""
            if low == "using" or (low in ("over", "filter") and follows == "("):
                raise DialectError(f"{word} isn't supported")
            if low == "exists" and follows == "(":
                raise DialectError("exists expressions aren't supported")
            if word == "[":
                end = _close(t, i)
                out.append(f"array({self.text(t[i + 1 : end])})")
                i = end
            elif word == "{":
                end = _close(t, i)
                out.append(f"struct({self.text(t[i + 1 : end])})")
                i = end
            elif word == "(":
                end = _close(t, i)
                inner = t[i + 1 : end]
                k = _skip(inner, 0)
                out.append(f"({self.query(inner) if k < len(inner) and inner[k].lower() == 'select' else self.text(inner)})")
                i = end
            elif word == "/":
                end = self.operand(t, i + 1)
                left = self._left(out, True)
                out.append(self.divided(left, self.text(t[i + 1 : end]).strip()))
                i = end - 1
            elif word in ("=", "!=", "<>") and (follows == "[" or _word(follows)) and out:
                end = self.operand(t, nxt)
                sign = t[_skip(t, end) : _skip(t, end) + 1]
                kept = list(out)
                left = self._left(out, False)
                right = self.text(t[nxt:end]).strip()
                if sign not in (["+"], ["-"], ["*"], ["/"], ["||"], ["%"]) and (follows == "[" or (re.fullmatch(r"[\w.`]+", left) and re.fullmatch(r"[\w.`]+", right) and isinstance(self.type_of(left), T.ArrayType) and isinstance(self.type_of(right), T.ArrayType))):
                    out.append(self.compared(left, word, right))
                    i = end - 1
                else:
                    out = [*kept, word]
            elif low == "like" and follows.startswith("'"):
                out.append(f"RLIKE {_pattern(follows)}")
                i = nxt
            elif follows == "(" and (made := self._call(low, nxt, t)):
                text, i = made
                out.append(text)
            else:
                out.append(word)
            i += 1
        return "".join(out)

    def _range(self, args: list[str]) -> None:
        """RANGEQ narrows the members of a column of the table that has it, in its own SELECT."""
        column, start, stop = args
        owner, _, column = column.rpartition(".")
        tables = [x for x in self.scopes[-1].tables() if not owner or x.name == owner] if self.scopes else []
        if not owner and len(tables) > 1:
            having = [x for x in tables if self.spark is not None and column in self.spark.sql(f"SELECT * FROM {x.sql()}").columns]
            tables = having or tables
        if not tables:
            raise DialectError(f"RANGEQ: no table has {args[0]}")
        unit = _UNIT[self.quantums.get(column, "YMDH")[-1]]
        tests = ["_x.ts IS NOT NULL"] + [f"date_trunc('{unit}', _x.ts) {op} {f'date_trunc({chr(39)}{unit}{chr(39)}, timestamp {v})' if op == '>=' else f'timestamp {v}'}" for op, v in ((">=", start), ("<", stop)) if v.lower() != "null"]
        tables[0].ranges.append((column, " AND ".join(tests)))

    def _call(self, name: str, at: int, t: list[str]) -> tuple[str, int] | None:
        end = _close(t, at)
        inner = t[at + 1 : end]
        if name == "rangeq":
            self._range([_text(a) for a in _arguments(inner)])
            return "TRUE", end
        if name == "cast":
            split = max(k for k, x in enumerate(inner) if x.lower() == "as")
            kind = _text(inner[split + 1 :]).lower()
            if kind.rstrip("q") in ("idset", "stringset"):
                raise DialectError(f"nothing is cast to {kind}")
            if scale := re.fullmatch(r"decimal\s*\(\s*(\d+)\s*\)", kind):
                kind = f"decimal(38,{scale[1]})"
            return f"cast({self.text(inner[:split]).strip()} AS {_CAST.get(kind, kind)})", end
        if name == "percentile":
            raise DialectError("percentile can't be pushed down here")
        if name == "current_timestamp" or name not in _CALLS:
            return None
        args = [self.text(a).strip() for a in _arguments(inner)] if _text(inner) else []
        if name in functions.SETS:
            return functions.SETS[name].format(*args), end
        if name == "avg":
            return f"{functions.PREFIX}trunc4(cast(sum({args[0]}) AS decimal(38,8)), count({args[0]}))", end
        if name == "var":
            return f"{functions.PREFIX}trunc6(var_pop({args[0]}))", end
        if name == "corr":
            return f"{functions.PREFIX}trunc6(corr({', '.join(args)}))", end
        if name == "format":
            verbs = re.sub(r"%[vt]", "%s", args[0]).replace("%q", '"%s"')
            return f"format_string({', '.join([verbs, *args[1:]])})", end
        args = [f"'{a}'" if k == 0 and re.fullmatch(r"[A-Za-z]{1,2}", a) and name.startswith("date") else a for k, a in enumerate(args)]
        kinds = [x.split()[1] for x in functions.FUNCTIONS[name][0].split(", ")]
        args = [f"cast({a} AS int)" if kind == "INT" and not re.fullmatch(r"-?\d{1,9}", a) else a for a, kind in zip(args, kinds, strict=False)] + args[len(kinds) :]
        return f"{functions.PREFIX}{name}({', '.join(args)})", end


def to_spark(sql: str, quantums: dict[str, str] | None = None, spark: SparkSession | None = None) -> str:
    """Spark SQL for a SELECT of the dialect; quantums has the finest unit of time-bucketed columns, by name.

    With a session, Spark tells the types that decide what / and = mean; without one both stay as they are.
    """
    return _Rewriter(quantums or {}, spark).query(tokens(sql.strip().rstrip(";")))


def _percentiles(spark: SparkSession, t: list[str], quantums: dict[str, str]) -> DataFrame | None:
    """One row for a SELECT of percentiles and other aggregates without GROUP BY; None if it has no percentile."""
    scope = _Scope(_Rewriter(quantums, spark), t)
    rest, found = [], []
    for k, item in enumerate(_arguments(scope.parts["select"])):
        m = re.fullmatch(r"percentile\s*\(\s*([\w.]+)\s*,\s*(\d+(?:\.\d+)?)\s*\)(?:\s+(?:as\s+)?(\w+))?", _text(item), re.I)
        if m:
            found.append((k, m[1], Decimal(m[2]), m[3] or f"percentile({m[1]}, {m[2]})"))
        else:
            rest.append((k, _text(item)))
    if not found:
        return None
    if set(scope.parts) - {"select", "from", "where"}:
        raise DialectError("percentile can't be pushed down here")
    tail = "".join(f" {c.upper()}{''.join(scope.parts[c])}" for c in ("from", "where") if c in scope.parts)
    out, names = None, {}
    if rest:
        out = select(spark, "SELECT " + ", ".join(x for _, x in rest) + tail, quantums)
        names = {k: c for (k, _), c in zip(rest, out.columns, strict=True)}
    for k, column, nth, name in found:
        one = percentile(select(spark, f"SELECT {column} AS value{tail}", quantums), "value", nth).select(F.col("value").alias(name))
        out = one if out is None else out.withColumn(name, F.lit(one.first()[0]).cast(one.schema[name].dataType))
        names[k] = name
    return out.select(*(F.col(f"`{names[k]}`") for k in sorted(names)))


def select(spark: SparkSession, sql: str, quantums: dict[str, str] | None = None) -> DataFrame:
    """Run a SELECT of the dialect over the session's tables and views."""
    t = tokens(sql.strip().rstrip(";"))
    if "percentile" in (x.lower() for x in t) and (rows := _percentiles(spark, t, quantums or {})) is not None:
        return rows
    text = to_spark(sql, quantums, spark)
    functions.register(spark, text)
    return spark.sql(text)
