"""The SQL dialect's statements over a store: definitions, writes, bulk loads, copies, views, models and SHOW."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwise.functions import dialect as functions
from setwise.operators import writes
from setwise.plans import dialect
from setwise.plans.dialect import DialectError, _arguments, _close, _skip, tokens
from setwise.sources.files import bulk
from setwise.sources.store import Store, spark_type

_COLUMN = re.compile(r"\s*(?P<name>\w+)\s+(?P<type>\w+)(?:\s*\(\s*(?P<scale>\d+)\s*\))?(?P<rest>.*)", re.S)


def column(text: str) -> dict[str, Any]:
    m = _COLUMN.fullmatch(text.strip())
    if not m:
        raise DialectError(f"{text!r} is no column")
    out: dict[str, Any] = {"name": m["name"], "type": m["type"].lower()}
    spark_type(out["type"])
    if m["scale"]:
        out["scale"] = int(m["scale"])
    rest = m["rest"]
    for option, key, kind in ((r"min\s+(-?\d+)", "min", int), (r"max\s+(-?\d+)", "max", int), (r"timequantum\s+'(\w+)'", "quantum", str), (r"ttl\s+'(\w+)'", "ttl", str), (r"timeunit\s+'(\w+)'", "timeunit", str), (r"cachetype\s+(\w+)", "cachetype", str)):
        if found := re.search(option, rest, re.I):
            out[key] = kind(found[1])
    return out


def _groups(text: str, at: int = 0) -> tuple[list[str], str]:
    """The comma-separated parts of the bracket that text starts with, and what follows it."""
    t = tokens(text)
    i = _skip(t, at)
    end = _close(t, i)
    return ["".join(a).strip() for a in _arguments(t[i + 1 : end])], "".join(t[end + 1 :])


class Session:
    """Runs statements; SELECT sees the store's tables and views by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def run(self, text: str) -> DataFrame | None:
        text = text.strip().rstrip(";").strip()
        for pattern, handler in self._statements().items():
            if m := re.match(pattern, text, re.I | re.S):
                return handler(m, text[m.end() :])
        raise DialectError(f"cannot plan statement {text[:40]!r}")

    def _statements(self) -> dict:
        return {
            r"SELECT\b": lambda m, rest: self.select(m[0] + rest),
            r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(?=\()": self._create,
            r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)": self._drop,
            r"ALTER\s+TABLE\s+(\w+)\s+": self._alter,
            r"(CREATE|ALTER)\s+VIEW\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+": self._view,
            r"DROP\s+VIEW\s+(IF\s+EXISTS\s+)?(\w+)": lambda m, _: self._forget("views", m[2], m[1]),
            r"BULK\s+INSERT\s+INTO\s+(\w+)\s*(?=\()": self._bulk,
            r"(?:INSERT|REPLACE)\s+INTO\s+(\w+)\s*(\([^)]*\))?\s*VALUES\s*": self._insert,
            r"DELETE\s+FROM\s+(\w+)": self._delete,
            r"COPY\s+(\w+)\s+TO\s+(\w+)": self._copy,
            r"CREATE\s+MODEL\s+(\w+)\s+WITH\s*(?=\()": self._model,
            r"PREDICT\s+USING\s+(\w+)\s+": self._predict,
            r"DROP\s+MODEL\s+(IF\s+EXISTS\s+)?(\w+)": lambda m, _: self._forget("models", m[2], m[1]),
            r"CREATE\s+FUNCTION\s+(\w+)\s*": self._function,
            r"SHOW\s+TABLES": lambda m, _: self.spark.createDataFrame([(k, v["comment"]) for k, v in self.store.catalog["tables"].items()], "name string, description string"),
            r"SHOW\s+COLUMNS\s+FROM\s+(\w+)": self._columns,
            r"SHOW\s+CREATE\s+TABLE\s+(\w+)": lambda m, _: self.spark.createDataFrame([(self.ddl(m[1]),)], "ddl string"),
            r"SHOW\s+DATABASES": lambda m, _: self.spark.createDataFrame([(k, v["units"], v["comment"]) for k, v in self.store.catalog["databases"].items()], "name string, units long, description string"),
            r"(CREATE|ALTER|DROP)\s+DATABASE\s+(IF\s+(?:NOT\s+)?EXISTS\s+)?(\w+)": self._database,
        }

    def _views(self, text: str, seen: frozenset[str] = frozenset()) -> None:
        """Make the tables and views that a statement names known to Spark, whatever another store called so."""
        named = {t.strip('`"') for t in tokens(text)}
        for name in named & self.store.catalog["tables"].keys():
            self.store.read(name).createOrReplaceTempView(name)
        for name in (named & self.store.catalog["views"].keys()) - seen:
            body = self.store.catalog["views"][name]
            self._views(body, seen | {name})
            dialect.select(self.spark, body, self._quantums()).createOrReplaceTempView(name)
        if not any(n.startswith("system_") for n in named):
            return
        for name in ("views", "models", "functions"):
            self.spark.createDataFrame([(k, str(v)) for k, v in self.store.catalog[name].items()], "name string, definition string").createOrReplaceTempView(f"system_{name}")
        self.spark.createDataFrame([(k, self.ddl(k)) for k in self.store.catalog["tables"]], "name string, ddl string").createOrReplaceTempView("system_table_ddl")

    def _quantums(self) -> dict[str, str]:
        return {c["name"]: c["quantum"] for t in self.store.catalog["tables"].values() for c in t["columns"] if c.get("quantum")}

    def select(self, text: str) -> DataFrame:
        self._views(text)
        return dialect.select(self.spark, text, self._quantums())

    def ddl(self, name: str) -> str:
        def one(c: dict[str, Any]) -> str:
            kind = f"{c['type']}({c['scale']})" if "scale" in c else c["type"]
            return " ".join([c["name"], kind, *(f"{k} {c[k]}" for k in ("min", "max") if k in c), *([f"timequantum '{c['quantum']}'"] if "quantum" in c else []), *([f"ttl '{c['ttl']}'"] if "ttl" in c else [])])

        return f"create table {name} ({', '.join(map(one, self.store.meta(name)['columns']))})"

    def _create(self, m: re.Match, rest: str) -> None:
        if m[2] in self.store.catalog["tables"]:
            if m[1]:
                return
            raise DialectError(f"table {m[2]!r} already exists")
        columns, rest = _groups(rest)
        comment = re.search(r"comment\s+'([^']*)'", rest, re.I)
        self.store.create(m[2], [column(c) for c in columns], comment[1] if comment else "")

    def _drop(self, m: re.Match, _: str) -> None:
        if m[2] in self.store.catalog["tables"] or not m[1]:
            self.store.drop(m[2])
            self.spark.catalog.dropTempView(m[2])

    def _alter(self, m: re.Match, rest: str) -> None:
        meta, rows = self.store.meta(m[1]), self.store.read(m[1])
        if a := re.match(r"ADD\s+(?:COLUMN\s+)?(.*)", rest, re.I | re.S):
            new = column(a[1])
            if any(c["name"] == new["name"] for c in meta["columns"]):
                raise DialectError(f"column {new['name']!r} is there already")
            meta["columns"].append(new)
            rows = rows.withColumn(new["name"], F.lit(None).cast(spark_type(new["type"], new.get("scale", 0))))
        elif a := re.match(r"DROP\s+(?:COLUMN\s+)?(\w+)", rest, re.I):
            if a[1] == "_id":
                raise DialectError("_id can't be dropped")
            meta["columns"] = [c for c in meta["columns"] if c["name"] != a[1]]
        elif a := re.match(r"RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", rest, re.I):
            names = [c["name"] for c in meta["columns"]]
            if "_id" in (a[1], a[2]) or a[1] not in names or a[2] in names:
                raise DialectError(f"{a[1]!r} can't be renamed to {a[2]!r}")
            rows = rows.withColumnRenamed(a[1], a[2])
            for c in meta["columns"]:
                c["name"] = a[2] if c["name"] == a[1] else c["name"]
        else:
            raise DialectError("ALTER TABLE adds, drops or renames a column")
        self.store.write(m[1], rows)

    def _view(self, m: re.Match, rest: str) -> None:
        known = m[3] in self.store.catalog["views"]
        if m[1].lower() == "create" and known:
            if m[2]:
                return
            raise DialectError(f"view {m[3]!r} already exists")
        if m[1].lower() == "alter" and not known:
            raise DialectError(f"view {m[3]!r} not found")
        self.store.catalog["views"][m[3]] = rest
        self.store.save()

    def _forget(self, kind: str, name: str, lenient: str | None) -> None:
        if self.store.catalog[kind].pop(name, None) is None and not lenient:
            raise DialectError(f"{name!r} not found")
        if kind == "views":
            self.spark.catalog.dropTempView(name)
        self.store.save()

    def _database(self, m: re.Match, rest: str) -> None:
        known, verb, name = self.store.catalog["databases"], m[1].lower(), m[3]
        if (name in known) == (verb == "create"):
            if m[2]:
                return
            raise DialectError(f"database {name!r} {'already exists' if verb == 'create' else 'not found'}")
        if verb == "drop":
            del known[name]
        else:
            units, comment = re.search(r"\bUNITS\s+(\d+)", rest, re.I), re.search(r"\bCOMMENT\s+'([^']*)'", rest, re.I)
            old = known.get(name, {"units": 0, "comment": ""})
            known[name] = {"units": int(units[1]) if units else old["units"], "comment": comment[1] if comment else old["comment"]}
        self.store.save()

    def expire(self, now: str) -> None:
        """Drop the members of time-bucketed sets that are older than their column's ttl."""
        for name, meta in self.store.catalog["tables"].items():
            for c in meta["columns"]:
                if c.get("ttl") and c.get("quantum"):
                    amount, unit = re.fullmatch(r"(\d+)\s*([a-z]+)", c["ttl"].lower()).groups()
                    long = {"d": "day", "h": "hour", "m": "minute", "s": "second"}.get(unit, unit)
                    self.store.write(name, writes.expire(self.store.table(name), c["name"], f"{amount} {long}", now))

    def _upsert(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        if len(rows.columns) < 2 + (writes.ORDER in rows.columns) or "_id" not in rows.columns:
            raise DialectError("an insert needs _id and another column")
        self.store.write(name, writes.upsert(self.store.table(name), writes.check_rows(rows, self.store.limits(name))), batch)

    def _typed(self, text: str, kind: T.DataType) -> str:
        """A literal as SQL of a type; a tuple {ts, set} makes timed members, a set alone untimed ones."""
        r = dialect._Rewriter({})
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and text.lower() != "null":
            ts, members = _arguments(tokens(text[1:-1])) if text.startswith("{") else (["null"], tokens(text))
            stamp = "".join(ts).strip()
            stamp = f"timestamp_seconds({stamp})" if re.fullmatch(r"\d+", stamp) else stamp
            made = f"transform({r.text(members)}, x -> named_struct('value', x, 'ts', cast(cast({stamp} AS timestamp) AS timestamp_ntz)))"
        else:
            made = r.text(tokens(text))
            if isinstance(kind, T.TimestampType) and re.fullmatch(r"\d+", text):
                made = f"timestamp_seconds({text})"
        return f"cast({made} AS {kind.simpleString()})"

    def _insert(self, m: re.Match, rest: str) -> None:
        schema = self.store.schema(m[1])
        names = [x.strip() for x in m[2].strip("()").split(",")] if m[2] else schema.names
        rows, selects = rest, []
        while rows.strip():
            values, rows = _groups(rows)
            rows = rows.strip().removeprefix(",")
            if len(values) != len(names):
                raise DialectError("mismatch in the count of expressions and target columns")
            selects.append("(" + ", ".join(self._typed(v, schema[n].dataType) for v, n in zip(values, names, strict=True)) + f", {len(selects)})")
        text = f"SELECT * FROM VALUES {', '.join(selects)} AS v({', '.join(names)}, {writes.ORDER})"
        functions.register(self.spark, text)
        try:
            rows = self.spark.sql(text)
        except AnalysisException:  # an expression that is no constant
            rows = self.spark.sql(" UNION ALL ".join(f"SELECT stack(1, {x[1:-1]}) AS ({', '.join(names)}, {writes.ORDER})" for x in selects))
        self._upsert(m[1], rows)

    def _bulk(self, m: re.Match, rest: str) -> None:
        schema = self.store.schema(m[1])
        names, rest = _groups(rest)
        maps_text, rest = _groups(re.sub(r"^\s*MAP\s*", "", rest, flags=re.I))
        transforms = None
        if t := re.match(r"\s*TRANSFORM\s*(?=\()", rest, re.I):
            transforms, rest = _groups(rest[t.end() :])
        source = re.match(r"\s*FROM\s+'((?:[^']|'')*)'|\s*FROM\s+x'((?:[^']|'')*)'", rest, re.I)
        if not source:
            raise DialectError("BULK INSERT needs FROM '...'")
        option = lambda k: (x := re.search(rf"\b{k}\s+'(\w+)'", rest[source.end() :], re.I)) and x[1].upper()
        maps = []
        for x in maps_text:
            p = re.fullmatch(r"(?:'([^']*)'|(\d+))\s+(\w+)(?:\s*\((\d+)\))?", x.strip()) or re.fullmatch(r"()(\d+)?\s*(\w+)(?:\s*\((\d+)\))?", x.strip())
            maps.append((p[1] or p[2] or str(len(maps)), spark_type(p[3], int(p[4] or 0))))
        rows = bulk(self.spark, option("FORMAT") or "CSV", source[1].replace("''", "'"), maps, option("INPUT") == "STREAM", bool(re.search(r"\bHEADER_ROW\b", rest, re.I)), bool(re.search(r"\bALLOW_MISSING_VALUES\b", rest, re.I)))
        if limit := re.search(r"\bROWSLIMIT\s+(\d+)", rest, re.I):
            rows = rows.limit(int(limit[1]))
        exprs = [re.sub(r"@(\d+)", r"_\1", t) for t in transforms] if transforms else [f"_{k}" for k in range(len(names))]
        texts = [dialect._Rewriter({}).text(tokens(e)) for e in exprs]
        functions.register(self.spark, " ".join(texts))
        self._upsert(m[1], rows.select(*(F.expr(e).cast(schema[n].dataType).alias(n) for e, n in zip(texts, names, strict=True))))

    def _delete(self, m: re.Match, rest: str) -> None:
        rows = self.store.read(m[1])
        if not rest.strip():
            return self.store.write(m[1], rows.limit(0))
        gone = self.select(f"SELECT DISTINCT {m[1]}._id FROM {m[1]}{rest}")
        return self.store.write(m[1], rows.join(gone, "_id", "left_anti"))

    def _copy(self, m: re.Match, rest: str) -> None:
        if m[2] in self.store.catalog["tables"]:
            raise DialectError(f"table {m[2]!r} already exists")
        rows = self.select(f"SELECT * FROM {m[1]}{rest}")
        self.store.create(m[2], [dict(c) for c in self.store.meta(m[1])["columns"]])
        self.store.write(m[2], rows)

    def _model(self, m: re.Match, rest: str) -> None:
        options, query = _groups(rest)
        labels = re.search(r"labels\s*\[\s*'(\w+)'", " ".join(options), re.I)
        query = re.sub(r"^\s*AS\s+", "", query, flags=re.I)
        rows = self.select(query)
        if not labels or labels[1] not in rows.columns:
            raise DialectError("a model needs a label that its query has")
        y = labels[1]
        xs = [c for c in rows.columns if c not in ("_id", y)]
        # normal equations: one pass, whatever the number of rows
        terms = [F.lit(1.0), *(F.col(c).cast("double") for c in xs), F.col(y).cast("double")]
        n = len(terms)
        got = rows.dropna(subset=[*xs, y]).agg(*(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n))).first()
        import numpy as np

        s = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        weights = np.linalg.lstsq(s[: n - 1, : n - 1], s[: n - 1, n - 1], rcond=None)[0]
        self.store.catalog["models"][m[1]] = {"columns": xs, "weights": weights.tolist()}
        self.store.save()

    def _predict(self, m: re.Match, rest: str) -> DataFrame:
        if m[1] not in self.store.catalog["models"]:
            raise DialectError(f"model {m[1]!r} not found")
        model = self.store.catalog["models"][m[1]]
        rows = self.select(rest)
        value = sum((F.col(c).cast("double") * w for c, w in zip(model["columns"], model["weights"][1:], strict=True)), F.lit(model["weights"][0]))
        truncated = F.when(value < 0, F.ceil(value * 10000)).otherwise(F.floor(value * 10000))
        return rows.select((truncated.cast("decimal(30,0)") / F.expr("10000BD")).cast("decimal(38,4)").alias("prediction"), *rows.columns)

    def _function(self, m: re.Match, rest: str) -> None:
        self.store.catalog["functions"][m[1]] = rest  # kept, never run
        self.store.save()

    def _columns(self, m: re.Match, _: str) -> DataFrame:
        rows = [(c["name"], c["type"], c.get("scale"), c.get("min"), c.get("max"), c.get("quantum"), c.get("ttl")) for c in self.store.meta(m[1])["columns"]]
        return self.spark.createDataFrame(rows, "name string, type string, scale int, min long, max long, timequantum string, ttl string")
