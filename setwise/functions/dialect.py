"""The dialect's scalar functions as SQL functions: Catalyst inlines them, so they stay in generated code.

Indices are 0-based; what is out of range raises an error. Nulls in give null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "sw_"
_FAIL = "raise_error('{0}: argument out of range')"


def _intervals(cases: dict[str, str], name: str) -> str:
    return "CASE upper(i) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE raise_error('{name}: unknown interval') END"


_SUB = {"MS": "cast(extract(MICROSECOND FROM ts) AS bigint) div 1000", "US": "cast(extract(MICROSECOND FROM ts) AS bigint)", "NS": "cast(extract(MICROSECOND FROM ts) AS bigint) * 1000"}
_MICROS = "cast(unix_micros(cast(b AS timestamp)) - unix_micros(cast(a AS timestamp)) AS bigint)"
_SUBSECOND = "cast(date_format(ts, 'SSSSSS') AS bigint)"

#: name: (parameters, type, body)
FUNCTIONS = {
    "char": ("n INT", "STRING", f"CASE WHEN n BETWEEN 0 AND 255 THEN char(n) WHEN n IS NOT NULL THEN {_FAIL.format('CHAR')} END"),
    "ascii": ("s STRING", "INT", f"CASE WHEN char_length(s) = 1 THEN ascii(s) WHEN s <> '' THEN {_FAIL.format('ASCII')} END"),
    "substring": ("s STRING, a INT, n INT DEFAULT -1", "STRING", f"CASE WHEN s IS NULL OR a IS NULL OR n IS NULL THEN NULL WHEN a < 0 OR a >= char_length(s) OR (n <> -1 AND (n < 0 OR a + n > char_length(s))) THEN {_FAIL.format('SUBSTRING')} WHEN n = -1 THEN substr(s, a + 1) ELSE substr(s, a + 1, n) END"),
    "replaceall": ("s STRING, f STRING, r STRING", "STRING", "replace(s, f, r)"),
    "stringsplit": ("s STRING, sep STRING, pos INT DEFAULT 0", "STRING", r"CASE WHEN s IS NOT NULL AND sep IS NOT NULL AND pos IS NOT NULL THEN coalesce(try_element_at(split(s, concat('\\Q', sep, '\\E')), greatest(pos, 0) + 1), '') END"),
    "trim": ("s STRING", "STRING", r"regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '')"),
    "prefix": ("s STRING, n INT", "STRING", f"CASE WHEN n BETWEEN 0 AND char_length(s) THEN left(s, n) WHEN s IS NOT NULL AND n IS NOT NULL THEN {_FAIL.format('PREFIX')} END"),
    "suffix": ("s STRING, n INT", "STRING", f"CASE WHEN n BETWEEN 0 AND char_length(s) THEN right(s, n) WHEN s IS NOT NULL AND n IS NOT NULL THEN {_FAIL.format('SUFFIX')} END"),
    "space": ("n INT", "STRING", "space(greatest(n, 0))"),
    "len": ("s STRING", "INT", "char_length(s)"),
    "replicate": ("s STRING, n INT", "STRING", f"CASE WHEN n >= 0 THEN repeat(s, n) WHEN n IS NOT NULL THEN {_FAIL.format('REPLICATE')} END"),
    "charindex": ("sub STRING, s STRING, pos INT DEFAULT 0", "INT", f"CASE WHEN pos < 0 OR pos > char_length(s) THEN {_FAIL.format('CHARINDEX')} ELSE locate(sub, s, pos + 1) - 1 END"),
    "str": ("x DOUBLE, n INT DEFAULT 10, d INT DEFAULT 0", "STRING", "CASE WHEN char_length(format_string(concat('%.', d, 'f'), bround(x * power(10, d)) / power(10, d))) > n THEN repeat('*', n) ELSE lpad(format_string(concat('%.', d, 'f'), bround(x * power(10, d)) / power(10, d)), n, ' ') END"),
    "datetimepart": ("i STRING, ts TIMESTAMP", "BIGINT", _intervals({"YY": "year(ts)", "YD": "dayofyear(ts)", "M": "month(ts)", "D": "day(ts)", "W": "dayofweek(ts) - 1", "WK": "weekofyear(ts)", "HH": "hour(ts)", "MI": "minute(ts)", "S": "second(ts)", "MS": f"{_SUBSECOND} div 1000", "US": _SUBSECOND, "NS": f"{_SUBSECOND} * 1000"}, "DATETIMEPART")),
    "datetimename": ("i STRING, ts TIMESTAMP", "STRING", _intervals({"YY": "cast(year(ts) AS string)", "YD": "cast(dayofyear(ts) AS string)", "M": "date_format(ts, 'MMMM')", "D": "cast(day(ts) AS string)", "W": "date_format(ts, 'EEEE')", "WK": "cast(weekofyear(ts) AS string)", "HH": "cast(hour(ts) AS string)", "MI": "cast(minute(ts) AS string)", "S": "cast(second(ts) AS string)", "MS": f"cast({_SUBSECOND} div 1000 AS string)", "US": f"cast({_SUBSECOND} AS string)", "NS": f"cast({_SUBSECOND} * 1000 AS string)"}, "DATETIMENAME")),
    "date_trunc": ("i STRING, ts TIMESTAMP", "STRING", _intervals({"YY": "date_format(ts, 'yyyy')", "M": "date_format(ts, 'yyyy-MM')", "D": "date_format(ts, 'yyyy-MM-dd')", "HH": r"date_format(ts, 'yyyy-MM-dd\'T\'HH')", "MI": r"date_format(ts, 'yyyy-MM-dd\'T\'HH:mm')", "S": r"date_format(ts, 'yyyy-MM-dd\'T\'HH:mm:ss')", "MS": r"date_format(ts, 'yyyy-MM-dd\'T\'HH:mm:ss.SSS')", "US": r"date_format(ts, 'yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS')", "NS": r"concat(date_format(ts, 'yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS'), '000')"}, "DATE_TRUNC")),
    # months and years add with overflow: January 31 and a month is March 3
    "datetimeadd": ("i STRING, n INT, ts TIMESTAMP", "TIMESTAMP", _intervals({"YY": "add_months(date_trunc('month', ts), 12 * n) + make_dt_interval(day(ts) - 1) + (ts - date_trunc('day', ts))", "M": "add_months(date_trunc('month', ts), n) + make_dt_interval(day(ts) - 1) + (ts - date_trunc('day', ts))", "D": "ts + make_dt_interval(n)", "HH": "ts + make_dt_interval(0, n)", "MI": "ts + make_dt_interval(0, 0, n)", "S": "ts + make_dt_interval(0, 0, 0, n)", "MS": "timestamp_micros(unix_micros(ts) + 1000L * n)", "US": "timestamp_micros(unix_micros(ts) + n)", "NS": "timestamp_micros(unix_micros(ts) + n div 1000)"}, "DATETIMEADD")),
    "datetimediff": ("i STRING, a TIMESTAMP, b TIMESTAMP", "BIGINT", _intervals({"YY": "year(b) - year(a)", "M": "12 * (year(b) - year(a)) + month(b) - month(a)", "D": f"{_MICROS} div 86400000000", "HH": f"{_MICROS} div 3600000000", "MI": f"{_MICROS} div 60000000", "S": f"{_MICROS} div 1000000", "MS": f"{_MICROS} div 1000", "US": _MICROS, "NS": f"{_MICROS} * 1000"}, "DATETIMEDIFF")),
    "datetimefromparts": ("y INT, m INT, d INT, h INT, mi INT, s INT, ms INT", "TIMESTAMP", "make_timestamp(y, m, d, h, mi, s + ms / 1000BD)"),
    "totimestamp": ("n BIGINT, u STRING DEFAULT 's'", "TIMESTAMP", "CASE u WHEN 's' THEN timestamp_seconds(n) WHEN 'ms' THEN timestamp_millis(n) WHEN 'us' THEN timestamp_micros(n) WHEN 'ns' THEN timestamp_micros(n div 1000) ELSE raise_error('TOTIMESTAMP: unknown unit') END"),
    # truncating averages and moments
    "trunc4": ("s DECIMAL(38,8), n BIGINT", "DECIMAL(38,4)", "cast(cast(s * 10000 AS decimal(38,0)) div n AS decimal(38,0)) / 10000BD"),
    "trunc6": ("x DOUBLE", "DECIMAL(38,6)", "cast(CASE WHEN x < 0 THEN ceil(x * 1000000) ELSE floor(x * 1000000) END AS decimal(30,0)) / 1000000BD"),
}
#: Functions of sets take any member type, so they are rewritten to built-in ones.
SETS = {"setcontains": "array_contains({0}, {1})", "setcontainsany": "arrays_overlap({0}, {1})", "setcontainsall": "(size(array_except({1}, {0})) = 0)"}


def register(spark: SparkSession, text: str | None = None) -> None:
    """Make the functions known to a session: all, or those that a statement uses."""
    for name, (params, kind, body) in FUNCTIONS.items():
        if text is None or f"{PREFIX}{name}(" in text:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({params}) RETURNS {kind} RETURN {body}")
