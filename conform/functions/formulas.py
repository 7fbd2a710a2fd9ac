"""The closed formula set, compiled to Column expressions.

Every formula yields a ``(value, reason)`` pair: ``value`` is null exactly when ``reason`` is set.
Nothing here can throw at run time, so one bad record never fails a job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from conform.functions.text import quoted

# The formula names a mapping may use.
FORMULAS = ("concat", "substring", "regex_extract", "date_format", "number_format", "arith")

# The accepted input date layouts, tried in this order.
DATE_LAYOUTS = (
    (r"^([A-Za-z]{3})\s+(\d{1,2}),\s+(\d{4})$", ("mon", "d", "y")),
    (r"^([A-Za-z]{3,9})\s+(\d{1,2}),\s+(\d{4})$", ("month", "d", "y")),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", ("y", "m", "d")),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", ("d", "m", "y")),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")

# Strftime directives and the date pattern letters that print the same text.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%a": "EEE",
    "%A": "EEEE", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss", "%%": "'%'",
}


class ConfigError(ValueError):
    """A mapping, template or profile definition outside the accepted grammar."""


@dataclass(frozen=True)
class Result:
    value: Column
    reason: Column


def _ok(value: Column) -> Result:
    return Result(value, F.lit(None).cast("string"))


def concat(args: list[Column]) -> Result:
    return _ok(F.concat(*args))


def substring(text: Column, start: int = 0, end: int | None = None) -> Result:
    """Zero-based half-open slice; negative bounds count from the end."""
    n = F.length(text)

    def bound(b: int) -> Column:
        return F.lit(b) if b >= 0 else F.greatest(n + F.lit(b), F.lit(0))

    lo = bound(start)
    hi = n if end is None else F.least(bound(end), n)
    return _ok(F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0))))


def regex_extract(text: Column, pattern: str) -> Result:
    try:
        groups = re.compile(pattern).groups
    except re.error as err:
        raise ConfigError(f"bad pattern {pattern!r}: {err}") from err
    if "(?P" in pattern or r"\Z" in pattern:
        raise ConfigError(f"pattern {pattern!r} uses syntax the engine cannot run")
    hit = text.rlike(pattern)
    reason = F.concat(F.lit(f"regex '{pattern}' matched nothing in "), quoted(text))
    return Result(
        F.when(hit, F.regexp_extract(text, pattern, 1 if groups else 0)),
        F.when(~hit, reason),
    )


def parse_date(text: Column) -> Column:
    """First accepted layout that is a real calendar date, else null (never an error)."""
    t = F.trim(text)
    full = F.expr("map(" + ", ".join(f"'{m}', {i}" for i, m in enumerate(MONTHS, 1)) + ")")
    short = F.expr("map(" + ", ".join(f"'{m[:3]}', {i}" for i, m in enumerate(MONTHS, 1)) + ")")
    tries = []
    for pattern, parts in DATE_LAYOUTS:
        got = {p: F.regexp_extract(t, pattern, k) for k, p in enumerate(parts, 1)}
        if "mon" in got:
            month = F.try_element_at(short, F.lower(got["mon"]))
        elif "month" in got:
            month = F.try_element_at(full, F.lower(got["month"]))
        else:
            month = got["m"].try_cast("int")
        made = F.try_make_timestamp(got["y"].try_cast("int"), month, got["d"].try_cast("int"),
                                    F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
        tries.append(F.when(t.rlike(pattern), made))
    return F.coalesce(*tries)


def spark_date_pattern(strftime: str) -> str:
    out, i = [], 0
    while i < len(strftime):
        if strftime[i] == "%":
            token = strftime[i:i + 2]
            if token not in STRFTIME:
                raise ConfigError(f"date directive {token!r} is not supported")
            out.append(STRFTIME[token])
            i += 2
        else:
            ch = strftime[i]
            out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
            i += 1
    return "".join(out)


def date_format(text: Column, strftime: str) -> Result:
    ts = parse_date(text)
    reason = F.concat(F.lit("date value "), quoted(text), F.lit(" matches no supported input format"))
    return Result(F.date_format(ts, spark_date_pattern(strftime)), F.when(ts.isNull(), reason))


@F.pandas_udf(StringType())
def _python_format(number: pd.Series, spec: pd.Series) -> pd.Series:
    """Rare format specs only; the common fixed-point ones stay in the JVM."""
    return pd.Series([None if pd.isna(n) else format(float(n), s) for n, s in zip(number, spec)])


def _to_double(text: Column) -> Column:
    """A decimal number with optional sign, point and exponent, outer blanks allowed; anything else is null.

    Suffixed, hexadecimal and non-finite spellings are not numbers here: they would be guesses.
    """
    t = F.trim(text)
    number = F.regexp_replace(t, "^[+]", "").try_cast("double")
    sound = t.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(number) < F.lit(float("inf")))
    return F.when(sound, number)


def number_format(text: Column, spec: str) -> Result:
    number = _to_double(text)
    fixed = re.fullmatch(r"(,?)\.(\d{1,2})f", spec)
    if fixed:
        body = F.format_number(number, int(fixed.group(2)))
        value = body if fixed.group(1) else F.replace(body, F.lit(","), F.lit(""))
    else:
        try:
            format(1.5, spec)
        except ValueError as err:
            raise ConfigError(f"number format {spec!r}: {err}") from err
        value = _python_format(number, F.lit(spec))
    reason = F.concat(F.lit("number value "), quoted(text), F.lit(" is not numeric"))
    return Result(value, F.when(number.isNull(), reason))


def print_float(x: Column) -> Column:
    """Shortest text of a double in the layout a scripting language prints it."""
    size = F.abs(x)
    java = x.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    sign = F.when(java.contains("E-"), "-").otherwise("+")
    exponent = F.concat(
        F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", ""),
        F.lit("e"), sign, F.lpad(F.regexp_extract(java, r"E-?(\d+)$", 1), 2, "0"),
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def arith(left: Column, op: str, right: Column) -> Result:
    a, b = _to_double(left), _to_double(right)
    table = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}
    if op not in table:
        raise ConfigError(f"arith operator {op!r} is not one of + - * /")
    r = table[op]
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) < F.lit(1e38))
    whole = F.floor(r.cast("double"))
    value = F.when(
        finite,
        F.when((F.abs(r) >= 9e18) | (r == whole), r.try_cast("decimal(38,0)").cast("string"))
        .otherwise(print_float(r)),
    )
    reason = F.concat(F.lit("arith cannot evaluate "), left, F.lit(f" {op} "), right)
    return Result(value, F.when(value.isNull(), reason))
