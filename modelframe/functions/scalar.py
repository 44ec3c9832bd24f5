"""Per-value functions: composite key text, scores, time buckets, significant figures, symbol classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds from the Unix epoch to the start of scores, 2017-01-01, and of one period.
SCORE_EPOCH, PERIOD = 1_483_228_800, 300


def escape_key(column: Column) -> Column:
    """A key part as text in which the separator and pattern characters stand for themselves."""
    out = F.replace(column.cast("string"), F.lit("/"), F.lit("//"))
    out = F.regexp_replace(out, r"(['?*^\[\]-])", "/$1")
    return F.replace(out, F.lit(":"), F.lit("{&#58;}"))


def unescape_key(column: Column) -> Column:
    out = F.replace(column, F.lit("{&#58;}"), F.lit(":"))
    return F.regexp_replace(out, r"/(['?*^\[\]/-])", "$1")


def composite_key(model: str, *parts: Column) -> Column:
    """Model name and key parts joined by colons; null parts read None."""
    return F.concat_ws(":", F.lit(model), *(F.coalesce(escape_key(p), F.lit("None")) for p in parts))


def key_parts(column: Column) -> Column:
    """The parts of composite key texts, unescaped, the model's name first; None reads as null."""
    return F.transform(F.split(column, ":"), lambda p: F.when(p != "None", unescape_key(p)))


def key_text_parts(text: str) -> list[str | None]:
    """As `key_parts`, of one text."""
    plain = lambda p: re.sub(r"/(['?*^\[\]/-])", r"\1", p.replace("{&#58;}", ":"))
    return [None if p == "None" else plain(p) for p in text.split(":")]


def numeric_score(column: Column, kind: T.DataType) -> Column:
    """The number that orders a sorted column's values."""
    if isinstance(kind, T.DateType):
        return (F.datediff(column, F.lit("0001-01-01").cast("date")) + 1).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)
    return column.cast("double")


def unix_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def score_from_ts(t: Column) -> Column:
    return (t - SCORE_EPOCH) / F.lit(PERIOD)


def _floored(value: Column, step: int) -> Column:
    return (value - F.pmod(value, F.lit(step))).cast("long")


def nearest_day(t: Column) -> Column:
    return _floored(t + 21_600, 86_400)


def nearest_day_score(s: Column) -> Column:
    return _floored(s + 72, 288)


def is_near_hour(t: Column) -> Column:
    return F.pmod(t + 150, F.lit(3600)) < 300


def is_near_hour_score(s: Column) -> Column:
    r = F.pmod(s, F.lit(12))
    return (r < 3) | (r > 9)


def nearest_hour(t: Column) -> Column:
    return _floored(t + 150, 3600)


def nearest_hour_score(s: Column) -> Column:
    return _floored(s + 3, 12)


def is_near_5min(t: Column) -> Column:
    return F.pmod(t + 45, F.lit(300)) < 90


def is_near_5min_score(s: Column) -> Column:
    """Less than 45 seconds from a whole period."""
    return F.abs(s - F.rint(s)) < 45 / PERIOD


def nearest_5min(t: Column) -> Column:
    return _floored(t + 45, 300)


def nearest_5min_score(s: Column) -> Column:
    return F.rint(s).cast("long")


def significant(value: Column, figures: int = 6) -> Column:
    return F.format_string(f"%.{figures - 1}e", value).cast("double")


def round_to_figures(value: Column, figures: int) -> Column:
    """Decimals are figures less the digits of the whole part; symmetric in sign."""
    decimals = F.lit(figures) - F.length(F.abs(value).cast("long").cast("string"))
    scale = F.pow(F.lit(10.0), decimals.cast("double"))
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def asset_class(symbol: Column, classes: dict[str, list[str]], default: str = "other") -> Column:
    out = None
    for name, symbols in classes.items():
        hit = symbol.isin(symbols)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


#: Functions for SQL text: bodies are SQL, so that they stay in the optimizer's sight.
SQL_FUNCTIONS = {
    "nearest_5min(t BIGINT)": "BIGINT RETURN floor((t + 45) / 300) * 300",
    "nearest_1hr(t BIGINT)": "BIGINT RETURN floor((t + 150) / 3600) * 3600",
    "nearest_1day(t BIGINT)": "BIGINT RETURN floor((t + 21600) / 86400) * 86400",
    "is_near_5min(t BIGINT)": "BOOLEAN RETURN pmod(t + 45, 300) < 90",
    "score_of(t BIGINT)": f"DOUBLE RETURN (t - {SCORE_EPOCH}) / CAST({PERIOD} AS DOUBLE)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the time functions callable from SQL text of this session; their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
    return [head.partition("(")[0] for head in SQL_FUNCTIONS]
