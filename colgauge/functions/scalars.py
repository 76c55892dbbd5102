"""Column expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Date patterns of the id templates and their Spark spelling.
DATE_PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss"}
TEMPLATE_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def col(value: str | Column) -> Column:
    return F.col(f"`{value}`") if isinstance(value, str) else value


def seconds(time: str | Column) -> Column:
    """Whole epoch seconds of a date or timestamp, rounded down."""
    return F.unix_seconds(col(time).cast("timestamp"))


def micros(time: str | Column) -> Column:
    return F.unix_micros(col(time).cast("timestamp"))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed whole days, floored: 18:00 the day before noon is 0 days away."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000))


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """A ratio that is NULL where it is undefined; never a guarded denominator."""
    den = col(denominator)
    return F.when(den > 0, col(numerator) / den)


def finite(value: str | Column) -> Column:
    """The value as a double, with NaN and both infinities as NULL."""
    v = col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def key_text(keys: Sequence[str], separator: str = "|") -> Column:
    """A composite key as one text; NULL when any part is NULL."""
    whole = F.concat_ws(separator, *[col(k).cast("string") for k in keys])
    present = F.lit(True)
    for k in keys:
        present = present & col(k).isNotNull()
    return F.when(present, whole)


def normalise_month(value: str | Column) -> Column:
    """``202403`` or ``Mar24`` as ``2024-03``; anything else is NULL."""
    text = F.trim(col(value).cast("string"))
    numeric = F.when(text.rlike(r"^\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMM")))
    # two-digit years from 69 on are of the last century
    century = F.when(F.substring(text, 4, 2) >= "69", "19").otherwise("20")
    named = F.when(
        text.rlike(r"^[A-Za-z]{3}\d{2}$"),
        F.try_to_timestamp(
            F.concat(F.initcap(F.substring(text, 1, 3)), century, F.substring(text, 4, 2)), F.lit("MMMyyyy")
        ),
    )
    return F.date_format(F.coalesce(numeric, named), "yyyy-MM")


def parse_id(df: DataFrame, id_col: str, separator: str = "_", date_format: str = "yyyyMMdd") -> DataFrame:
    """Adds ``key``, ``as_of`` and ``marker`` from ids of the form key_date_marker.

    The key may itself hold the separator: the date and marker are the last two parts.
    """
    parts = F.split(col(id_col), re.escape(separator))
    size = F.size(parts)
    return df.withColumns({
        "key": F.array_join(F.slice(parts, 1, F.greatest(size - 2, F.lit(0))), separator),
        "as_of": F.try_to_timestamp(F.try_element_at(parts, F.lit(-2)), F.lit(date_format)),
        "marker": F.try_element_at(parts, F.lit(-1)),
    })


def id_expression(df: DataFrame, template: str) -> tuple[Column, list[str]]:
    """The id a template describes, and the columns it reads.

    ``{column}`` is taken as it is (whole numbers without a decimal point),
    ``{column:%Y%m%d}`` as a formatted date.
    """
    fields = TEMPLATE_FIELD.findall(template)
    if not fields:
        raise ValueError(f"{template!r} has no {{column}} in it, so every row would get the same id")
    absent = [name for name, _ in fields if name not in df.columns]
    if absent:
        raise KeyError(f"cannot fill {template!r}: no {', '.join(absent)} among {', '.join(df.columns)}")
    # Literal text and fields take turns: split() gives text, name, pattern, text, ...
    parts = TEMPLATE_FIELD.split(template)
    filled = [_template_value(df, name, pattern) for name, pattern in zip(parts[1::3], parts[2::3])]
    texts = [F.lit(text) for text in parts[::3]]
    return F.concat(*[c for pair in zip(texts, filled) for c in pair], texts[-1]), [name for name, _ in fields]


def _template_value(df: DataFrame, name: str, pattern: str | None) -> Column:
    """One field of an id template as text."""
    value, dtype = col(name), df.schema[name].dataType
    if pattern:
        spelled = re.sub("|".join(map(re.escape, DATE_PATTERNS)), lambda m: DATE_PATTERNS[m[0]], pattern)
        return F.date_format(F.try_to_timestamp(value) if isinstance(dtype, T.StringType) else value, spelled)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def build_id(df: DataFrame, template: str, name: str = "id") -> DataFrame:
    """Adds the id a template describes; NULL where one of its parts is blank."""
    expression, _ = id_expression(df, template)
    return df.withColumn(name, expression)


def require_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows, refused with a count and an example if an id is blank or repeated."""
    counts = df.groupBy(col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    bad = counts.filter(F.col("_id").isNull() | (F.trim(F.col("_id").cast("string")) == "") | (F.col("_n") > 1))
    found = bad.agg(F.sum("_n").alias("n"), F.min(F.coalesce(F.col("_id").cast("string"), F.lit("(none)"))).alias("first")).first()
    if found.n:
        raise ValueError(f"{found.n:,} rows have a blank or repeated id, for example {found['first']!r}")
    return df


def id_problems(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: rows, rows without an id, rows sharing their id with another row."""
    counts = df.groupBy(col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("blank_ids"),
        F.coalesce(
            F.sum(F.when(F.col("_id").isNotNull() & (F.col("_n") > 1), F.col("_n"))), F.lit(0)
        ).alias("repeated_ids"),
    )
