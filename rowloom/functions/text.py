"""Column expressions for cell text and node names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: numeric text is a plain or exponent decimal. Java suffixes ("12d"), digit group
# marks ("1_000"), "inf" and "nan" are not numbers.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Doubles beyond this magnitude do not fit a BIGINT and stay text.
BIGINT_SAFE = 9.0e18


def is_number(text: Column) -> Column:
    return F.trim(text).rlike(NUMBER)


def is_nan(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("nan", "+nan", "-nan")


def normalise(text: Column) -> Column:
    """Escape quotes, drop commas, turn spaces into underscores."""
    escaped = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.translate(escaped, " ,", "_")


def canonical(text: Column) -> Column:
    """Empty and NaN text to null, numbers truncated toward zero, other text unchanged."""
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (text == "") | is_nan(text), F.lit(None).cast("string"))
        .when(
            is_number(text) & (F.abs(number) < BIGINT_SAFE),
            number.try_cast("bigint").cast("string"),
        )
        .otherwise(text)
    )


def list_elements(text: Column) -> Column:
    """Elements of a list literal; null when the text is not one."""
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(text.startswith("[") & text.endswith("]"), parsed)


def cell_values(column: Column, dtype: T.DataType, numeric: bool) -> Column:
    """All values of one cell, in order, as ``array<string>``.

    Integer columns skip the text rules, floating ones are truncated without going through a
    regular expression, booleans count as 0 and 1, and arrays give one value per element.
    """
    if isinstance(dtype, T.ArrayType):
        return F.transform(column.cast("array<string>"), lambda v: canonical(normalise(v)))
    if isinstance(dtype, T.BooleanType):
        return F.array(column.cast("int").cast("string"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.array(column.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        number = column.cast("double")
        return F.array(
            F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
            .when(F.abs(number) < BIGINT_SAFE, number.try_cast("bigint").cast("string"))
            .when(number == float("inf"), "inf")
            .when(number == float("-inf"), "-inf")
            .otherwise(column.cast("string"))
        )
    text = column.cast("string")
    if numeric:
        return F.array(canonical(F.trim(text)))
    return F.transform(
        F.coalesce(list_elements(text), F.array(text)), lambda v: canonical(normalise(v))
    )


def node_prefix(node: Column) -> Column:
    return F.substring_index(node, "__", 1)


def node_name(node: Column) -> Column:
    """The part of a node name after its prefix."""
    return F.substring(node, F.instr(node, "__") + F.lit(2), F.length(node))


def strip_prefix(node: Column, prefixes: list[str]) -> Column:
    """Remove one of the given prefixes; names with any other prefix stay whole."""
    known = node_prefix(node).isin(prefixes) & node.contains("__")
    return F.when(known, node_name(node)).otherwise(node)


def id_number(node: Column) -> Column:
    """``idx__17`` to 17; null when the rest is no whole number."""
    return node_name(node).try_cast("bigint")


def base36(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 36)
