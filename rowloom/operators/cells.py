"""Wide tables to long cells: row ids, column kinds, cleaned values, tokens, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import text
from rowloom.operators.hot_keys import frequent, lookup_join
from rowloom.operators.numbering import dense_index

ROW_PREFIX = "idx__"
# columns that steer the flow and are no data
CONTROL_COLUMNS = ("rid", "timestamp")

_NUMERIC_TYPES = (T.NumericType, T.BooleanType)


def row_ids(df: DataFrame, key: str | None = None, order: list[str] | None = None, start: int = 0) -> DataFrame:
    """Add ``rid_no`` and ``rid`` from a whole-number key column, or by numbering the rows."""
    if key is not None:
        numbered = df.withColumn("rid_no", F.col(key).cast("bigint"))
    elif order:
        numbered = dense_index(df, order, "rid_no", start)
    else:
        raise ValueError("give a key column, or the order in which to number the rows")
    return numbered.withColumn("rid", F.concat(F.lit(ROW_PREFIX), F.col("rid_no").cast("string")))


def data_columns(df: DataFrame, key: str | None = None) -> list[str]:
    skip = {key, "rid_no", *CONTROL_COLUMNS}
    return [c for c in df.columns if c not in skip]


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: is every value that is not null a number?"""
    cols = cols or data_columns(df)
    flags = []
    for c in cols:
        dtype = df.schema[c].dataType
        if isinstance(dtype, _NUMERIC_TYPES):
            flag = F.lit(True)
        elif isinstance(dtype, T.StringType):
            flag = F.bool_and(
                F.col(c).isNull() | (F.col(c) == "") | text.is_number(F.col(c)) | text.is_nan(F.col(c))
                | F.lower(F.trim(F.col(c))).isin("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
            )
        else:
            flag = F.lit(False)
        flags.append(F.coalesce(flag, F.lit(True)).alias(c))
    pairs = [F.struct(F.lit(c).alias("col"), F.col(c).alias("is_numeric")) for c in cols]
    return df.agg(*flags).select(F.inline(F.array(*pairs)))


def _numeric_names(df: DataFrame, cols: list[str]) -> set[str]:
    typed = {c for c in cols if isinstance(df.schema[c].dataType, _NUMERIC_TYPES)}
    strings = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not strings:
        return typed
    # one row per text column: schema-sized
    found = numeric_columns(df, strings).filter("is_numeric").collect()
    return typed | {row.col for row in found}


def cells(
    df: DataFrame,
    key: str | None = None,
    cols: list[str] | None = None,
    numeric: list[str] | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Long table ``rid_no, rid, col_no, col, pos, value, is_numeric``, one row per kept value.

    A ``rid``/``rid_no`` pair made by :func:`row_ids` is used when present. ``numeric`` names the
    numeric columns; without it, text columns are tested by one scan, typed columns by their type.
    Columns in ``carry`` are no data and go along with every cell.
    """
    table = df if "rid_no" in df.columns else row_ids(df, key)
    cols = cols or [c for c in data_columns(df, key) if c not in carry]
    known = set(numeric) if numeric is not None else _numeric_names(df, cols)
    entries = [
        F.struct(
            F.lit(i).alias("col_no"),
            F.lit(c).alias("col"),
            F.lit(c in known).alias("is_numeric"),
            text.cell_values(F.col(c), df.schema[c].dataType, c in known).alias("values"),
        )
        for i, c in enumerate(cols)
    ]
    return (
        table.select(*carry, "rid_no", "rid", F.inline(F.array(*entries)))
        .select(*carry, "rid_no", "rid", "col_no", "col", "is_numeric", F.posexplode("values").alias("pos", "value"))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .select(*carry, "rid_no", "rid", "col_no", "col", "pos", "value", "is_numeric")
    )


def raw_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Every cell as plain text, not cleaned; null cells dropped."""
    cols = cols or data_columns(df)
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("value")).filter(
        F.col("value").isNotNull() & (F.col("value") != "")
    )


def tokens(cell_table: DataFrame, flatten: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """Split values on ``_``; values in ``keep`` (column ``value``) stay whole.

    Adds ``sub``, the position inside the value, and replaces ``value`` by the token.
    """
    if not flatten:
        return cell_table.withColumn("sub", F.lit(0))
    parts = F.split("value", "_")
    if keep is not None:
        kept = keep.select("value").distinct().withColumn("_keep", F.lit(True))
        cell_table = lookup_join(cell_table, kept, ["value"], frequent(cell_table, "value"), "left")
        parts = F.when(F.col("_keep"), F.array("value")).otherwise(parts)
    columns = [c for c in cell_table.columns if c not in ("value", "_keep")]
    return cell_table.select(*columns, F.posexplode(parts).alias("sub", "value"))


def value_frequency(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of each value, over all columns together; per group of the columns ``by``."""
    return values.filter(F.col("value") != "").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("frequency"))


def distinct_token_estimate(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(rows + distinct values + columns) * 10``; nulls count as one more value."""
    cols = cols or df.columns
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("value"))
    # distinct first, so that the count is over a table spread by value
    n_values = values.distinct().agg(F.count(F.lit(1)).alias("n_values"))
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    # two one-row tables
    return n_rows.join(F.broadcast(n_values), F.lit(True)).select(
        ((F.col("n_rows") + F.col("n_values") + F.lit(len(cols))) * 10).alias("n_tokens")
    )


def values_by_source(sources: dict[str, DataFrame]) -> DataFrame:
    """Frequency of each raw value in each named source."""
    merged = None
    for name, df in sources.items():
        part = raw_values(df).withColumn("source", F.lit(name))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("source", "value").agg(F.count(F.lit(1)).alias("frequency"))
