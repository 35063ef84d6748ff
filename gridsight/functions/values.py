"""Column views of a table: missing-aware values, numbers, text, type families."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# A number written as plain text; excludes Java-only spellings such as "1d".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*INTEGRAL, *FLOATING, T.DecimalType))


def family(dtype: T.DataType) -> str:
    """Types that can share one unpivoted value column."""
    if isinstance(dtype, INTEGRAL):
        return "bigint"
    if isinstance(dtype, (*FLOATING, T.DecimalType)):
        return "double"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TEMPORAL):
        return "timestamp_ntz"
    return "string"


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN read as missing and -0.0 as 0.0."""
    if isinstance(dtype_of(df, name), FLOATING):
        return F.nanvl(col(name), F.lit(None).cast("double")) + F.lit(0.0)
    return col(name)


def native(df: DataFrame, name: str) -> Column:
    """The value in its family's type; nested values become JSON text."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    return present(df, name).cast(family(dtype))


def as_number(df: DataFrame, name: str) -> Column:
    """The value as double; text that is no number becomes null."""
    dtype = dtype_of(df, name)
    if is_numeric(dtype):
        return present(df, name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("double")
    if isinstance(dtype, T.StringType):
        text = col(name)
        return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return F.lit(None).cast("double")


def text_of(value: Column, kind: str) -> Column:
    """Text of a family value: `True`/`False`, and doubles without exponents
    between 1e-4 and 1e16."""
    if kind == "boolean":
        return F.initcap(value.cast("string"))
    if kind == "double":
        plain = value.cast("string")
        size = F.abs(value)
        spelled_out = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
        digits = F.rtrim(value.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
        digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
        return F.when(spelled_out, digits).otherwise(plain)
    return value.cast("string")


def as_text(df: DataFrame, name: str) -> Column:
    return text_of(native(df, name), family(dtype_of(df, name)))


def with_families(df: DataFrame, names: Iterable[str] | None = None) -> dict[str, list[str]]:
    """Column names grouped by type family, in table order."""
    wanted = set(df.columns if names is None else names)
    groups: dict[str, list[str]] = {}
    for field in df.schema.fields:
        if field.name in wanted:
            groups.setdefault(family(field.dataType), []).append(field.name)
    return groups


def long_form(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One narrow row per cell: (pos, value). All values share one type.

    `pos` numbers the columns; a whole number groups faster than a name, and
    `with_names` puts the names back after grouping.
    """
    cells = [c for i, value in enumerate(values.values()) for c in (F.lit(i), value)]
    return df.select(F.stack(F.lit(len(values)), *cells).alias("pos", "value"))


def with_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Replace `pos` by `column` in a grouped long table."""
    known = F.array(*[F.lit(c) for c in names])
    return df.select(F.get(known, F.col("pos")).alias("column"),
                     *[F.col(c) for c in df.columns if c != "pos"])


def numbers_long(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Non-missing numbers of several columns as (pos, value double)."""
    return long_form(df, {c: as_number(df, c) for c in names}).where(F.col("value").isNotNull())
