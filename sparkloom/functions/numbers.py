"""Binary and decimal numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)


def _mapped(c: Column, kind: T.DataType, leaf) -> Column:
    """c with leaf applied to its numbers, through structs, arrays and maps; leaf gives None where nothing changes."""
    new = leaf(c, kind)
    if new is not None:
        return new
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_mapped(c[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _mapped(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _mapped(x, kind.valueType, leaf))
    return c


def floats_to_decimals(df: DataFrame) -> DataFrame:
    """df with every float or double, at any depth, as the decimal that it is written as; nan and infinities become null."""

    def leaf(c: Column, kind: T.DataType) -> Column | None:
        return c.cast("string").try_cast(DECIMAL) if isinstance(kind, (T.FloatType, T.DoubleType)) else None

    return df.select(*[_mapped(F.col(f.name), f.dataType, leaf).alias(f.name) for f in df.schema.fields])


def decimals_to_numbers(df: DataFrame) -> DataFrame:
    """df with every decimal, at any depth, as a struct: whole (long) if it is integral, else real (double)."""

    def leaf(c: Column, kind: T.DataType) -> Column | None:
        if not isinstance(kind, T.DecimalType):
            return None
        integral = c % 1 == 0
        return F.when(c.isNotNull(), F.struct(F.when(integral, c.cast("long")).alias("whole"), F.when(~integral, c.cast("double")).alias("real")))

    return df.select(*[_mapped(F.col(f.name), f.dataType, leaf).alias(f.name) for f in df.schema.fields])
