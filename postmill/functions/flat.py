"""Values as they appear in a CSV cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json_string(c: Column) -> Column:
    """One string as a JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(c))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def float_text(c: Column) -> Column:
    """A double as the shortest decimal text: plain from 0.0001 up to 10 to the 16th, else with a signed exponent."""
    s, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(?<=\d)0+$", "")
    small = F.regexp_replace(c.cast("decimal(38,30)").cast("string"), r"0+$", "")
    parts = lambda k: F.regexp_extract(s, r"^(-?[0-9.]+?)(?:\.0)?E(-?)([0-9]+)$", k)
    power = F.concat(parts(1), F.lit("e"), F.when(parts(2) == "-", "-").otherwise("+"), F.when(F.length(parts(3)) < 2, F.lpad(parts(3), 2, "0")).otherwise(parts(3)))
    with_point = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    return (F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
            .when((size >= 1e7) & (size < 1e16), with_point).when((size >= 1e-4) & (size < 1e-3), small)
            .when(F.contains(s, F.lit("E")), power).otherwise(s))


def spaced_json(c: Column, dtype: T.DataType) -> Column:
    """JSON text with a blank after every comma and colon; nulls are written."""
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: spaced_json(x, dtype.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}": '), spaced_json(c[f.name], f.dataType)) for f in dtype.fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(dtype, T.StringType):
        body = _json_string(c)
    elif isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        body = float_text(c.cast("double"))
    else:
        body = c.cast("string")
    return F.coalesce(body, F.lit("null"))


def csv_value(c: Column, dtype: T.DataType) -> Column:
    """Empty, zero, false and null become ''; lists and structs become JSON; the rest is text."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, T.ArrayType):
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "").otherwise(spaced_json(c, dtype))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNull(), "").otherwise(spaced_json(c, dtype))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").otherwise("")
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return F.when(F.coalesce(c, F.lit(0.0)) == 0, "").otherwise(float_text(c.cast("double")))
    if isinstance(dtype, T.NumericType):
        return F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))
