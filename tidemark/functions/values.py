"""Values of nine kinds, typed or as VARIANT: paths, strict accessors, kinds, and keys that order across kinds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letter that orders each kind of value in an index, null and missing being the same.
LETTERS = {"array": "A", "bool": "B", "id": "D", "float": "F", "int": "I", "null": "N", "object": "O", "string": "S", "bytes": "Y"}
#: The kind of each Spark type.
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float",
    "string": "string", "boolean": "bool", "binary": "bytes",
}


def kind_of_type(spark_type: str) -> str | None:
    """The kind of a column's type; null for types that aren't index keys."""
    return KINDS.get(spark_type)


def kind_of_literal(v: object) -> str:
    if v is None:
        return "null"
    for t, k in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (bytes, "bytes"), (bytearray, "bytes")):
        if isinstance(v, t):
            return k
    raise TypeError(f"{type(v).__name__} is no key")


def json_path(path: str) -> str:
    """A dotted path through objects as a JSON path; names are quoted, arrays aren't indexed."""
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def at_path(v: Column, path: str) -> Column:
    """The VARIANT at a dotted path; null if any step is missing."""
    return F.variant_get(v, json_path(path), "variant")


def kind(v: Column) -> Column:
    """The kind of a VARIANT: 'null' for a null in it, SQL null where it is missing."""

    def named(s: Column) -> Column:
        return (
            F.when(s == "VOID", "null")
            .when(s == "BOOLEAN", "bool")
            .when(s == "BIGINT", "int")
            .when(s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "float")
            .when(s == "STRING", "string")
            .when(s == "BINARY", "bytes")
            .when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object")
        )

    return F.transform(F.array(F.schema_of_variant(v)), named)[0]  # the schema is worked out once


def _strict(v: Column, want: str, sql_type: str) -> Column:
    return F.when(kind(v) == want, F.try_variant_get(v, "$", sql_type))


def to_bool(v: Column) -> Column:
    return _strict(v, "bool", "boolean")


def to_int(v: Column) -> Column:
    return _strict(v, "int", "bigint")


def to_float(v: Column) -> Column:
    """A float; an int is none."""
    return _strict(v, "float", "double")


def to_number(v: Column) -> Column:
    """A float or an int, as DOUBLE."""
    return F.when(kind(v).isin("int", "float"), F.try_variant_get(v, "$", "double"))


def to_string(v: Column) -> Column:
    return _strict(v, "string", "string")


def to_bytes(v: Column) -> Column:
    return _strict(v, "bytes", "binary")


def has_key(v: Column, name: str) -> Column:
    """Whether an object has the field, be it null."""
    return F.coalesce(at_path(v, name).isNotNull(), F.lit(False))


def get_or(v: Column, name: str, default: Column) -> Column:
    """The field as VARIANT, ``default`` where it is missing."""
    return F.coalesce(at_path(v, name), default.cast("variant"))


def get_strict(v: Column, name: str) -> Column:
    """The field; raises where it is missing."""
    return F.when(has_key(v, name), at_path(v, name)).otherwise(F.raise_error(F.lit(f"no field {name}")).cast("variant"))


@F.pandas_udf(T.StringType())
def _float_bits(s: pd.Series) -> pd.Series:
    """Sixteen hex digits that order as the floats do, the negative zero before the positive one, NaN above all."""
    v = s.to_numpy(dtype="float64", na_value=np.nan).view("int64")
    u = np.where(v < 0, ~v, v | np.int64(-(1 << 63))).view("uint64")
    return pd.Series(np.frombuffer(u.astype(">u8").tobytes().hex().encode(), "S16").astype(str))


def index_key(v: Column) -> Column:
    """A string that orders VARIANT scalars as an index does: by the kind's letter, then by value within it.

    Null and missing share one key. Objects and arrays get no key of their own value (their letter only), so they take
    part in ranges but must not be looked up by key.
    """
    k = kind(v)
    top = F.lit(-(1 << 63)).cast("long")
    return (
        F.when(k.isNull() | (k == "null"), "N|")
        .when(k == "bool", F.concat(F.lit("B|"), F.when(to_bool(v), "1").otherwise("0")))
        .when(k == "int", F.concat(F.lit("I|"), F.lower(F.lpad(F.hex(to_int(v).bitwiseXOR(top)), 16, "0"))))
        .when(k == "float", F.concat(F.lit("F|"), _float_bits(to_float(v))))
        .when(k == "string", F.concat(F.lit("S|"), to_string(v)))
        .when(k == "bytes", F.concat(F.lit("Y|"), F.hex(to_bytes(v))))
        .when(k == "array", "A|")
        .otherwise("O|")
    )
