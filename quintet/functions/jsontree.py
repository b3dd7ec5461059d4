"""JSON values as expressions: parse, print, inspect, build, change, minify and compare.

Documents of a known shape are parsed with from_json; those of any shape are
VARIANT values. Where a library with a mutable tree adds, detaches or replaces
in place, an expression returns the changed value.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quintet.functions.scalars import as_col

EPSILON = 2.220446049250313e-16


def parse(text, schema: str | None = None) -> Column:
    """A struct, map or array of the schema, or without one a VARIANT; NULL if it isn't JSON or nests over 1000 deep."""
    return F.from_json(as_col(text), schema) if schema else F.try_parse_json(as_col(text))


def parse_prefix(text, length: int, schema: str | None = None) -> Column:
    """parse() of the first characters."""
    return parse(F.substring(as_col(text), 1, length), schema)


def printed(value, pretty: bool = False, nulls: bool = True) -> Column:
    """JSON text; NaN and infinities in doubles should be made null by finite() before."""
    return F.to_json(as_col(value), {"pretty": str(pretty).lower(), "ignoreNullFields": str(not nulls).lower()})


def number_text(x) -> Column:
    """A number as JSON: whole ones of 32 bits plainly, others in 15 significant digits if these read back to it
    (within a relative epsilon), else in 17; null for NaN and infinities. In Arrow batches, as C's %g has no
    counterpart among Spark's functions."""

    def one(v):
        if v is None:
            return None
        if math.isnan(v) or math.isinf(v):
            return "null"
        if v == int(v) and -(1 << 31) <= v < 1 << 31:
            return str(int(v))
        short = "%1.15g" % v
        return short if abs(float(short) - v) <= max(abs(float(short)), abs(v)) * EPSILON else "%1.17g" % v

    # as text, since pandas would take NULL for NaN
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([one(None if v is None else float(v)) for v in x], dtype=object)

    return run(as_col(x).cast("double").cast("string"))


def finite(x) -> Column:
    """x, or NULL for NaN and infinities, which JSON can't hold."""
    x = as_col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def size(value) -> Column:
    return F.size(as_col(value))


def item(array, i: int) -> Column:
    """By place from 0; NULL outside."""
    return F.get(as_col(array), F.lit(i))


def field(mapping, key: str, case_sensitive: bool = False) -> Column:
    """The value of the first key that matches, by default without regard to case."""
    mapping = as_col(mapping)
    if case_sensitive:
        return F.try_element_at(mapping, F.lit(key))
    return F.get(F.filter(F.map_entries(mapping), lambda e: F.lower(e["key"]) == key.lower()), F.lit(0))["value"]


def has(mapping, key: str) -> Column:
    return F.exists(F.map_keys(as_col(mapping)), lambda k: F.lower(k) == key.lower())


def kind(variant) -> Column:
    """null, boolean, number, string, array, object or invalid."""
    variant = as_col(variant)
    name = F.lower(F.schema_of_variant(variant))
    number = name.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    return (
        F.when(variant.isNull(), "invalid").when(F.is_variant_null(variant), "null").when(name == "boolean", "boolean")
        .when(number, "number").when(name == "string", "string").when(name.startswith("array"), "array").when(name.startswith("object"), "object").otherwise("invalid")
    )


def number(variant, path: str = "$") -> Column:
    return F.try_variant_get(as_col(variant), path, "double")


def string(variant, path: str = "$") -> Column:
    return F.try_variant_get(as_col(variant), path, "string")


def appended(array, value) -> Column:
    return F.array_append(as_col(array), as_col(value))


def inserted(array, i: int, value) -> Column:
    """Before place i from 0; at the end if i is beyond it."""
    array = as_col(array)
    return F.when(F.size(array) <= i, F.array_append(array, as_col(value))).otherwise(F.array_insert(array, i + 1, as_col(value)))


def without_item(array, i: int) -> Column:
    return F.filter(as_col(array), lambda x, at: at != i)


def replaced_item(array, i: int, value) -> Column:
    return F.transform(as_col(array), lambda x, at: F.when(at == i, as_col(value)).otherwise(x))


def with_field(mapping, key: str, value) -> Column:
    """Added, or replaced if the key is there."""
    return F.map_concat(without_field(mapping, key, True), F.create_map(F.lit(key), as_col(value)))


def without_field(mapping, key: str, case_sensitive: bool = False) -> Column:
    return F.map_filter(as_col(mapping), lambda k, v: (k != key) if case_sensitive else (F.lower(k) != key.lower()))


#: A string, or one of the things that minify drops. Strings come first, so comment marks inside them stay;
#: nothing is given back, so long strings need no stack.
TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*+|(?s:/\*.*?\*/)|[ \t\r\n]++'


def minify(text) -> Column:
    """White space and // and /* */ comments outside strings dropped."""
    return F.regexp_replace(as_col(text), TOKEN, "$1")


def same(a, b, case_sensitive: bool = True) -> bool:
    """Deep equality of parsed values: objects in any order, numbers within a relative epsilon."""
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= max(abs(a), abs(b)) * EPSILON
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(same(x, y, case_sensitive) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        if not case_sensitive:
            a, b = ({k.lower(): v for k, v in x.items()} for x in (a, b))
        return a.keys() == b.keys() and all(same(a[k], b[k], case_sensitive) for k in a)
    return a == b


def compare(a, b, case_sensitive: bool = True) -> Column:
    """same() of two JSON texts, in Arrow batches; NULL if one isn't JSON."""

    def one(x, y):
        try:
            return same(json.loads(x), json.loads(y), case_sensitive)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="object")

    return run(as_col(a), as_col(b))
