"""Scalar expressions, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp01(x) -> Column:
    """Into [0, 1]; NaN stays NaN, which greatest and least would make 1."""
    x = as_col(x)
    return F.when(F.isnan(x), x).when(x < 0.0, F.lit(0.0)).when(x > 1.0, F.lit(1.0)).otherwise(x)


def rounded(x, scale: float) -> Column:
    # round(x, n) rounds the decimal text of a double, which differs on some halves
    return F.round(as_col(x) * F.lit(scale)) / F.lit(scale)


def round2(x) -> Column:
    return rounded(x, 100.0)


def round4(x) -> Column:
    return rounded(x, 10000.0)


def divided(a, b) -> Column:
    """a / b with IEEE results for b = 0, which ANSI mode would refuse."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    infinite = F.when((a == 0.0) | F.isnan(a), F.lit(float("nan"))).when(a > 0.0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0.0, infinite).otherwise(F.try_divide(a, b))


def epoch_of(text) -> Column:
    """Epoch seconds of an ISO-8601 UTC text of seconds."""
    return F.unix_timestamp(F.to_timestamp(as_col(text), ISO))


def iso_of(epoch) -> Column:
    return F.date_format(F.timestamp_seconds(as_col(epoch)), ISO)


def day_of_week(ts) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(as_col(ts))


def minutes_between(later, earlier) -> Column:
    """Fractional minutes at second precision; negative if later comes first."""
    seconds = lambda x: F.unix_timestamp(as_col(x).cast("timestamp"))
    return (seconds(later) - seconds(earlier)) / F.lit(60.0)


def code(text, chars: int = 7) -> Column:
    """Cut to the length at which codes and labels are compared."""
    return F.substring(as_col(text), 1, chars)


def first_match(pairs: list[tuple[str, float]], key, default: float) -> Column:
    """The value of the first pair with this key."""
    seen: dict[str, float] = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    if not seen:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
    return F.coalesce(F.element_at(table, as_col(key)), F.lit(default))


def numbered(prefix: str, n, width: int = 0) -> Column:
    """prefix and a number, with leading zeros up to width; longer numbers stay whole."""
    return F.format_string(f"{prefix}%{f'0{width}' if width else ''}d", as_col(n))


def json_number(x) -> Column:
    """Whole numbers without a point, else up to 10 decimals without trailing zeros."""
    x = as_col(x)
    short = F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(short)


def json_array(vector) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(as_col(vector), json_number), ","), F.lit("]"))


def fixed(x, digits: int) -> Column:
    """Rounded to digits, as a number."""
    return F.round(as_col(x), digits)


def percent(share, digits: int = 2) -> Column:
    """A share as a percentage, shortest form: 0.011 is 1.1%."""
    return F.concat(json_number(fixed(as_col(share) * 100.0, digits)), F.lit("%"))


def sha256(x) -> Column:
    return F.sha2(as_col(x), 256)


def xored(a, b) -> Column:
    return as_col(a).bitwiseXOR(as_col(b))


def shifted_left(x, n: int, bits: int = 32) -> Column:
    """Of an unsigned number of `bits` bits, held in a long."""
    return F.shiftleft(as_col(x).cast("long"), n).bitwiseAND(F.lit((1 << bits) - 1))


def shifted_right(x, n: int) -> Column:
    return F.shiftrightunsigned(as_col(x).cast("long"), n)


def rotated_right(x, n: int, bits: int = 32) -> Column:
    """Rotation of an unsigned number of `bits` bits, held in a long."""
    x, mask = as_col(x).cast("long"), (1 << bits) - 1
    if not n % bits:
        return x
    n %= bits
    return F.shiftrightunsigned(x, n).bitwiseOR(F.shiftleft(x, bits - n)).bitwiseAND(F.lit(mask))


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance, summed from the first dimension to the last."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def l1(a, b) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, t: s + t)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def cosine(a, b) -> Column:
    """Cosine distance; 1 if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0.0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot(a, b), size))
