"""Order-preserving 64-bit keys of orderable column types.

``order_keys`` maps a value to one or more ``bigint`` columns; compared one after the other they order
as the value does (Spark's order: NaN is the largest double, and -0.0 equals 0.0). Values can then be
bucketed by the high bits of a key, whatever their type.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key that one bucket step looks at.
STEP_BITS = 16
# The layout of a 64-bit floating point number.
_FRACTION, _BIAS, _EXPONENTS = 52, 1023, 2047
#: Digits of a wide decimal that one key holds, and the bits they need.
_DIGITS, _DIGIT_BITS = 13, 48


def double_key(value: Column) -> Column:
    """The bits of a double as a signed integer: its order is that of the doubles.

    Spark has no function that reads a double's bits, so exponent and fraction are computed, exactly:
    scaling by a power of two loses nothing, and the exponent that ``log2`` suggests is checked.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    scaled = size / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(scaled < 1, -1).when(scaled >= 2, 1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << _FRACTION)).cast("bigint")
    normal = (exponent + _BIAS).cast("bigint") * (1 << _FRACTION) + fraction
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")  # below the normal range the bits are a count
    infinite = F.lit(_EXPONENTS << _FRACTION)
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), infinite)
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def _decimal_keys(value: Column, kind: T.DecimalType) -> list[tuple[Column, int]]:
    if kind.precision <= 18:
        unscaled = value * F.lit(Decimal(10) ** kind.scale) if kind.scale else value
        return [(unscaled.cast("bigint"), 64)]
    # Wider ones by their 39 digits, whole part and fraction padded, in three keys; the digits of a
    # negative number all get its sign.
    text = F.abs(value).cast(T.DecimalType(38, kind.scale)).cast("string")
    whole, part = F.substring_index(text, ".", 1), F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise("")
    digits = F.concat(F.lpad(whole, 3 * _DIGITS - kind.scale, "0"), F.rpad(part, kind.scale, "0") if kind.scale else F.lit(""))
    sign = F.when(value < 0, -1).otherwise(1)
    return [(F.substring(digits, 1 + _DIGITS * k, _DIGITS).cast("bigint") * sign, _DIGIT_BITS) for k in range(3)]


def order_keys(value: Column, kind: T.DataType) -> list[tuple[Column, int]]:
    """Keys of a non-NULL ``value`` of type ``kind``, the most significant first, and their bits."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        return [(value.cast("int").cast("bigint"), 32)]
    if isinstance(kind, T.LongType):
        return [(value, 64)]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [(double_key(value.cast("double")), 64)]
    if isinstance(kind, T.DecimalType):
        return _decimal_keys(value, kind)
    if isinstance(kind, T.DateType):
        return [(F.unix_date(value).cast("bigint"), 32)]
    if isinstance(kind, T.TimestampType):
        return [(F.unix_micros(value), 64)]
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return [(F.timestamp_diff("MICROSECOND", epoch, value), 64)]
    raise TypeError(f"no order key for values of type {kind.simpleString()}")


def bucket_steps(keys: list[tuple[Column, int]]) -> list[tuple[int, int]]:
    """(key, shift) of each bucket step; what is left after the last is ``STEP_BITS`` of the last key."""
    steps = []
    for k, (_, bits) in enumerate(keys):
        last = STEP_BITS if k == len(keys) - 1 else 0
        steps += [(k, shift) for shift in range(bits - STEP_BITS, last - 1, -STEP_BITS)]
    return steps
