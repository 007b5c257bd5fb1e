"""Recorded bytes to numbers and back, as Column expressions over the scalar types of a channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.elementwise import inf, nan

# Types of a channel, their bytes, and whether they are signed, unsigned, a truth value or floating.
TYPES = {
    "BOOL": (1, "bool"), "SINT": (1, "signed"), "USINT": (1, "unsigned"), "INT": (2, "signed"), "UINT": (2, "unsigned"), "DINT": (4, "signed"), "UDINT": (4, "unsigned"),
    "LINT": (8, "signed"), "ULINT": (8, "unsigned"), "REAL": (4, "float"), "LREAL": (8, "float"),
}


def _by_type(data_type: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, c in of.items():
        out = F.when(data_type == name, c).otherwise(out)
    return out


def size_of(data_type: Column) -> Column:
    """Bytes of a value; null for an unknown type."""
    return _by_type(data_type, {name: F.lit(size) for name, (size, _) in TYPES.items()})


def _bits(payload: Column) -> Column:
    """Up to eight little-endian bytes as the bits of a long."""
    digits = F.rpad(F.hex(payload), 16, "0")
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]), 16, -10).cast("long")


def _with_bits(payload: Column, result) -> Column:
    """``result`` of a payload's bits, which are put together once."""
    return F.element_at(F.transform(F.array(_bits(payload)), result), 1)


def _signed(bits: Column, size: int) -> Column:
    return bits if size == 8 else F.shiftright(F.shiftleft(bits, 64 - 8 * size), 64 - 8 * size)


def _unsigned(bits: Column) -> Column:
    whole = bits.cast("decimal(20,0)")
    return F.when(bits < 0, whole + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")


def _floating(bits: Column, size: int) -> Column:
    """The IEEE 754 number of these bits: every step is exact."""
    fraction, bias = (52, 1023) if size == 8 else (23, 127)
    sign = F.when(F.shiftrightunsigned(bits, 8 * size - 1).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power = F.shiftrightunsigned(bits, fraction).bitwiseAND(F.lit(2 * bias + 1))
    rest = bits.bitwiseAND(F.lit(2**fraction - 1))
    least = F.lit(2.0 ** (1 - bias - fraction))
    normal = (rest + F.lit(2**fraction)).cast("double") * F.pow(F.lit(2.0), (power - (bias + fraction)).cast("double"))
    return sign * F.when(power == 2 * bias + 1, F.when(rest == 0, inf()).otherwise(nan())).when(power == 0, rest.cast("double") * least).otherwise(normal)


def exact(payload: Column, data_type: Column) -> Column:
    """Whole numbers and truth values as decimal(20,0), without rounding; null for floating types."""

    def of(bits: Column) -> Column:
        made = {name: _signed(bits, size).cast("decimal(20,0)") for name, (size, kind) in TYPES.items() if kind == "signed"}
        made["BOOL"] = (bits != 0).cast("decimal(20,0)")
        return F.when(data_type.isin(*[n for n, (_, k) in TYPES.items() if k == "unsigned"]), _unsigned(bits)).otherwise(_by_type(data_type, made))

    return _with_bits(payload, of)


def decoded(payload: Column, data_type: Column) -> Column:
    """The value of a payload of just its type's size, as the double that all arithmetic uses; truth values are 0 and 1."""

    def of(bits: Column) -> Column:
        made = {"BOOL": (bits != 0).cast("double"), "REAL": _floating(bits, 4), "LREAL": _floating(bits, 8)}
        made |= {name: _signed(bits, size).cast("double") for name, (size, kind) in TYPES.items() if kind == "signed"}
        return F.when(data_type.isin(*[n for n, (_, k) in TYPES.items() if k == "unsigned"]), _unsigned(bits).cast("double")).otherwise(_by_type(data_type, made))

    return _with_bits(payload, of)


def encoded_whole(value: Column, size: Column) -> Column:
    """The little-endian bytes of a whole number (a long), its lowest ``size`` bytes."""
    reverse = lambda d: F.concat(*[F.substring(d, 15 - 2 * i, 2) for i in range(8)])
    whole = F.element_at(F.transform(F.array(F.lpad(F.hex(value), 16, "0")), reverse), 1)
    return F.unhex(F.substring(whole, F.lit(1), 2 * size))
