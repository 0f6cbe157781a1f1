"""Column functions: addresses, hexadecimal fields, amounts, weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "^0x[0-9a-f]{40}$"
EXACT_DOUBLE = 1 << 53
#: Added and taken away again, they round a double to multiples of 2^-8 and 2^-40.
GRIDS = (1.5 * 2.0**44, 1.5 * 2.0**12)


def normalised_address(c: Column) -> Column:
    """Lower case; anything but 0x and 40 hexadecimal digits is an error, null stays null."""
    low = F.lower(c)
    return F.when(low.rlike(ADDRESS) | low.isNull(), low).otherwise(F.raise_error(F.concat(F.lit("malformed address: "), c)))


def hex_long(c: Column) -> Column:
    """A 0x-prefixed hexadecimal number as long; over 63 bits is an error."""
    digits = F.regexp_replace(F.lower(c), "^0x0*", "")
    fits = F.length(digits) < 16
    fits = fits | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"))
    return F.when(fits | c.isNull(), F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("long")).otherwise(F.raise_error(F.concat(F.lit("number over 63 bits: "), c)))


def hex_decimal(c: Column) -> Column:
    """A 0x-prefixed hexadecimal number of up to 112 bits as decimal(38, 0); more is an error."""
    digits = F.regexp_replace(F.lower(c), "^0x0*", "")
    padded = F.lpad(digits, 28, "0")
    limb = lambda at: F.conv(F.substring(padded, at, 14), 16, 10).cast("decimal(20,0)")
    value = (limb(1) * F.lit(1 << 56).cast("decimal(18,0)")).cast("decimal(38,0)") + limb(15)
    return F.when((F.length(digits) <= 28) | c.isNull(), value.cast("decimal(38,0)")).otherwise(F.raise_error(F.concat(F.lit("number over 112 bits: "), c)))


def topic_address(c: Column) -> Column:
    """The address in the low 20 bytes of a 32-byte topic."""
    return F.lower(F.concat(F.lit("0x"), F.right(c, F.lit(40))))


def units(raw: Column, decimals: int = 6) -> Column:
    """Base units as amount; a double divides exactly rounded below 2^53, a decimal beyond."""
    wide = (raw.cast("decimal(38,0)").cast("decimal(38,6)") / F.lit(10**decimals).cast("decimal(18,0)")).cast("double")
    return F.when(F.abs(raw) < EXACT_DOUBLE, raw.cast("double") / F.lit(float(10**decimals))).otherwise(wide)


def day(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def week(c: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.date_trunc("week", c).cast("timestamp_ntz")


def weeks_between(start: Column, end: Column) -> Column:
    """Whole weeks between two week starts."""
    return (F.datediff(end, start) / 7).cast("long")


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def steady_sum(c: Column) -> Column:
    """The sum of doubles, the same in whatever order rows come: equal sets of amounts tie exactly.

    Each value is split into a multiple of 2^-8, one of 2^-40 and a rest.  Sums of the first two are exact while they
    stay below 2^45 and 2^13; what the rest adds is below the last bit of the result.  Beyond, and for values that are
    not finite, it is a plain sum.
    """
    x = c.cast("double")
    parts = []
    for grid in GRIDS:
        parts.append((x + F.lit(grid)) - F.lit(grid))
        x = F.nanvl(x - parts[-1], F.lit(0.0))
    return F.sum(parts[0]) + (F.sum(parts[1]) + F.sum(x))


def significant(value: float, digits: int = 10) -> float:
    return float(f"{value:.{digits}g}")
