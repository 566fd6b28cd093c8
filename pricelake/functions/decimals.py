"""Exact fixed-point arithmetic on DECIMAL(38,0) columns.

`-x` and `abs(x)` round large decimals in Spark, so sign changes go through
`0 - x`; anything that may pass 38 digits uses the `try_` functions and yields
null, which callers send to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"
_ORDER_BASE = "10000000000000000000"


def magnitude(value: Column) -> Column:
    """Absolute value without losing digits."""
    return F.when(value < 0, F.lit(0).cast(WIDE) - value).otherwise(value)


def pow10(exponent: Column) -> Column:
    """10^exponent as an exact decimal; null above 10^37."""
    return F.when(
        (exponent >= 0) & (exponent <= 37),
        F.concat(F.lit("1"), F.repeat(F.lit("0"), exponent.cast("int"))),
    ).cast(WIDE)


def whole_div(dividend: Column, divisor: Column) -> Column:
    """Quotient truncated toward zero; null for divisor 0 or over 32 digits."""
    exact = dividend - F.try_mod(dividend, divisor)
    return F.try_divide(exact, divisor).cast(WIDE)


# Fixed value: the number texts that feeds send.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,4})?$"


def bind(value: Column, body) -> Column:
    """body(value) with `value` evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shift_point(raw: Column, decimals: Column) -> Column:
    """round_half_away(raw * 10^decimals) computed on the digits of the text.

    Working on the text keeps every digit whatever the scale; null means that
    the value is not a number or needs more than 38 digits.
    """

    def shifted(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        integer = (
            F.when(point <= 0, F.lit("0"))
            .when(point >= F.length(digits), F.rpad(digits, F.least(point, F.lit(400)), F.lit("0")))
            .otherwise(F.substring(digits, F.lit(1), point))
        )
        round_up = (point >= 0) & (F.substring(digits, point + 1, F.lit(1)) >= "5")
        size = F.try_add(integer.try_cast(WIDE), F.when(round_up, 1).otherwise(0).cast(WIDE))
        return F.when(p["negative"], F.lit(0).cast(WIDE) - size).otherwise(size)

    def split(text: Column) -> Column:
        negative = text.startswith("-")
        body = F.lower(F.when(negative | text.startswith("+"), F.substring(text, F.lit(2), F.length(text))).otherwise(text))
        mantissa = F.substring_index(body, "e", 1)
        power = F.when(F.instr(body, "e") > 0, F.substring_index(body, "e", -1).cast("int")).otherwise(0)
        dot = F.instr(mantissa, ".")
        whole = F.when(dot > 0, dot - 1).otherwise(F.length(mantissa))
        place = F.struct(
            negative.alias("negative"), F.translate(mantissa, ".", "").alias("digits"),
            (whole + power + decimals.cast("int")).alias("point"))
        return F.when(text.rlike(NUMBER), bind(place, shifted))

    return bind(F.trim(raw.cast("string")), split)


def rescale(price: Column, have: Column, want: Column) -> Column:
    """Move a fixed-point price from `have` to `want` decimals.

    Scaling down rounds half away from zero; null when 38 digits do not suffice.
    """
    gap = want.cast("int") - have.cast("int")
    up = F.try_multiply(price, pow10(F.greatest(gap, F.lit(0)))).cast(WIDE)
    unit = pow10(F.greatest(F.lit(0) - gap, F.lit(0)))
    half = whole_div(unit, F.lit(2).cast(WIDE))
    size = whole_div(F.try_add(magnitude(price), half).cast(WIDE), unit)
    down = F.when(price < 0, F.lit(0).cast(WIDE) - size).otherwise(size)
    return F.when(gap == 0, price).when(gap > 0, up).otherwise(down)


def as_float(price: Column, decimals: Column) -> Column:
    """price / 10^decimals as a double."""
    return price.cast("double") / F.pow(F.lit(10.0), decimals.cast("double"))


def deviation_pct(price: Column, median: Column) -> Column:
    """abs(price - median) / median * 100, and 0 for median 0."""
    gap = F.abs(price.cast("double") - median.cast("double"))
    return F.when(median.cast("double") == 0, F.lit(0.0)).otherwise(gap / median.cast("double") * 100)


def deviation_bps(new: Column, previous: Column) -> Column:
    """Integer basis points between two prices, sign-aware.

    Null for previous 0 (no deviation is defined) and for values that would
    need more than 38 digits; `deviation_exceeds` tells the two apart.
    """
    gap = magnitude(F.try_subtract(new, previous).cast(WIDE))
    scaled = F.try_multiply(gap, F.lit(10000).cast("decimal(5,0)")).cast(WIDE)
    return F.when(previous != 0, whole_div(scaled, magnitude(previous)))


def deviation_exceeds(new: Column, previous: Column, threshold_bps: int) -> Column:
    """Whether the move from `previous` to `new` is above the threshold.

    A previous price of 0 never exceeds. Null means: outside 38 digits.
    """
    return F.when(previous == 0, F.lit(False)).otherwise(deviation_bps(new, previous) > threshold_bps)


def order_key(timestamp: Column, seq: Column) -> Column:
    """(timestamp, seq) packed in one decimal.

    `max_by` over fixed-width columns stays a hash aggregation; ordering by a
    struct would make Spark sort every input row first.
    """
    return timestamp.cast("decimal(18,0)") * F.lit(_ORDER_BASE).cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def middle_of(values: Column) -> Column:
    """Exact median of a small array of DECIMAL(38,0), with one fraction digit."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        high = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
        return F.when(n > 0, midpoint(low, high))

    return bind(F.array_sort(values), middle)


def midpoint(low: Column, high: Column) -> Column:
    """(low + high) / 2 with one exact fraction digit; null from 10^37 on."""
    total = low.try_cast("decimal(37,0)") + high.try_cast("decimal(37,0)")
    return (total * F.lit("0.5").cast("decimal(1,1)")).try_cast("decimal(38,1)")


# -- the same on plain integers, inside folds ---------------------------------

WIDEST = 10**38


def rescaled(price: int, have: int, want: int) -> int | None:
    """`rescale` of one price; None beyond 38 digits."""
    if want >= have:
        out = price * 10 ** (want - have)
    else:
        unit = 10 ** (have - want)
        out = (abs(price) + unit // 2) // unit * (-1 if price < 0 else 1)
    return out if abs(out) < WIDEST else None


def middle(ordered: list[int]) -> str | None:
    """`middle_of` sorted values as text; None without values or from 10^37 on."""
    if not ordered:
        return None
    low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
    if max(abs(low), abs(high)) >= WIDEST // 10:
        return None
    tenths = (low + high) * 5
    return f"{'-' if tenths < 0 else ''}{abs(tenths) // 10}.{abs(tenths) % 10}"
