"""Rounding and short number text, decided on the exact binary value of a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, halves the mantissa of a double


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that the expression tree does not repeat it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _halves(value: Column) -> Column:
    return _let(
        value * F.lit(_SPLITTER),
        lambda wide: _let(wide - (wide - value), lambda high: F.struct(high.alias("high"), (value - high).alias("low"))),
    )


def _rounded_product(value: Column, power: Column) -> Column:
    """Integer nearest to value * power, ties to even, without the error of the product."""

    def decide(parts: Column) -> Column:
        product, v, p = parts["product"], parts["v"], parts["p"]
        error = ((v["high"] * p["high"] - product) + v["high"] * p["low"] + v["low"] * p["high"]) + v["low"] * p["low"]
        below = F.floor(product)
        return _let(
            ((product - below) - 0.5) + error,
            lambda excess: below
            + F.when((excess > 0) | ((excess == 0) & (F.pmod(below, F.lit(2)) == 1)), 1).otherwise(0),
        )

    parts = F.struct((value * power).alias("product"), _halves(value).alias("v"), _halves(power).alias("p"))
    return _let(parts, decide).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """Round to a number of decimals; ties, judged exactly, go to the even neighbour."""
    power = F.lit(10.0**digits)

    def rounded(v: Column) -> Column:
        exact = F.abs(v) >= 2.0**52 / 10.0**digits  # no decimals left to round at this size
        return F.when(exact, v).otherwise(_rounded_product(v, power) / power)

    return _let(value.cast("double"), rounded)


def _trimmed(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(text, "\\.?0*$", "")).otherwise(text)


def _exponent(size: Column) -> Column:
    def adjust(guess: Column) -> Column:
        return (
            F.when(size >= F.pow(F.lit(10.0), guess + 1), guess + 1)
            .when(size < F.pow(F.lit(10.0), guess), guess - 1)
            .otherwise(guess)
        )

    return _let(F.floor(F.log10(size)).cast("int"), adjust)


def _notation(digits: int, scaled: Column, exponent: Column) -> Column:
    """Text of `scaled`, an integer of so many digits, whose first digit has the exponent."""

    def write(parts: Column) -> Column:
        mantissa, power = parts["mantissa"], parts["power"]
        size = F.abs(power).cast("string")
        fixed = F.when(
            power >= 0,
            F.concat(
                F.substring(mantissa, F.lit(1), power + 1),
                F.lit("."),
                F.substring(mantissa, power + 2, F.lit(digits)),
            ),
        ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), mantissa))
        scientific = F.concat(
            _trimmed(F.concat(F.substring(mantissa, 1, 1), F.lit("."), F.substring(mantissa, 2, digits))),
            F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")),
        )
        return F.when((power >= -4) & (power < digits), _let(fixed, _trimmed)).otherwise(scientific)

    carried = scaled >= 10.0**digits
    mantissa = F.when(carried, F.lit(10 ** (digits - 1))).otherwise(scaled.cast("bigint")).cast("string")
    power = F.when(carried, exponent + 1).otherwise(exponent)
    return _let(F.struct(mantissa.alias("mantissa"), power.alias("power")), write)


def format_significant(value: Column, digits: int = 3) -> Column:
    """Shortest general notation with a number of significant digits, e.g. 56.2, 1.2e+03, 0.0043."""

    def at_exponent(size: Column, exponent: Column) -> Column:
        shift = F.lit(digits - 1) - exponent
        up = F.when(shift >= 0, F.pow(F.lit(10.0), shift)).otherwise(F.lit(1.0))
        down = F.when(shift < 0, F.pow(F.lit(10.0), -shift)).otherwise(F.lit(1.0))
        scaled = _let(size / down, lambda s: _let(up, lambda u: _rounded_product(s, u)))
        return _let(scaled, lambda s: _notation(digits, s, exponent))

    def write(number: Column) -> Column:
        body = _let(F.abs(number), lambda size: _let(_exponent(size), lambda e: at_exponent(size, e)))
        return (
            F.when(number.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(number), F.lit("nan"))
            .when(F.abs(number) == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(number == 0, F.lit("0"))
            .otherwise(F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), body))
        )

    return _let(value.cast("double"), write)
