"""Decimal text of any length against binary64, in whole-number arithmetic on arrays.

A number of many digits is an array of limbs to the base 10^9, the lowest first. It is multiplied by
small factors; each limb passes what exceeds the base to the next one, once per step, so limbs stay
below twice the base and products below 2^63.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BASE = 10**9
_LIMB_DIGITS = 9
# A binary64 value has at most this many digits after the point.
_MAX_FRACTION = 1074


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _limbs(m: Column, size: Column) -> Column:
    """``size`` limbs of a bigint that is not negative."""
    low, rest = m % _BASE, _div(m, _BASE)
    return F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.when(i == 0, low).when(i == 1, rest % _BASE).when(i == 2, _div(rest, _BASE)).otherwise(
            F.lit(0).cast("bigint")
        ),
    )


def _times(limbs: Column, factor: Column) -> Column:
    return F.transform(
        limbs,
        lambda limb, i: (limb * factor) % _BASE
        + F.coalesce(_div(F.get(limbs, i - 1) * factor, _BASE), F.lit(0).cast("bigint")),
    )


def _power_times(limbs: Column, base: int, unit: int, exponent: Column) -> Column:
    """``limbs`` times base^exponent, in steps of base^unit after the odd powers."""
    odd = F.get(F.array(*[F.lit(base**i).cast("bigint") for i in range(unit)]), exponent % unit)
    return F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), _div(exponent.cast("bigint"), unit)),
        limbs,
        lambda got, step: _times(got, F.when(step == 0, odd).otherwise(F.lit(base**unit).cast("bigint"))),
    )


def _digits(limbs: Column) -> Column:
    """Decimal text of ``limbs`` without zeros in front; zero is empty text."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))

    def add(state: Column, limb: Column) -> Column:
        total = limb + state["carry"]
        return F.struct(
            _div(total, _BASE).alias("carry"),
            F.concat(F.lpad((total % _BASE).cast("string"), _LIMB_DIGITS, "0"), state["text"]).alias("text"),
        )

    return F.aggregate(limbs, start, add, lambda s: F.ltrim(F.concat(s["carry"].cast("string"), s["text"]), F.lit("0")))


def _scaled_up(x: Column, k: Column) -> Column:
    """x * 2^k, exact unless it overflows; in two steps, as 2^1074 is no double."""
    half = F.floor(k / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), k - half)


def decimal_text_is_exact(text: Column) -> Column:
    """Whether decimal text (digits, at most one point, a sign) is exactly a finite binary64 value.

    With k digits after the point, zeros at the end left out, the text is N / 10^k. Let x be its
    nearest double. For k > 0 only M / 2^k with a whole M below 2^53 ends at the k-th digit, so the
    text is exact iff M = x * 2^k is such a number and M * 5^k = N. For k = 0 it is exact iff N = x,
    which is M * 2^e. The nearest double is known to be close, so the product never has two digits
    more than N. Text beyond the range of doubles is not exact.
    """
    unsigned = F.translate(text, "+-", "")
    point = F.instr(unsigned, ".")
    whole = F.substring_index(unsigned, ".", 1)
    fraction = F.when(
        point > 0, F.rtrim(F.substring(unsigned, point + 1, F.length(unsigned)), F.lit("0"))
    ).otherwise(F.lit(""))
    parts = F.struct(
        F.length(fraction).alias("k"),
        F.ltrim(F.concat(whole, fraction), F.lit("0")).alias("digits"),
        F.abs(text.try_cast("double")).alias("x"),
    )

    def test(p: Column) -> Column:
        size = _div(F.length(p["digits"]).cast("bigint"), _LIMB_DIGITS).cast("int") + 2
        scaled = _scaled_up(p["x"], p["k"])
        fractional = _let(
            scaled,
            lambda m: (m < F.lit(float(2**53)))
            & (F.rint(m) == m)
            & (_digits(_power_times(_limbs(m.try_cast("bigint"), size), 5, 12, p["k"])) == p["digits"]),
        )
        shift = F.when(
            p["x"] > 0, F.greatest(F.floor(F.log2(p["x"])) - 60, F.lit(0).cast("bigint"))
        ).otherwise(F.lit(0).cast("bigint"))
        integral = _let(
            shift,
            lambda e: _digits(
                _power_times(_limbs((p["x"] / F.pow(F.lit(2.0), e)).try_cast("bigint"), size), 2, 27, e)
            ) == p["digits"],
        )
        beyond = (p["k"] > _MAX_FRACTION) | (p["x"] == float("inf"))
        return F.when(beyond, F.lit(False)).when(p["k"] > 0, fractional).otherwise(integral)

    return F.coalesce(_let(parts, test), F.lit(False))
