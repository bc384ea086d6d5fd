"""Exact arithmetic on fractions of 32-bit numbers, as Column expressions.

Numerators and denominators are decimals without a scale; nothing is rounded until the last step, and that step rounds once,
half to even, as IEEE division and decimal printing of the nearest double do.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.values import let

WHOLE = "decimal(38,0)"
#: Exact powers of two, which a cast of a double does not give.
_POWERS = [Decimal(2**k) for k in range(97)]


def whole(x: Column) -> Column:
    return x.cast(WHOLE)


def quotient(n: Column, d: Column) -> Column:
    """The whole part of n / d for n of 0 or more, which must fit in 64 bits."""
    return F.call_function("div", n, d)


def half_even(n: Column, d: Column) -> Column:
    """n / d to the nearest integer, half to even; n of 0 or more."""
    q = quotient(n, d)
    twice = whole((n - whole(q) * d) * 2)
    return q + F.when((twice > d) | ((twice == d) & (q % 2 == 1)), 1).otherwise(0)


def two_to(k: Column) -> Column:
    """2 to the power of k, 0 to 96."""
    return F.element_at(F.array(*[F.lit(p).cast(WHOLE) for p in _POWERS]), k + 1)


def nearest_double(n: Column, d: Column) -> Column:
    """The double nearest to n / d; n of 0 or more and d are below 2**110.

    The quotient is taken sixteen bits at a time, far enough for 54 bits that count, and a last bit tells whether anything is left;
    so the one rounding is that of the cast.
    """

    def bits(n: Column, d: Column) -> Column:
        first = whole(quotient(n, d))
        size = n.cast("double") / d.cast("double")
        steps = F.when(size >= 2.0**-10, 4).when(size >= 2.0**-58, 7).otherwise(11)

        def step(a: Column, _: Column) -> Column:
            more = whole(a["r"] * 65536)
            q = whole(quotient(more, d))
            return F.struct(whole(a["t"] * 65536 + q).alias("t"), whole(more - q * d).alias("r"))

        start = F.struct(first.alias("t"), whole(n - first * d).alias("r"))
        done = F.aggregate(F.sequence(F.lit(1), steps), start, step)
        return let(done, lambda a: whole(a["t"] * 2 + F.when(a["r"] > 0, 1).otherwise(0)).cast("double") * F.pow(F.lit(2.0), -(steps * 16 + 1).cast("double")))

    return let(F.struct(whole(n).alias("n"), whole(d).alias("d")), lambda x: F.when(x["n"] == 0, F.lit(0.0)).otherwise(bits(x["n"], x["d"])))


def binary(x: Column) -> Column:
    """struct<n, d>: the exact fraction that a double of 0 to 2**33 is; what lies below 2**-96 is cut off."""

    def parts(x: Column) -> Column:
        power = F.least(F.lit(96), F.greatest(F.lit(0), 53 - F.floor(F.log2(F.greatest(x, F.lit(2.0**-43)))).cast("int")))
        # One more than a double's 52 bits, as the logarithm may be rounded up.
        return let(power, lambda k: F.struct(whole((x * F.pow(F.lit(2.0), F.least(k, F.lit(53)).cast("double")) * F.pow(F.lit(2.0), F.greatest(k - 53, F.lit(0)).cast("double"))).cast("long")).alias("n"), two_to(k).alias("d")))

    return let(x, parts)


def fixed(x: Column, digits: int) -> Column:
    """x (0 to 2**33) times 10**digits as the nearest integer to the double's exact value, half to even."""
    return let(binary(x), lambda b: half_even(whole(b["n"] * 10**digits), b["d"]))


def shown(x: Column) -> Column:
    """A double as C's %g prints it, from its exact value: six digits that count, half to even, without trailing zeros."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        # The exponent by comparison with powers of ten; a digit more after rounding moves it by one.
        power = F.size(F.filter(F.array(*[F.lit(10.0**k) for k in range(-9, 11)]), lambda p: p <= size)) - 10
        return let(F.struct(size.alias("x"), power.alias("e")), lambda a: digits(a["x"], a["e"]))

    def digits(size: Column, e: Column) -> Column:
        b = binary(size)
        up = F.when(e < 5, F.element_at(F.array(*[F.lit(Decimal(10**k)).cast(WHOLE) for k in range(16)]), F.least(5 - e, F.lit(15)) + 1)).otherwise(whole(F.lit(1)))
        down = F.when(e > 5, F.element_at(F.array(*[F.lit(Decimal(10**k)).cast(WHOLE) for k in range(16)]), F.least(e - 5, F.lit(15)) + 1)).otherwise(whole(F.lit(1)))
        n = let(b, lambda f: half_even(whole(f["n"] * up), whole(f["d"] * down)))
        return let(n, lambda m: F.struct(F.when(m >= 1000000, F.floor(m / 10).cast("long")).otherwise(m).alias("m"), F.when(m >= 1000000, e + 1).otherwise(e).alias("e")))

    def text(m: Column, e: Column) -> Column:
        raw = F.lpad(m.cast("string"), 6, "0")
        bare = F.regexp_replace(raw, "0+$", "")
        point = lambda whole_part, rest: F.concat(whole_part, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), bare)
        plain = point(F.substr(raw, F.lit(1), e + 1), F.regexp_replace(F.substr(raw, e + 2), "0+$", ""))
        power = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        science = F.concat(point(F.substring(bare, 1, 1), F.substr(bare, F.lit(2))), power)
        return F.when(e.between(-4, -1), small).when(e.between(0, 5), plain).otherwise(science)

    return let(x, lambda v: F.when(v == 0, "0").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), let(one(v), lambda a: text(a["m"], a["e"])))))
