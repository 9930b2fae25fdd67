"""Exact rational seconds as integer columns.

A time is ``num / den`` seconds. Two integer forms are derived from it, both order preserving:

* ``(tick, sub)``: ``tick`` is the whole number of 1/705 600 000 s, ``sub`` the rest of the tick in
  billionths of a tick. Two different times with denominators up to 8*10^8 never share a pair, so
  comparing pairs compares the rationals. All arithmetic is BIGINT for denominators up to 10^9;
  beyond that DECIMAL(38,0) takes over.
* ``fine``: whole seconds and the rest in units of 10^-16 s, which tells apart times with
  denominators up to 10^8.

A NULL or zero denominator, and a time beyond 1.3*10^10 s, give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 705_600_000
SUBS = 10**9
FINE = 10**16
_BIG = "decimal(38,0)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down (``div`` alone rounds towards zero)."""
    return F.call_function("div", a - F.pmod(a, b), b)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def signed(num: Column | str, den: Column | str) -> tuple[Column, Column]:
    """Numerator and denominator with the denominator positive; both NULL where it is NULL or zero."""
    n, d = col(num).cast("bigint"), col(den).cast("bigint")
    ok = n.isNotNull() & d.isNotNull() & (d != 0)
    return F.when(ok, F.when(d < 0, -n).otherwise(n)), F.when(ok, F.abs(d))


def _scaled(rest: Column, den: Column, unit: int) -> tuple[Column, Column]:
    """Floor and remainder of ``rest * unit / den`` for ``0 <= rest < den``."""
    limit = (2**63 - 1) // unit
    small = den <= limit
    whole = F.when(small, int_div(rest * F.lit(unit), den)).otherwise(int_div(rest.cast(_BIG) * F.lit(unit), den.cast(_BIG)).cast("bigint"))
    left = F.when(small, F.pmod(rest * F.lit(unit), den)).otherwise(
        (rest.cast(_BIG) * F.lit(unit) - int_div(rest.cast(_BIG) * F.lit(unit), den.cast(_BIG)).cast(_BIG) * den.cast(_BIG)).cast("bigint")
    )
    return whole, left


def tick(num: Column | str, den: Column | str) -> Column:
    """Whole ticks, rounded down."""
    n, d = signed(num, den)
    whole, _ = _scaled(F.pmod(n, d), d, TICKS)
    return F.try_add(F.try_multiply(floor_div(n, d), F.lit(TICKS).cast("bigint")), whole)


def sub_tick(num: Column | str, den: Column | str) -> Column:
    """The rest of the tick, in billionths of a tick, rounded down."""
    n, d = signed(num, den)
    _, left = _scaled(F.pmod(n, d), d, TICKS)
    part, _ = _scaled(left, d, SUBS)
    return part


def whole_seconds(num: Column | str, den: Column | str) -> Column:
    n, d = signed(num, den)
    return floor_div(n, d)


def fine_rest(num: Column | str, den: Column | str) -> Column:
    """What is left beside the whole seconds, in 10^-16 s, rounded down."""
    n, d = signed(num, den)
    rest = F.pmod(n, d)
    small = d <= (2**63 - 1) // 10**8
    high = F.when(small, int_div(rest * F.lit(10**8), d))
    left = F.when(small, F.pmod(rest * F.lit(10**8), d))
    low = F.when(small & (d <= (2**63 - 1) // 10**8), int_div(left * F.lit(10**8), d))
    exact = int_div(rest.cast(_BIG) * F.lit(FINE).cast("decimal(18,0)"), d.cast(_BIG)).cast("bigint")
    return F.when(small, high * F.lit(10**8) + low).otherwise(exact)


def micro_rest(num: Column | str, den: Column | str) -> Column:
    """What is left beside the whole seconds, in microseconds, rounded down: ``fine_rest`` over 10^10, in BIGINT for denominators up to 9*10^12."""
    n, d = signed(num, den)
    return _scaled(F.pmod(n, d), d, 10**6)[0]


def is_exact_tick(num: Column | str, den: Column | str) -> Column:
    n, d = signed(num, den)
    _, left = _scaled(F.pmod(n, d), d, TICKS)
    return left == 0


def not_after(tick_a: Column, sub_a: Column, tick_b: Column, sub_b: Column) -> Column:
    """a <= b for two (tick, sub) pairs."""
    return (tick_a < tick_b) | ((tick_a == tick_b) & (sub_a <= sub_b))


def distance_key(num_a: Column, den_a: Column, num_b: Column, den_b: Column) -> Column:
    """|a - b| * den_b as (whole, rest in 10^-18): orders exactly the distances of several a from one b.

    For positive denominators up to 10^9; |a - b| may be up to 10^9 s.
    """
    gap = F.abs(num_a.cast("decimal(19,0)") * den_b.cast("decimal(19,0)") - num_b.cast("decimal(19,0)") * den_a.cast("decimal(19,0)")).cast(_BIG)
    whole = int_div(gap, den_a.cast(_BIG)).cast("bigint")
    rest = gap - whole.cast("decimal(19,0)") * den_a.cast("decimal(19,0)")
    part = int_div(rest.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)"), den_a.cast(_BIG)).cast("bigint")
    return F.struct(whole.alias("whole"), part.alias("part"))


def within(num_a: Column, den_a: Column, num_b: Column, den_b: Column, tol_num: int, tol_den: int) -> Column:
    """|a - b| <= tol_num / tol_den, exactly."""
    gap = F.abs(num_a.cast("decimal(19,0)") * den_b.cast("decimal(19,0)") - num_b.cast("decimal(19,0)") * den_a.cast("decimal(19,0)")).cast(_BIG)
    room = (den_a.cast("decimal(19,0)") * den_b.cast("decimal(19,0)")).cast(_BIG)
    return gap * F.lit(tol_den).cast("decimal(9,0)") <= room * F.lit(tol_num).cast("decimal(9,0)")
