"""Frame and sample grids, frame rates and timecode, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.exact_time import floor_div, int_div

# The standard frame rates, numerator and denominator.
STANDARD_RATES = [(24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1)]
_WIDE = "decimal(38,0)"


def _product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(_WIDE)


def _floor_ratio(a: Column, b: Column) -> Column:
    """floor(a / b) of DECIMAL(38,0) columns, b positive."""
    q = int_div(a, b)
    return F.when((a < 0) & (q * b != a), q - 1).otherwise(q)


def floor_seconds(num: Column, den: Column) -> Column:
    return floor_div(num, den)


def ceil_seconds(num: Column, den: Column) -> Column:
    return -floor_div(-num, den)


def rounded_seconds(num: Column, den: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    up = floor_div(2 * F.abs(num) + den, 2 * den)
    return F.when(num < 0, -up).otherwise(up)


def frame_at(num: Column, den: Column, fps_num: Column, fps_den: Column) -> Column:
    """The frame that holds the instant: floor(t * fps)."""
    return _floor_ratio(_product(num, fps_num), _product(den, fps_den)).cast("bigint")


def nearest_frame(num: Column, den: Column, fps_num: Column, fps_den: Column) -> Column:
    a, b = _product(num, fps_num), _product(den, fps_den)
    up = int_div((2 * F.abs(a) + b).cast(_WIDE), (2 * b).cast(_WIDE))
    return F.when(a < 0, -up).otherwise(up).cast("bigint")


def is_frame_aligned(num: Column, den: Column, fps_num: Column, fps_den: Column) -> Column:
    return _product(num, fps_num) % _product(den, fps_den) == 0


def sample_index(num: Column, den: Column, hertz: int) -> Column:
    return frame_at(num, den, F.lit(hertz).cast("bigint"), F.lit(1).cast("bigint"))


def nearest_sample(num: Column, den: Column, hertz: int) -> Column:
    return nearest_frame(num, den, F.lit(hertz).cast("bigint"), F.lit(1).cast("bigint"))


def nearest_standard_rate(measured: Column, tolerance: float = 0.02) -> Column:
    """The standard rate with the least relative error, as (num, den), or NULL beyond the tolerance; the first of equals."""
    options = F.array(
        *[F.struct((F.abs(measured - n / d) / (n / d)).alias("error"), F.lit(i).alias("ord"), F.lit(n).alias("num"), F.lit(d).alias("den")) for i, (n, d) in enumerate(STANDARD_RATES)]
    )
    best = F.array_min(options)
    return F.when(best["error"] <= tolerance, F.struct(best["num"].alias("num"), best["den"].alias("den")))


def timecode(frame: Column, nominal: int, drop: bool) -> Column:
    """hh:mm:ss:ff, or with ";" and dropped numbers: 2 (at 60: 4) in each minute but every tenth."""
    f = frame.cast("bigint")
    if drop:
        skip = 2 * nominal // 30
        per_ten, per_minute = nominal * 600 - 9 * skip, nominal * 60 - skip
        tens, rest = int_div(f, F.lit(per_ten)), f % per_ten
        f = f + skip * 9 * tens + F.when(rest >= skip, skip * int_div(rest - skip, F.lit(per_minute))).otherwise(0)
    part = lambda c, size: F.lpad(c.cast("string"), size, "0")
    s = int_div(f, F.lit(nominal))
    ff = f % nominal
    return F.concat_ws(":", part(int_div(s, F.lit(3600)), 2), part(int_div(s, F.lit(60)) % 60, 2), F.concat(part(s % 60, 2), F.lit(";" if drop else ":"), part(ff, 2)))


def frame_of_timecode(text: Column, nominal: int, drop: bool) -> Column:
    """The frame number, or NULL for a malformed timecode, parts out of range and numbers that are dropped."""
    p = F.regexp_extract_all(text, F.lit(r"^(\d{1,3})[:;](\d{2})[:;](\d{2})[:;](\d{2})$"), F.lit(0))
    parts = F.split(F.try_element_at(p, F.lit(1)), "[:;]")
    h, m, s, f = (F.try_element_at(parts, F.lit(i)).cast("bigint") for i in (1, 2, 3, 4))
    ok = (F.size(p) == 1) & (m < 60) & (s < 60) & (f < nominal)
    total = ((h * 60 + m) * 60 + s) * nominal + f
    if drop:
        skip = 2 * nominal // 30
        minutes = h * 60 + m
        total = total - skip * (minutes - int_div(minutes, F.lit(10)))
        ok = ok & ~((s == 0) & (f < skip) & (m % 10 != 0))
    return F.when(ok, total)
