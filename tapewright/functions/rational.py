"""Fractions as (num, den) structs of BIGINT in lowest terms with a positive denominator, as columns.

Products are taken in DECIMAL(38,0), which holds those of any two BIGINTs; a result that doesn't fit a BIGINT raises, as exact
arithmetic must not round. A NULL or zero denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.exact_time import int_div, signed

_WIDE = "decimal(38,0)"
_D = "decimal(19,0)"


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of non-negative columns of one integer or decimal type; Euclid's steps as a fold (93 suffice for BIGINT, 190 for 38 digits)."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(_WIDE).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(190)), F.struct(a.cast(_WIDE).alias("a"), b.cast(_WIDE).alias("b")), step)["a"]


def _reduced(n: Column, d: Column) -> Column:
    """n and d: DECIMAL(38,0), d positive."""
    g = gcd(F.abs(n), d)
    return F.when(d > 0, F.struct(int_div(n, g).cast("bigint").alias("num"), int_div(d, g).cast("bigint").alias("den")))


def rational(num: Column | str, den: Column | str) -> Column:
    n, d = signed(num, den)
    return _reduced(n.cast(_WIDE), d.cast(_WIDE))


def _p(a: Column, b: Column) -> Column:
    return (a.cast(_D) * b.cast(_D)).cast(_WIDE)


def add(a: Column, b: Column) -> Column:
    return _reduced((_p(a["num"], b["den"]) + _p(b["num"], a["den"])).cast(_WIDE), _p(a["den"], b["den"]))


def subtract(a: Column, b: Column) -> Column:
    return _reduced((_p(a["num"], b["den"]) - _p(b["num"], a["den"])).cast(_WIDE), _p(a["den"], b["den"]))


def multiply(a: Column, b: Column) -> Column:
    return _reduced(_p(a["num"], b["num"]), _p(a["den"], b["den"]))


def divide(a: Column, b: Column) -> Column:
    """NULL where b is 0."""
    n, d = _p(a["num"], b["den"]), _p(a["den"], b["num"])
    return F.when(b["num"] != 0, _reduced(F.when(d < 0, -n).otherwise(n).cast(_WIDE), F.abs(d).cast(_WIDE)))


def less(a: Column, b: Column) -> Column:
    return _p(a["num"], b["den"]) < _p(b["num"], a["den"])


def canonical_json(seconds: Column) -> Column:
    """The canonical form of a time: keys in order, lowest terms."""
    return F.to_json(F.struct(F.struct(seconds["den"].alias("den"), seconds["num"].alias("num")).alias("seconds")))
