"""Levels, pitch, contrast, boxes and framing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibels(rms: Column, silence: float = 0.0) -> Column:
    """20 log10 of a root mean square, -120 for silence."""
    return F.when(rms > silence, 20 * F.log10(rms)).otherwise(F.lit(-120.0))


def semitones(a: Column, b: Column) -> Column:
    """|12 log2(b / a)|, NULL if either is missing or not positive."""
    return F.when((a > 0) & (b > 0), F.abs(12 * F.log2(b / a)))


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """Of sRGB channels in 0..1."""
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def contrast_ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def box_area(box: Column) -> Column:
    return box["width"] * box["height"]


def boxes_intersect(a: Column, b: Column) -> Column:
    """Strictly: boxes that only touch don't."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def parse_aspect(text: Column) -> Column:
    """"16:9" as a ratio; NULL for "original", "source" and whatever isn't two positive numbers."""
    parts = F.split(F.trim(text), ":")
    a, b = (F.element_at(parts, i).try_cast("double") for i in (1, -1))
    return F.when((F.size(parts) == 2) & (a > 0) & (b > 0), a / b)


def even(c: Column) -> Column:
    """The even number at or below."""
    return (F.floor(c / 2) * 2).cast("bigint")


def crop_plan(width: Column, height: Column, aspect: Column, subject_x: Column, subject_y: Column) -> Column:
    """(x, y, width, height) of the largest even crop of the aspect, centred on the subject and clamped to the picture.

    ``subject_x`` and ``subject_y`` are shares of the picture; NULL is the middle.
    """
    w, h = width.cast("double"), height.cast("double")
    wide = w / h > aspect
    cw = even(F.when(wide, h * aspect).otherwise(w))
    ch = even(F.when(wide, h).otherwise(w / aspect))
    at = lambda s, full, part: F.least(F.greatest(F.coalesce(s, F.lit(0.5)) * full - part / 2, F.lit(0.0)), full - part)
    return F.struct(F.floor(at(subject_x, w, cw)).cast("bigint").alias("x"), F.floor(at(subject_y, h, ch)).cast("bigint").alias("y"), cw.alias("width"), ch.alias("height"))


def band_placement(panel: Column, panels: Column, width: Column, height: Column, out_width: Column, out_height: Column, subject_y: Column) -> Column:
    """(scale, offset_y, band_top) that fills a horizontal band with a picture, in units of 1/100000, clamped so that no edge shows."""
    band = out_height / panels
    scale = F.greatest(out_width / width, band / height)
    room = height * scale - band
    offset = F.least(F.greatest(F.coalesce(subject_y, F.lit(0.5)) * height * scale - band / 2, F.lit(0.0)), room)
    q = lambda c: (F.round(c * 100000) / 100000)
    return F.struct(q(scale).alias("scale"), q(offset).alias("offset_y"), q(panel * band).alias("band_top"))
