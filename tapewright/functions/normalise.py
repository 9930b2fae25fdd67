"""The normalisers of the data model. They differ on purpose; none replaces another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fillers, the stop words of cohesion and the endings a stem loses.
FILLERS = ["um", "uh", "erm", "hmm", "mm", "eh", "ah"]
STOP_WORDS = (
    "the and that this with for you are was were but not have has had his her they them their our your its from what when where which who will would can could should there here then than just like about into over out all been being also because"
).split()


def trimmed(c: Column) -> Column:
    """Lower case, without what isn't a letter or digit at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def spoken(c: Column) -> Column:
    """Lower case, only letters, digits and apostrophes."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}']", "")


def key(c: Column) -> Column:
    """Lower case, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", ""), " +", " "))


def bare(c: Column) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def is_filler(word: Column) -> Column:
    return trimmed(word).isin(FILLERS)


def stem(c: Column) -> Column:
    """Without the first of the endings ing, ed, es, s that leaves three letters."""
    out = c
    for ending in ("s", "es", "ed", "ing"):
        n = len(ending)
        out = F.when(c.endswith(ending) & (F.length(c) - n >= 3), F.substr(c, F.lit(1), F.length(c) - n)).otherwise(out)
    return out


def same_word(a: Column, b: Column) -> Column:
    """Equal, of equal stems, or both of four letters or more and within a quarter of the longer one's length in edits."""
    longest = F.greatest(F.length(a), F.length(b))
    room = F.greatest(F.lit(1), F.floor(longest / 4).cast("int"))
    close = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room)
    return (a == b) | (stem(a) == stem(b)) | close
