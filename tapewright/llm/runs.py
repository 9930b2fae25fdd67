"""Collapsing runs of frames that show the same.

Frames are cut into chunks of time per recording, sorted, and each chunk encodes its runs locally. A chunk
also holds the frames of the last seconds before it, so that its first frame knows whether it goes on
with the chunk before. A run is summed up by its first and last frame and its count; the summary
is associative, so the runs that touch a chunk's edge are joined afterwards by a two-level prefix sum over
those summaries alone. No task holds more of a recording than a chunk, or one row per edge run.

Whether two frames show the same is decided by built-in functions wherever it can be (different numbers of
lines or faces, lines equal after normalising); only the rest goes to Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import exact_time as X
from tapewright.operators.blocked import running_sum
from tapewright.session import cut_lineage

MIN_CONFIDENCE = 0.3
MAX_GAP_SECONDS = 3
MAX_EDITS = 2
LONG_WORD = 5
FACE_SHIFT = 0.1
CHUNK_SECONDS = 256


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, or limit + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@lru_cache(maxsize=65536)
def same_line(a: str, b: str) -> bool:
    """Two normalised lines that are readings of one line: equal words in any order but for at most MAX_EDITS
    characters, all in words of LONG_WORD or more characters, and no difference in numbers. Two words a letter short of
    that count where each can be such a word with another letter missing."""
    if a == b:
        return True
    wa, wb = a.split(), b.split()
    if len(wa) != len(wb):
        return False
    rest_b = list(wb)
    rest_a = []
    for w in wa:
        if w in rest_b:
            rest_b.remove(w)
        else:
            rest_a.append(w)
    if not rest_a:
        return True
    if len(rest_a) > MAX_EDITS:
        return False

    def edits(w: str, v: str, budget: int) -> int:
        if w.isdigit() or v.isdigit():
            return budget + 1
        if max(len(w), len(v)) >= LONG_WORD:
            return edit_distance(w, v, budget)
        # two readings that each miss another letter of a word that is just long enough
        short = LONG_WORD - 1
        return 2 if len(w) == len(v) == short and common_letters(w, v) >= short - 1 else budget + 1

    def pairs(k: int, left: list[str], budget: int) -> bool:
        if k == len(rest_a):
            return True
        w = rest_a[k]
        for i, v in enumerate(left):
            d = edits(w, v, budget)
            if d <= budget and pairs(k + 1, left[:i] + left[i + 1 :], budget - d):
                return True
        return False

    return pairs(0, rest_b, MAX_EDITS)


def matched(n: int, fits) -> bool:
    """Whether n things on one side can be paired one to one with n on the other (augmenting paths)."""
    owner = [-1] * n

    def place(i: int, seen: list[bool]) -> bool:
        for j in range(n):
            if not seen[j] and fits(i, j):
                seen[j] = True
                if owner[j] < 0 or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, [False] * n) for i in range(n))


def same_lines(a: list[str], b: list[str]) -> bool:
    if len(a) != len(b):
        return False
    if len(a) == 1:
        return same_line(a[0], b[0])
    return matched(len(a), lambda i, j: same_line(a[i], b[j]))


def same_faces(a: np.ndarray, b: np.ndarray) -> bool:
    """Flat x, y, width triples of two frames; a is the earlier."""
    if len(a) != len(b):
        return False
    a, b = a.reshape(-1, 3), b.reshape(-1, 3)
    return matched(len(a), lambda i, j: bool((np.abs(a[i] - b[j]) <= FACE_SHIFT * a[i, 2]).all()))


@F.pandas_udf(T.BooleanType())
def _same_by_python(lines_a: pd.Series, lines_b: pd.Series, faces_a: pd.Series, faces_b: pd.Series) -> pd.Series:
    """NULL lines or faces were decided before and count as alike."""
    out = np.ones(len(lines_a), bool)
    for k, (p, q, f, g) in enumerate(zip(lines_a, lines_b, faces_a, faces_b)):
        if p is not None and not same_lines(p.split("\n"), q.split("\n")):
            out[k] = False
        elif f is not None and not same_faces(np.asarray(f), np.asarray(g)):
            out[k] = False
    return pd.Series(out)


def _counts(box: Column) -> Column:
    return F.coalesce(box["confidence"] >= MIN_CONFIDENCE, F.lit(True))


def shown_lines(text: Column) -> Column:
    """Sorted lines that count, in lower case, without punctuation and with single spaces."""
    kept = F.filter(text, lambda t: t["text"].isNotNull() & _counts(t["box"]))
    plain = F.transform(kept, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t["text"]), r"[^\p{L}\p{M}\p{N}\s]", ""), r"\s+", " ")))
    return F.sort_array(plain)


def shown_faces(faces: Column) -> Column:
    """x, y, width of the faces that count, sorted by x."""
    kept = F.filter(faces, lambda f: f.isNotNull() & _counts(f))
    return F.sort_array(F.transform(kept, lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["width"].alias("w"))))


def _near(a: Column, b: Column) -> Column:
    room = a["w"] * FACE_SHIFT
    return (F.abs(a["x"] - b["x"]) <= room) & (F.abs(a["y"] - b["y"]) <= room) & (F.abs(a["w"] - b["w"]) <= room)


def collapse_runs(
    frames: DataFrame,
    frame_id: str = "frame_id",
    entity: str = "asset",
    time: tuple[str, str] = ("time_num", "time_den"),
    text: str = "text",
    faces: str = "faces",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """One row per longest stretch of consecutive frames of a recording that show the same.

    Frames with a NULL id, entity, time, text or faces are left out beforehand, repeats of an id but one.
    Each frame is compared with the frame directly before it, which may be at most MAX_GAP_SECONDS earlier.
    Lines and boxes without a confidence count; lines without text don't. Frames at the same time are
    ordered by id. A frame alike to no neighbour is a stretch of one. An empty table gives none; other
    columns are ignored, whatever their names.

    Returns ``entity``, first_frame_id, last_frame_id, n_frames and duration_us (rounded down).
    """
    width = F.lit(chunk_seconds * X.TICKS).cast("bigint")
    reach = F.lit(MAX_GAP_SECONDS * X.TICKS).cast("bigint")
    f = frames.where(F.col(frame_id).isNotNull() & F.col(entity).isNotNull() & F.col(text).isNotNull() & F.col(faces).isNotNull())
    f = f.select(
        F.col(entity).alias("e"),
        F.col(frame_id).alias("id"),
        X.tick(*time).alias("t"),
        X.sub_tick(*time).alias("s"),
        shown_lines(F.col(text)).alias("lines"),
        shown_faces(F.col(faces)).alias("faces"),
    ).where("t IS NOT NULL")
    own = X.floor_div(F.col("t"), width)
    # the frames of the last seconds of a chunk are also seen by the next
    f = f.withColumn("own", own).withColumn("chunk", F.explode(F.sequence("own", X.floor_div(F.col("t") + reach, width))))
    f = f.withColumn("halo", F.col("own") < F.col("chunk")).drop("own").repartition("e", "chunk")

    in_time = Window.partitionBy("e", "chunk").orderBy("t", "s", "id")
    f = f.withColumn("again", F.lag("id").over(in_time)).where("again IS NULL OR again <> id").drop("again")
    back = F.lag(F.struct("t", "s", "lines", "faces")).over(in_time)
    f = f.withColumn("p", back)
    p = F.col("p")
    soon = p.isNotNull() & X.not_after(F.col("t"), F.col("s"), p["t"] + reach, p["s"])
    possible = soon & (F.size(p["lines"]) == F.size("lines")) & (F.size(p["faces"]) == F.size("faces"))
    equal_lines = p["lines"] == F.col("lines")
    near_faces = F.forall(F.zip_with(p["faces"], "faces", _near), lambda x: x)
    hopeless = (F.size("faces") == 1) & ~near_faces
    ask_lines, ask_faces = possible & ~hopeless & ~equal_lines, possible & ~hopeless & ~near_faces
    joined = lambda c: F.array_join(c, "\n")
    flat = lambda c: F.flatten(F.transform(c, lambda x: F.array(x["x"], x["y"], x["w"])))
    f = f.select(
        "e",
        "chunk",
        "id",
        "t",
        "s",
        "halo",
        F.coalesce(possible & ~hopeless, F.lit(False)).alias("possible"),
        F.when(ask_lines, joined(p["lines"])).alias("la"),
        F.when(ask_lines, joined(F.col("lines"))).alias("lb"),
        F.when(ask_faces, flat(p["faces"])).alias("fa"),
        F.when(ask_faces, flat(F.col("faces"))).alias("fb"),
    )
    f = f.withColumn("same", F.col("possible") & _same_by_python("la", "lb", "fa", "fb")).where("NOT halo").drop("la", "lb", "fa", "fb", "possible", "halo")

    f = f.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("t", "s", "id")
    local = f.groupBy("e", "chunk", "run").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("n"))
    of_chunk = Window.partitionBy("e", "chunk")
    local = local.withColumn("last", F.col("run") == F.max("run").over(of_chunk))
    local = cut_lineage(local)

    # run 0 goes on from the chunk before; the first run may be numbered 0 or 1
    inner = local.where("run > 1 AND NOT last").select("e", "a", "z", "n")
    edges = local.where("run <= 1 OR last").withColumn("fresh", F.when(F.col("run") == 0, 0).otherwise(1))
    edges = running_sum(edges, ["e"], "chunk", ["run"], "fresh", "whole")
    merged = edges.groupBy("e", "whole").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n")).drop("whole")
    runs = inner.unionByName(merged)
    span = (F.col("z.t") - F.col("a.t")) - F.when(F.col("z.s") < F.col("a.s"), 1).otherwise(0)
    return runs.select(
        F.col("e").alias(entity),
        F.col("a.id").alias("first_frame_id"),
        F.col("z.id").alias("last_frame_id"),
        F.col("n").alias("n_frames"),
        X.floor_div(span * 10, F.lit(X.TICKS // 10**5).cast("bigint")).alias("duration_us"),
    )
