"""Streaming forms: sessions with late data, and the fold of edit commands with its state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.command_log import Clip, Refused, apply


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key that end after a gap; events later than the watermark are dropped. Works on streams and on tables.

    Returns key, start, end, n_events, level (mean).
    """
    s = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("level")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "level")


def windowed_levels(events: DataFrame, time: str, kind: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and means per kind in tumbling or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(kind, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("level")).select(kind, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "level")


OUT = "doc string, seq bigint, n_clips int, length bigint, refused boolean"
_STATE = "next bigint, track array<int>, asset array<string>, source_start array<bigint>, source_end array<bigint>, start array<bigint>, held array<struct<seq:bigint,kind:string,track:int,asset:string,a:bigint,b:bigint,to:bigint>>"
_FIELDS = ["seq", "kind", "track", "asset", "a", "b", "to"]


def _tracks(state: tuple | None) -> tuple[int, dict, list[dict]]:
    if state is None:
        return 0, {}, []
    tracks: dict = {}
    for t, a, s, e, at in zip(*state[1:6]):
        tracks.setdefault(int(t), []).append(Clip(a, int(s), int(e), int(at)))
    held = [dict(zip(_FIELDS, x if isinstance(x, tuple) else [x[f] for f in _FIELDS])) for x in state[6]]
    return int(state[0]), {t: tuple(c) for t, c in tracks.items()}, held


def _plain(c: dict) -> tuple:
    number = lambda x: None if x is None or x != x else int(x)
    return (int(c["seq"]), c["kind"], number(c["track"]), c["asset"], number(c["a"]), number(c["b"]), number(c["to"]))


def _packed(expected: int, tracks: dict, held: list[dict]) -> tuple:
    flat = [(t, c) for t, clips in sorted(tracks.items()) for c in clips]
    return (expected, [t for t, _ in flat], [c.asset for _, c in flat], [c.source_start for _, c in flat], [c.source_end for _, c in flat], [c.start for _, c in flat], [_plain(c) for c in held])


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    expected, tracks, held = _tracks(state.get if state.exists else None)
    waiting = {c["seq"]: c for c in held}
    for c in pd.concat(list(batches)).to_dict("records"):
        if c["seq"] >= expected:
            waiting.setdefault(int(c["seq"]), c)
    rows = []
    # a gap holds back what is behind it
    while expected in waiting:
        try:
            tracks = apply(tracks, waiting.pop(expected))
            refused = False
        except Refused:
            refused = True
        clips = [x for t in tracks.values() for x in t]
        rows.append((key[0], expected, len(clips), max((x.end for x in clips), default=0), refused))
        expected += 1
    state.update(_packed(expected, tracks, [waiting[k] for k in sorted(waiting)]))
    yield pd.DataFrame(rows, columns=["doc", "seq", "n_clips", "length", "refused"])


def live_documents(commands: DataFrame) -> DataFrame:
    """The fold of ``command_log`` over a stream: after each command the number of clips and the length of its document, and whether it was refused.

    ``seq`` counts from 0 without holes. A command that arrives before one with a lower number waits in the state until that has come; repeats
    are skipped.
    """
    return commands.groupBy("doc").applyInPandasWithState(_fold, OUT, _STATE, "append", "NoTimeout")
