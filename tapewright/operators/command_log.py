"""The append-only log of edit commands and its fold, per document.

A command is (doc, seq, kind, track, clip fields). Kinds: addAsset (asset, b: its duration), addTrack (asset: 'video' or 'audio'), place (asset, source a to b,
at to), ripple (a to b), move (a to b, to), placeInFrame (a: number of the clip, placement), recordDecision. Those that edit carry a decision's
confidence. The fold is a pure function of a document's commands in order; undo is the fold of a shorter prefix.
It runs per document, whose log is as long as its editing session; everything on whole tables uses the set forms of ``timeline``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc string, track int, clip int, asset string, source_start bigint, source_end bigint, start bigint"
#: Fixed value: decisions below this confidence are refused.
CONFIDENCE_FLOOR = 0.7


@dataclass(frozen=True)
class Clip:
    asset: str
    source_start: int
    source_end: int
    start: int
    placement: str | None = None

    @property
    def end(self) -> int:
        return self.start + self.source_end - self.source_start

    def part(self, a: int, b: int) -> Clip:
        return replace(self, source_start=self.source_start + a - self.start, source_end=self.source_start + b - self.start, start=a)

    def shifted(self, by: int) -> Clip:
        return replace(self, start=self.start + by)


Tracks = dict[int, tuple[Clip, ...]]


class Refused(ValueError):
    """A command that can't be applied."""


def place(tracks: Tracks, track: int, clip: Clip) -> Tracks:
    if clip.source_end <= clip.source_start:
        raise Refused("empty clip")
    if any(c.start < clip.end and clip.start < c.end for c in tracks.get(track, ())):
        raise Refused("overlaps a clip")
    return {**tracks, track: tuple(sorted((*tracks.get(track, ()), clip), key=lambda c: c.start))}


def _split(clips: tuple[Clip, ...], *at: int) -> list[Clip]:
    out: list[Clip] = []
    for c in clips:
        edges = sorted({c.start, c.end, *(x for x in at if c.start < x < c.end)})
        out.extend(c.part(a, b) for a, b in zip(edges, edges[1:]))
    return out


def ripple(tracks: Tracks, track: int, a: int, b: int) -> Tracks:
    if b <= a:
        raise Refused("empty range")
    kept = [c if c.end <= a else c.shifted(a - b) for c in _split(tracks.get(track, ()), a, b) if c.end <= a or c.start >= b]
    return {**tracks, track: tuple(kept)}


def move(tracks: Tracks, track: int, a: int, b: int, to: int) -> Tracks:
    if b <= a or a <= to <= b:
        raise Refused("destination inside the range")
    size, out = b - a, []
    for c in _split(tracks.get(track, ()), a, b, to):
        if a <= c.start < b:
            by = to - a if to < a else to - size - a
        elif to < a and to <= c.start < a:
            by = size
        elif to > b and b <= c.start < to:
            by = -size
        else:
            by = 0
        out.append(c.shifted(by))
    return {**tracks, track: tuple(sorted(out, key=lambda c: c.start))}


def apply(tracks: Tracks, command: dict) -> Tracks:
    kind, track = command["kind"], int(command["track"])
    if kind == "place":
        return place(tracks, track, Clip(command["asset"], int(command["a"]), int(command["b"]), int(command["to"])))
    if kind == "ripple":
        return ripple(tracks, track, int(command["a"]), int(command["b"]))
    if kind == "move":
        return move(tracks, track, int(command["a"]), int(command["b"]), int(command["to"]))
    raise Refused(f"unknown command {kind}")


@dataclass(frozen=True)
class Gates:
    """What a command must meet: the least confidence of its decision, and the grid (units per frame) of edit points on video tracks."""

    floor: float = CONFIDENCE_FLOOR
    frame: int = 1


@dataclass(frozen=True)
class Document:
    tracks: Tracks
    kinds: tuple[str, ...] = ()
    assets: tuple[tuple[str, int], ...] = ()
    decisions: tuple[int, ...] = ()


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def apply_gated(doc: Document, command: dict, gates: Gates) -> Document:
    """The document after a command, checked in this order: confidence, track, asset, end of the source, empty range, grid, overlap."""
    kind, a, b, to = command["kind"], _number(command["a"]), _number(command["b"]), _number(command["to"])
    if kind == "addAsset":
        return replace(doc, assets=tuple({**dict(doc.assets), command["asset"]: b}.items()))
    if kind == "addTrack":
        return replace(doc, kinds=(*doc.kinds, command["asset"]))
    confidence = command.get("confidence")
    if confidence is None or confidence != confidence or confidence < gates.floor:
        raise Refused("confidence below floor")
    decided = (*doc.decisions, int(command["seq"]))
    if kind == "recordDecision":
        return replace(doc, decisions=decided)
    track = _number(command["track"])
    if track is None or not 0 <= track < len(doc.kinds):
        raise Refused("no such track")
    clips = doc.tracks.get(track, ())
    if kind == "placeInFrame":
        if not 0 <= a < len(clips):
            raise Refused("no such clip")
        if doc.kinds[track] != "video":
            raise Refused("not a video track")
        placed = (*clips[:a], replace(clips[a], placement=command.get("placement")), *clips[a + 1 :])
        return replace(doc, tracks={**doc.tracks, track: placed}, decisions=decided)
    points = (a, b) if kind == "ripple" else (a, b, to)
    if kind == "place":
        durations = dict(doc.assets)
        if command["asset"] not in durations:
            raise Refused("no such asset")
        if b > durations[command["asset"]]:
            raise Refused("past the end of the source")
        points = (to, to + b - a)
    elif b <= a:
        raise Refused("empty range")
    if doc.kinds[track] == "video" and any(x % gates.frame for x in points):
        raise Refused("off the grid")
    if kind == "move" and not any(c.start < b and a < c.end for c in clips):
        raise Refused("empty range")
    return replace(doc, tracks=apply(doc.tracks, command), decisions=decided)


def fold(commands: list[dict], gates: Gates | None = None) -> tuple[Tracks, list[int]]:
    """The tracks after the commands in order, and the numbers of those that were refused. Without gates only clips are edited."""
    document = Document({})
    refused = []
    for c in sorted(commands, key=lambda c: c["seq"]):
        try:
            document = replace(document, tracks=apply(document.tracks, c)) if gates is None else apply_gated(document, c, gates)
        except Refused:
            refused.append(int(c["seq"]))
    return document.tracks, refused


def replay(commands: DataFrame, up_to: int | None = None, gates: Gates | None = None) -> DataFrame:
    """The clips of every document after its commands (doc, seq, kind, track, asset, a, b, to and, with gates, confidence and placement), or after the
    first ``up_to`` of them: undo is a smaller number. Refused commands change nothing; clips with gates also have their ``placement``."""
    if up_to is not None:
        commands = commands.where(F.col("seq") < up_to)
    schema = SCHEMA if gates is None else SCHEMA + ", placement string"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tracks, _ = fold(pdf.to_dict("records"), gates)
        rows = [(key[0], t, i, c.asset, c.source_start, c.source_end, c.start, *(() if gates is None else (c.placement,))) for t, clips in sorted(tracks.items()) for i, c in enumerate(clips)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return commands.groupBy("doc").applyInPandas(run, schema)


def refusals(commands: DataFrame, gates: Gates) -> DataFrame:
    """doc, seq and why, of every command that was refused."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        document, rows = Document({}), []
        for c in pdf.sort_values("seq").to_dict("records"):
            try:
                document = apply_gated(document, c, gates)
            except Refused as e:
                rows.append((key[0], int(c["seq"]), str(e)))
        return pd.DataFrame(rows, columns=["doc", "seq", "why"])

    return commands.groupBy("doc").applyInPandas(run, "doc string, seq bigint, why string")
