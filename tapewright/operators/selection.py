"""Choosing between takes, joining what was chosen, and planning panels.

Takes are words in order with a take number; a recording group's takes are bounded by what was recorded of one script, so the alignment and
the choice run per group. Playheads and panels over whole tables are window functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.normalise import FILLERS
from tapewright.operators import sequences as Q
from tapewright.operators.blocked import blocks, previous, running_sum
from tapewright.operators.intervals import HOUR, PLACES

# ---- sound at joins --------------------------------------------------------------------------------------------------

# Steps of level (dB), room tone (dB) and pitch (semitones) that cost 1, and what each costs at most; seconds on either side of a join.
LEVEL_STEP, ROOM_STEP, PITCH_STEP = 6.0, 4.0, 2.0
MOST_LEVEL, MOST_ROOM, MOST_PITCH = 1.5, 1.5, 3.0
JOIN_WINDOW = 0.12


def pitch(samples: np.ndarray, rate: int, low: float = 65.0, high: float = 400.0) -> float | None:
    """Fundamental by autocorrelation of the mean-removed samples: the first best lag, if it is over 0.3 of the energy. None for 64 samples or fewer, for
    silence, and where there is no period."""
    lo, hi = int(rate / high), min(int(rate / low), len(samples) - 1)
    if len(samples) <= 64 or hi <= lo:
        return None
    x = np.asarray(samples, float)
    x = x - x.mean()
    energy = float(x @ x)
    if energy / len(x) <= 1e-8:
        return None
    values = np.array([float(x[: len(x) - k] @ x[k:]) / energy for k in range(lo, hi + 1)])
    best = int(values.argmax())
    return rate / (lo + best) if values[best] > 0.3 and lo + best > 0 else None


def level(samples: np.ndarray) -> float:
    """dBFS, -120 at or under 1e-9."""
    rms = float(np.sqrt(np.mean(np.square(samples, dtype=float)))) if len(samples) else 0.0
    return 20 * float(np.log10(rms)) if rms > 1e-9 else -120.0


def room_tone(samples: np.ndarray) -> float:
    """The level of the quietest tenth of the samples, in order; of fewer than ten the level of all."""
    size = len(samples) // 10
    return min(level(samples[i : i + size]) for i in range(0, len(samples) - size + 1, size)) if size else level(samples)


def join_cost(level_step: float, room_step: float, pitch_step: float | None, settled: bool) -> float:
    """Cost of a cut: steps in level, room tone and pitch, each in units of one that is plainly heard and bounded, and 1 for speech that hasn't settled."""
    cost = min(abs(level_step) / LEVEL_STEP, MOST_LEVEL) + min(abs(room_step) / ROOM_STEP, MOST_ROOM)
    cost += min(abs(pitch_step) / PITCH_STEP, MOST_PITCH) if pitch_step is not None else 0.0
    return cost + (0.0 if settled else 1.0)


def measure_join(run_up: np.ndarray, after: np.ndarray, rate: int) -> dict[str, float | bool | None]:
    """Level, room tone, pitch and settling on either side of a cut, and its cost. ``run_up``: the three windows before the cut, of which the last is compared
    with ``after``; speech has settled if the last third of the run-up is at most 1 dB over the first."""
    before = run_up[-round(JOIN_WINDOW * rate) :]
    pa, pb = pitch(before, rate), pitch(after, rate)
    step = None if pa is None or pb is None else abs(12 * float(np.log2(pb / pa)))
    third = len(run_up) // 3
    settled = len(run_up) < 6 or level(run_up[-third:]) <= level(run_up[:third]) + 1.0
    out = {"level_step": level(after) - level(before), "room_step": room_tone(after) - room_tone(before), "pitch_step": step, "settled": settled}
    return {**out, "cost": join_cost(out["level_step"], out["room_step"], step, settled)}


def join_costs(joins: DataFrame, samples: DataFrame, rate: int) -> DataFrame:
    """What every join sounds like: ``joins`` join_id, asset, out_at and in_at (sample numbers at which one side ends and the other begins); ``samples`` asset, n, v.

    Returns join_id, level_step, room_step, pitch_step, settled, cost. A join needs half a second of samples, which are looked up by buckets of that length."""
    from tapewright.operators.intervals import overlap_pairs

    size = round(JOIN_WINDOW * rate)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.greatest(F.col("out_at") - 3 * size, F.lit(0)).alias("lo"), F.col("out_at").alias("hi")), F.struct(F.lit(1).alias("side"), F.col("in_at").alias("lo"), (F.col("in_at") + size).alias("hi")))
    j = joins.select("join_id", "asset", F.explode(sides).alias("x")).select("join_id", "asset", "x.*")
    s = samples.select("asset", F.col("n").alias("s"), (F.col("n") + 1).alias("e"), F.col("v").cast("double").alias("v"))
    hit = overlap_pairs(j, s, ["asset"], ("lo", "hi"), ("s", "e"), 3 * size)
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("s", "v")))), lambda x: x["v"])
    g = hit.groupBy("join_id").agg(part(0).alias("a"), part(1).alias("b"))
    kind = g.schema["join_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [measure_join(np.asarray(x, float), np.asarray(y, float), rate) for x, y in zip(b["a"], b["b"])]
            yield pd.DataFrame({"join_id": b["join_id"], **{c: [r[c] for r in rows] for c in ("level_step", "room_step", "pitch_step", "settled", "cost")}})

    return g.mapInPandas(run, f"join_id {kind}, level_step double, room_step double, pitch_step double, settled boolean, cost double")


def echo_lag(samples: np.ndarray, rate: int, shortest: float = 0.015, longest: float = 1.0, envelope_rate: int = 200, least: float = 1.8) -> float | None:
    """Seconds after which the envelope repeats: the peak of its autocorrelation, if it stands out over the mean and isn't at a limit of the search. A quarter of a
    second of samples at least."""
    size = max(rate // envelope_rate, 1)
    n = len(samples) // size
    if len(samples) <= rate / 4 or n <= 8:
        return None
    env = np.sqrt(np.mean(np.square(np.asarray(samples[: n * size], float).reshape(n, size)), axis=1))
    env = env - env.mean()
    energy, per_second = float(env @ env), rate / size
    lo, hi = max(int(shortest * per_second), 1), min(int(longest * per_second), n // 2)
    if hi <= lo or energy <= 0:
        return None
    corr = np.array([float(env[: n - k] @ env[k:]) / energy for k in range(lo, hi + 1)])
    best = int(corr.argmax())
    if corr[best] <= 0 or best in (0, len(corr) - 1) or corr[best] / float(np.mean(np.abs(corr))) <= least:
        return None
    return (lo + best) / per_second


def echo_shift(first: np.ndarray, later: np.ndarray, distance, most: int) -> int | None:
    """By how many samples a panel shows what another showed before: the shift with the least mean distance, if it is inside the search and at least 2 % under that
    of no shift. Seven samples at least; a shift needs five pairs."""
    n = len(first)
    most = min(most, n // 2)
    if n <= 6 or most < 1:
        return None

    def score(shift: int) -> float:
        pairs = [distance(first[i], later[i + shift]) for i in range(n) if i + shift < len(later)]
        return float(np.mean(pairs)) if len(pairs) > 4 else float("inf")

    scores = [score(k) for k in range(most + 1)]
    best = int(np.argmin(scores))
    return best if 0 < best < most and scores[best] < 0.98 * scores[0] else None


# ---- takes -----------------------------------------------------------------------------------------------------------


def _lines(pdf: pd.DataFrame) -> list[dict]:
    """Lines of a take: words up to a final mark or a pause of more than 0.6 s."""
    out, held = [], []
    rows = pdf.to_dict("records")
    for i, r in enumerate(rows):
        held.append(r)
        last = i + 1 == len(rows) or rows[i + 1]["take"] != r["take"]
        if last or str(r["word"])[-1:] in ".?!" or rows[i + 1]["start_ms"] - r["end_ms"] > 600:
            out.append({"take": r["take"], "words": held})
            held = []
    return out


def _score(words: list[dict], separation: float | None) -> dict[str, float]:
    plain = [Q.trimmed(w["word"]) for w in words]
    stalls = sum(b["start_ms"] - a["end_ms"] > 550 for a, b in zip(words, words[1:]))
    restarts = sum(a == b and a != "" for a, b in zip(plain, plain[1:]))
    return Q.rendition_score(len(words), sum(p in FILLERS for p in plain), restarts, stalls, float(np.mean([w["conf"] for w in words])) / 100 if words else 0.0, separation)


def choose_takes(words: DataFrame, key: str) -> DataFrame:
    """Per line of the spine the take to use: key, line, take, text, score, start_ms, end_ms, deciding (axis or 'near tie'; NULL without a rival), repeated.

    ``words``: key, take, idx, word, start_ms, end_ms, conf (hundredths). Lines that recur in the spine itself (similarity 0.75 or more) are
    flagged, never merged.
    """
    w = words.select(F.col(key).alias("key"), "take", "idx", "word", "start_ms", "end_ms", "conf")
    kind = w.schema["key"].dataType.simpleString()

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = _lines(pdf.sort_values(["take", "idx"]))
        takes = sorted({x["take"] for x in lines})
        by = [[x["words"] for x in lines if x["take"] == t] for t in takes]
        tokens = [[[p for p in (Q.word_key(y["word"]) for y in x) if p] for x in own] for own in by]
        rows = Q.align_takes(tokens)
        spine = max(range(len(takes)), key=lambda t: (sum(map(len, tokens[t])), -t)) if takes else 0
        out = []
        for n, row in enumerate(rows):
            options = []
            for t, span in enumerate(row):
                if span:
                    said = [x for l in by[t][span[0] : span[1] + 1] for x in l]
                    options.append((_score(said, None), t, said))
            options.sort(key=lambda o: (-o[0]["score"], o[1]))
            s, t, said = options[0]
            again = any(m != n and Q.similarity(tokens[spine][n], other) >= 0.75 for m, other in enumerate(tokens[spine]))
            deciding = Q.deciding_axis(s, options[1][0]) if len(options) > 1 else None
            out.append((k[0], n, int(takes[t]), " ".join(x["word"] for x in said), float(s["score"]), int(said[0]["start_ms"]), int(said[-1]["end_ms"]), deciding, again))
        return pd.DataFrame(out, columns=["key", "line", "take", "text", "score", "start_ms", "end_ms", "deciding", "repeated"])

    return w.groupBy("key").applyInPandas(run, f"key {kind}, line int, take int, text string, score double, start_ms bigint, end_ms bigint, deciding string, repeated boolean").withColumnRenamed("key", key)


def assemble(choices: DataFrame, keys: Sequence[str], order: str, start: str, end: str, handle: int, score: Column) -> DataFrame:
    """Chosen stretches one after another: with handles on either side, the playhead of each, and the confidence floor((0.7 + 0.25 q) 100) / 100."""
    c = choices.withColumn("source_start", F.greatest(F.col(start) - handle, F.lit(0))).withColumn("source_end", F.col(end) + handle)
    c = blocks(c.withColumn("__length", F.col("source_end") - F.col("source_start")), order, PLACES)
    c = running_sum(c, keys, "__block", [order], "__length", "__upto")
    c = c.withColumn("at", F.col("__upto") - F.col("__length")).drop("__block", "__length", "__upto")
    return c.withColumn("confidence", F.floor((0.70 + 0.25 * score) * 100) / 100)


def panel_plan(cuts: DataFrame, keys: Sequence[str], order: str, start: str, end: str, panel: str, frame: int, panels: int, opening: Column | None = None, echo: int = 0) -> DataFrame:
    """Cuts of a script on the frame grid with their playheads; and for every panel the source position at which it stays frozen (NULL before it has played).

    Start and length are snapped, the length to at least one frame. A cut of the ``opening`` is played by all panels, each ``echo`` after the one
    before, so it lasts until the last has finished, and each is frozen where it got to. Cuts without a range are left out. A script's cuts are one window.
    """
    snap = lambda c: F.floor(c / frame + 0.5).cast("bigint") * frame
    w = Window.partitionBy(*keys).orderBy(order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    step = (echo + frame // 2) // frame * frame
    opens = F.lit(False) if opening is None else F.coalesce(opening, F.lit(False))
    c = cuts.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__opens", opens).withColumn("source_start", snap(F.col(start)))
    c = c.withColumn("source_end", F.col("source_start") + F.greatest(snap(F.col(end) - F.col(start)), F.lit(frame)))
    c = c.withColumn("span", F.col("source_end") - F.col("source_start") + F.when(F.col("__opens"), step * max(panels - 1, 0)).otherwise(0))
    c = c.withColumn("at", F.coalesce(F.sum("span").over(earlier), F.lit(0)))
    stop = lambda p: F.when(F.col("__opens"), F.greatest(F.col("source_end") - step * p, F.lit(0))).when(F.col(panel) == p, F.col("source_end"))
    frozen = [F.last(stop(p), ignorenulls=True).over(earlier).alias(f"frozen_{p}") for p in range(panels)]
    return c.select("*", *frozen).drop("__opens")


def brief_of(scenes: DataFrame, key: str, order: str, shot: str) -> DataFrame:
    """Per recording the dominant shot (ties by name), how often the shot changes, and the runs of other shots (cutaways)."""
    n = scenes.groupBy(key, shot).agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy(key).agg(F.max("n").alias("m"))
    top = n.join(most, key).where("n = m").groupBy(key).agg(F.min(shot).alias("dominant"))
    s = previous(blocks(scenes, order, HOUR), [key], "__block", [order], shot, "__was").withColumn("was", F.col("__was.value")).join(top, key)
    change = F.col("was").isNotNull() & (F.col("was") != F.col(shot))
    cutaway = (F.col(shot) != F.col("dominant")) & (F.col("was").isNull() | (F.col("was") == F.col("dominant")))
    return s.groupBy(key).agg(F.max("dominant").alias("dominant"), F.count_if(change).alias("changes"), F.count_if(cutaway).alias("cutaways"), F.count(F.lit(1)).alias("n"))


def panel_similarities(frames: DataFrame, keys: Sequence[str], vector: str, panels: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """How alike the parts of a picture are if it is split: keys, panels, arrangement ('stacked': the picture's values cut into runs, 'side': dealt out in turn) and
    similarity, 1 less the mean difference, of every pair of parts of every frame. Values are shares; a rest that doesn't fill a part is left out."""
    options = []
    for n in panels:
        size = F.call_function("div", F.size(vector), F.lit(n)).cast("int")
        stacked = [F.slice(vector, size * i + 1, size) for i in range(n)]
        side = [_dealt(vector, i, n, size) for i in range(n)]
        for name, parts in (("stacked", stacked), ("side", side)):
            for i in range(n):
                for j in range(i + 1, n):
                    apart = F.aggregate(F.zip_with(parts[i], parts[j], lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / size
                    options.append(F.struct(F.lit(n).alias("panels"), F.lit(name).alias("arrangement"), (1 - apart).alias("similarity")))
    return frames.where(F.size(vector) >= max(panels)).select(*keys, F.explode(F.array(*options)).alias("o")).select(*keys, "o.*")


def _dealt(vector: str, i: int, n: int, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.element_at(vector, k * n + (i + 1)))


def panel_layout(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The arrangement whose parts are most alike, from ``pairs`` (keys, panels, arrangement, similarity): split if the mean is over 0.55."""
    m = pairs.groupBy(*keys, "panels", "arrangement").agg(F.round(F.avg("similarity"), 9).alias("s"))
    best = m.groupBy(*keys).agg(F.max(F.struct("s", (-F.col("panels")).alias("p"), "arrangement")).alias("b"))
    return best.select(*keys, (-F.col("b.p")).alias("panels"), "b.arrangement", F.col("b.s").alias("similarity"), (F.col("b.s") > 0.55).alias("is_split"))


def freeze_and_resume(series: DataFrame, keys: Sequence[str], order: str, distance: str, vector: str, still: float = 1e-4, least: int = 3) -> DataFrame:
    """Runs of three or more still samples, and how far the frame at which the picture goes on is from the one at which it froze."""
    from tapewright.operators.signals import mean_difference

    w = Window.partitionBy(*keys).orderBy(order)
    s = series.withColumn("still", F.coalesce(F.col(distance) < still, F.lit(False))).withColumn("was", F.lag("still").over(w))
    s = s.withColumn("n", F.sum(F.when(F.col("still") & F.coalesce("was", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("frozen_at", F.lag(vector).over(w)).withColumn("next", F.lead(vector).over(w))
    r = s.where("still").groupBy(*keys, "n").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("samples"), F.min_by("frozen_at", order).alias("a"), F.max_by("next", order).alias("b"))
    return r.where((F.col("samples") >= least) & F.col("b").isNotNull()).select(*keys, "first", "last", "samples", mean_difference(F.col("a"), F.col("b")).alias("difference"))
